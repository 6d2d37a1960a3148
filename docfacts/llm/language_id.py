"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counting reads every text with a known language, in numpy within tasks; Spark adds the counts up. The matrix of
log-probabilities (buckets x languages, a fixed number of buckets) goes to the tasks, which score batches of texts.

The matrix grows with the languages. Up to MOST_LANGUAGES make one model; more are cut into models of that many, each
of which goes over the texts in a pass of its own, and the passes' verdicts are put together by document, with the same
result. A task holds the counts of HELD languages at a time.

Characters that are not letters count as one blank; an n-gram of blanks alone counts for nothing. Null texts and texts
without a letter are `und` with score 0. Ties go to the language that sorts first. Repeated rows are scored alike. With
nothing to learn from, every text is `und`; an empty table gives an empty one. Further columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, map_arrow

UNKNOWN = "und"
BUCKETS = 1 << 15
SIZES = (2, 3)
#: Languages that one model has at most (256 kB each), and that a task counts at a time.
MOST_LANGUAGES, HELD = 200, 32
#: Characters that numpy works on at once; longer texts are taken in overlapping pieces.
PIECE = 400_000


@cache
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or a blank."""
    out = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _pieces(texts: list[str]):
    """(index of the text, piece) with every n-gram in just one piece."""
    lap = max(SIZES) - 1
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - lap), PIECE):
            yield i, t[a : a + PIECE + lap], a + PIECE + lap >= len(t)


def _groups(texts: list[str]):
    """Pieces gathered up to about PIECE characters."""
    group, size = [], 0
    for x in _pieces(texts):
        group.append(x)
        size += len(x[1])
        if size >= PIECE:
            yield group
            group, size = [], 0
    if group:
        yield group


def hashed(group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text index of each n-gram in a group of pieces, and whether each piece has a letter."""
    joined = "".join("\0" * max(SIZES) + t for _, t, _ in group)
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    length = np.array([max(SIZES) + len(t) for _, t, _ in group])
    owner = np.repeat(np.array([i for i, _, _ in group]), length)
    gap = raw == 0
    x = _letters()[np.minimum(raw, 0x10FFFF)]
    x[gap] = 0
    letter = (x != 0x20) & ~gap
    has = np.add.reduceat(letter, np.concatenate(([0], np.cumsum(length)[:-1]))) > 0
    lap, last = max(SIZES) - 1, np.array([z for _, _, z in group])
    ends = np.cumsum(length)
    buckets, owners = [], []
    for n in SIZES:
        m = len(x) - n + 1
        if m <= 0:
            continue
        h = np.full(m, 2166136261 + n, np.uint32)
        some, whole = np.zeros(m, bool), np.ones(m, bool)
        for k in range(n):
            h = (h ^ x[k : k + m]) * np.uint32(16777619)
            some |= letter[k : k + m]
            whole &= ~gap[k : k + m]
        h ^= h >> np.uint32(15)
        keep = some & whole
        if n <= lap:  # shorter n-grams in the lap belong to the next piece
            for e in ends[~last]:
                keep[max(0, e - lap) : e - n + 1] = False
        buckets.append((h[keep] & np.uint32(BUCKETS - 1)).astype(np.int32))
        owners.append(owner[:m][keep])
    return np.concatenate(buckets), np.concatenate(owners), has


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # BUCKETS x langs
    prior: np.ndarray

    def floors(self) -> np.ndarray:
        """For each language the mean log-probability of an n-gram below which a text is none of its: a third of the way
        from what its own texts have to what any bucket has."""
        own, any_bucket = (np.exp(self.log_p) * self.log_p).sum(0), self.log_p.mean(0)
        return own - (own - any_bucket) / 3

    def weighed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the log-probability with each language, whether it has a letter, and its n-grams."""
        total, letters, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool), np.zeros(len(texts))
        for group in _groups(texts):
            b, owner, has = hashed(group)
            np.logical_or.at(letters, np.array([i for i, _, _ in group]), has)
            n += np.bincount(owner, minlength=len(texts))
            for j in range(len(self.langs)):
                total[:, j] += np.bincount(owner, self.log_p[b, j], len(texts))
        return total, letters, n

    def judge(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, posterior, and whether the text looks like the language at all (posteriors only compare)."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        total, letters, n = self.weighed(texts)
        z = total + self.prior
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        best, row = p.argmax(1), np.arange(len(texts))
        clear = letters & (total[row, best] >= self.floors()[best] * n)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, p[row, best], 0.0).tolist(), clear.tolist()

    def part(self, texts: list[str]) -> list[tuple]:
        """What one of several models says: the best language, its log-probability, the log of the sum over all its
        languages, whether the text has a letter and looks like that language."""
        total, letters, n = self.weighed(texts)
        z = total + self.prior
        best, row = z.argmax(1), np.arange(len(texts))
        top = z[row, best]
        every = top + np.log(np.exp(z - top[:, None]).sum(1))
        clear = letters & (total[row, best] >= self.floors()[best] * n)
        return list(zip([self.langs[b] for b in best], top.tolist(), every.tolist(), letters.tolist(), clear.tolist(), strict=True))

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]


def count(rows: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket, n: occurrences of hashed n-grams in all rows that have a language; bucket -1 counts the rows."""

    def counted(name: str, x: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(x)
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at), pa.int32()), pa.array(x[at])], names=["lang", "bucket", "n"]
        )

    def tally(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for name in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == name]
                into = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                into[BUCKETS] += len(own)
                for group in _groups(own):
                    into[:BUCKETS] += np.bincount(hashed(group)[0], minlength=BUCKETS)
                if len(sums) > HELD:
                    yield from (counted(*x) for x in sums.items())
                    sums = {}
        yield from (counted(*x) for x in sums.items())

    known = rows.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return map_arrow(known, tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _model(found, langs: list[str], documents: float, smoothing: float) -> Model:
    """found: lang, bucket and n of these languages, as a frame; documents: how many all languages have."""
    table, prior = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    for j, name in enumerate(langs):
        own = found[found["lang"] == name]
        at, n = own["bucket"].to_numpy(), own["n"].to_numpy()
        table[at[at >= 0], j] = n[at >= 0]
        prior[j] = n[at < 0].sum()
    table += smoothing
    return Model(langs, np.log(table / table.sum(0)) if langs else table, np.log(prior / documents) if langs else prior)


@dataclass
class Models:
    """More languages than one model has: their counts as a stored table, and the names with their documents."""

    counts: DataFrame
    langs: list[str]
    documents: float
    smoothing: float

    def each(self):
        for a in range(0, len(self.langs), MOST_LANGUAGES):
            own = self.langs[a : a + MOST_LANGUAGES]
            yield _model(self.counts.where(F.col("lang").isin(own)).toPandas(), own, self.documents, self.smoothing)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model | Models:
    """The model over all rows given; what reaches the driver at a time is BUCKETS + 1 numbers for each of
    MOST_LANGUAGES languages at most."""
    many = rows.where(F.col(lang).isNotNull()).select(lang).distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES
    found = count(rows, text, lang)
    if not many:
        found = found.toPandas()
        return _model(found, sorted(found["lang"].unique()), found["n"][found["bucket"] < 0].sum(), smoothing)
    found = durable(found, "ngrams")
    size = found.where("bucket < 0").toPandas()  # a row for each language
    return Models(found, sorted(size["lang"]), float(size["n"].sum()), smoothing)


def _verdicts(rows: DataFrame, models: Models, key: str, text: str) -> DataFrame:
    """key, lang, score and clear of each row, put together from a pass for each model. rows: a stored table."""
    kind, every = dict(rows.dtypes)[key], None
    names = ["lang", "top", "every", "letters", "clear"]
    for model in models.each():
        sent = rows.sparkSession.sparkContext.broadcast(model)  # MOST_LANGUAGES at most

        def run(batches, sent=sent):
            for b in batches:
                found = sent.value.part([t or "" for t in b.column("text").to_pylist()])
                cols = list(zip(*found, strict=True)) or [[]] * len(names)
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["key", *names])

        own = map_arrow(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, lang string, top double, every double, letters boolean, clear boolean")
        own = durable(own, "languages")
        sent.unpersist()
        every = own if every is None else every.unionByName(own)
    # of equal probabilities the language that sorts first; sums by their differences from the largest
    best = F.min(F.struct((-F.col("top")).alias("below"), "lang", "letters", "clear")).alias("b")
    top = every.groupBy("key").agg(best, F.max("every").alias("m"), F.collect_list("every").alias("e"))
    total = F.col("m") + F.log(F.aggregate(F.transform("e", lambda x: F.exp(x - F.col("m"))), F.lit(0.0), lambda s, x: s + x))
    known = F.col("b.letters")
    return top.select(
        "key", F.when(known, F.col("b.lang")).otherwise(UNKNOWN).alias("lang"), F.when(known, F.exp(-F.col("b.below") - total)).otherwise(0.0).alias("score"), F.col("b.clear").alias("clear")
    )


def predict(rows: DataFrame, model: Model | Models, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    if isinstance(model, Models):
        held = durable(rows.select(F.struct("doc_id", F.monotonically_increasing_id().alias("no")).alias("key"), F.col(text).alias("text")), "texts")
        return _verdicts(held, model, "key", "text").select("key.doc_id", F.col("lang").alias("lang_pred"), "score")
    sent = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages doubles: 1 MB for four

    def run(batches):
        for b in batches:
            lang, score = sent.value.score([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    doc_id = dict(rows.dtypes)["doc_id"]
    return map_arrow(
        rows.select("doc_id", F.col(text).alias("text")), run, f"doc_id {doc_id}, lang_pred string, score double"
    )


def keep_identified(rows: DataFrame, model: Model | Models, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose language is known with a score of `least` or more and that look like it, with all their columns."""
    if isinstance(model, Models):
        key = fresh(rows, "row_no")
        held = durable(rows.withColumn(key, F.monotonically_increasing_id()), "texts")
        good = _verdicts(held, model, key, text).where((F.col("lang") != UNKNOWN) & (F.col("score") >= least) & F.col("clear"))
        return held.join(good.select(F.col("key").alias(key)), key, "left_semi").select(*rows.columns)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score, clear = sent.value.judge([t or "" for t in b.column(text).to_pylist()])
            yield b.filter(pa.array([x != UNKNOWN and s >= least and c for x, s, c in zip(lang, score, clear, strict=True)], pa.bool_()))

    return map_arrow(rows, run, rows.schema)
