"""Quality rules: a learned decision list over document statistics.

Sequential covering: a rule grows as a conjunction of thresholds on two thirds of the labelled rows, is pruned on the
last third, and is kept while it is precise there; the rows it covers leave, and the next rule grows. The list becomes
one ordered Spark conditional expression.

Null texts count as empty (all statistics zero), ties keep the first threshold found, repeated rows are judged alike,
empty tables give empty results, an unlabelled corpus gives an empty list (all kept that pass the base rule), and
further columns of the input pass through `keep_documents` untouched whatever their names. A very long text is counted
whole in one task.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, labelled_sample, map_arrow

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_digits",
    "n_bangs",
    "n_pipes",
    "n_stops",
    "n_stutters",
)
STATS = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])
WINDOW = 8
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside any window that stands twice or more in the text, its first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    cuts = [joined[a:b] for a, b in zip(starts[:n].tolist(), (ends[window - 1 :] - 1).tolist(), strict=True)]
    if len(set(cuts)) == n:
        return 0
    seen = Counter(cuts)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.fromiter((i for i, c in enumerate(cuts) if seen[c] > 1), np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_counts(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _DIGITS)),
        raw.count(b"!"),
        raw.count(b" | "),
        raw.count(b"."),
        sum(map(eq, words, islice(words, 1, None))),
    )


def with_counts(df: DataFrame, into: str, text: str = "text") -> DataFrame:
    """df and a struct of COUNTS for each row, in one pass over the texts."""

    def add(batches):
        kind = pa.struct([pa.field(c, pa.int64(), False) for c in COUNTS])
        for b in batches:
            rows = [text_counts(t or "") for t in b.column(text).to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.StructArray.from_arrays(cols, fields=list(kind))], names=[*b.schema.names, into]
            )

    return map_arrow(df, add, T.StructType([*df.schema.fields, T.StructField(into, STATS, False)]))


def features(stats: str) -> dict[str, Column]:
    """What the thresholds are set on, as Spark expressions over the struct named `stats`."""

    def ratio(top: str, by: str) -> Column:
        return F.col(stats)[top] / F.greatest(F.col(stats)[by], F.lit(1))

    return {
        "n_words": F.col(stats)["n_words"].cast("double"),
        "mean_word": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
        "words_per_line": ratio("n_words", "n_lines"),
        "upper_share": ratio("n_upper", "word_chars"),
        "digit_share": ratio("n_digits", "word_chars"),
        "bangs_per_word": ratio("n_bangs", "n_words"),
        "pipes_per_word": ratio("n_pipes", "n_words"),
        "stops_per_word": ratio("n_stops", "n_words"),
        "stutters_per_word": ratio("n_stutters", "n_words"),
    }


def base_failed(stats: str) -> Column:
    s = F.col(stats)
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] <= self.threshold

    def column(self, x: dict[str, Column]) -> Column:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects a document on which every condition holds."""

    conditions: tuple[Condition, ...]

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + " -> reject"


def _covered(conditions, x: dict[str, np.ndarray], size: int) -> np.ndarray:
    out = np.ones(size, bool)
    for c in conditions:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int, steps: int) -> list[Condition]:
    chosen: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(chosen) < longest and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p:
            break
        before, best, gain = np.log2(p / (p + n)), None, 1e-9
        for name, values in x.items():
            for t in np.unique(np.quantile(values[inside & bad], np.linspace(0, 1, steps))):
                for up in (True, False):
                    hit = inside & (values >= t if up else values <= t)
                    p1 = (hit & bad).sum()
                    if p1 and (g := p1 * (np.log2(p1 / hit.sum()) - before)) > gain:
                        best, gain = Condition(name, up, float(t)), g
        if best is None:
            break
        # a tighter threshold on the same side takes the looser one's place
        chosen = [c for c in chosen if (c.feature, c.at_least) != (best.feature, best.at_least)] + [best]
        inside &= best.holds(x)
    return chosen


def _worth(conditions, x, bad) -> float:
    hit = _covered(conditions, x, len(bad))
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, longest: int = 4, most: int = 12, steps: int = 33, seed: int = 7) -> list[Rule]:
    """An ordered list of rules that reject; x: a value for each row and feature, bad: rows labelled 0.

    precision: the least share of bad rows among those a pruned rule covers, on rows it has not grown on.
    """
    rules: list[Rule] = []
    left = np.random.default_rng(seed).permutation(len(bad))
    while len(rules) < most and bad[left].sum() >= 6:
        test = np.arange(len(left)) % 3 == 2
        grow, prune = left[~test], left[test]
        xg, xp = ({k: v[i] for k, v in x.items()} for i in (grow, prune))
        conditions = _grow(xg, bad[grow], longest, steps)
        while len(conditions) > 1 and _worth(conditions[:-1], xp, bad[prune]) >= _worth(conditions, xp, bad[prune]):
            conditions = conditions[:-1]
        hit = _covered(conditions, xp, len(prune))
        if not conditions or hit.sum() < 2 or bad[prune][hit].mean() < precision:
            break
        rules.append(Rule(tuple(conditions)))
        left = left[~_covered(conditions, {k: v[left] for k, v in x.items()}, len(left))]
    return rules


def verdict(rules: list[Rule], stats: str) -> Column:
    """The ordered conditional expression: true keeps. The first rule that covers a document decides."""
    x, out = features(stats), None
    for rule in rules:
        hit = rule.conditions[0].column(x)
        for c in rule.conditions[1:]:
            hit = hit & c.column(x)
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, most_rows: int = 20_000, **options) -> list[Rule]:
    """Learn from labelled rows, at most `most_rows` of them in the order of a hash of their ids; only their statistics
    (a few numbers a row) come to the driver. Rows without a label or an id teach nothing."""
    marked = labelled_sample(labels, most_rows)
    rows = with_counts(documents.select("doc_id", "text").join(F.broadcast(marked), "doc_id"), "stats")
    x = features("stats")
    # of documents that share an id one teaches, so no more rows come than ids
    one = rows.select("doc_id", F.struct(*[c.alias(k) for k, c in x.items()]).alias("x"), "quality").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("quality").alias("quality"))
    found = one.orderBy(F.xxhash64("doc_id"), "doc_id").select("quality", "x.*").toPandas()
    return learn({k: found[k].to_numpy(float) for k in x}, found["quality"].to_numpy() == 0, **options)


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed, kept (false if base_failed, else the list's verdict)."""
    rows = with_counts(documents.select("doc_id", "text"), "stats")
    return rows.select(
        "doc_id",
        *[F.col("stats")[c].alias(c) for c in COUNTS],
        base_failed("stats").alias("base_failed"),
        (~base_failed("stats") & verdict(rules, "stats")).alias("kept"),
    )


def keep_documents(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the base rule and the list keep, with all their columns."""
    name = fresh(documents, "quality_counts")
    rows = with_counts(documents, name)
    return rows.where(~base_failed(name) & verdict(rules, name)).drop(name)
