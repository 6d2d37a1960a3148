"""License scans by diagonal voting.

Every rolling word pair of every text, and every run of four words, is hashed and joined, in Spark, to the places of equal
ones in templates: pairs for phrases and notices of a line, runs of four for whole licence texts, whose pairs are those
of any prose. A k-gram at word p of a text and place q of a template votes for diagonal p - q; votes are aggregated by
text, template and diagonal, as bits in words of 64, so a template may have any length. A phrase (base label) stands where
its diagonal has all votes; votes of a notice on a diagonal and the few after it (its slack) are merged, so that some
words more or less do no harm, and a span is never longer than its template and the slack. The spans found are then
verified against the words themselves: template and span are aligned in order.

The template table is fixed and small, so it is broadcast. Spans found are broadcast for verification while they are few
(`broadcast_rows`), else joined by shuffle.

Null texts are empty. Equal rows share their spans and are all returned. Ties of spans change nothing. An empty table
gives an empty result; further columns are left alone. The words of a very long text are cut in one task, its pairs and
votes are rows like any other's.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow, plain_words
from .license_texts import BODIES, NOTICES

#: Words of a k-gram of phrases and notices, and of whole texts.
K, BODY_K = 2, 4
#: Words that may be missing or too many between merged diagonals: this many, or one in so many of the template.
SLACK, SLACK_SHARE = 3, 16
#: Least share of a template's k-grams that must stand in a span, for notices and for whole texts.
COVER, BODY_COVER = 0.7, 0.6

PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}


@dataclass(frozen=True)
class Template:
    words: list[bytes]
    label: str
    k: int
    cover: float
    slack: int

    @property
    def grams(self) -> int:
        return len(self.words) - self.k + 1


def _templates() -> list[Template]:
    out = [Template(plain_words(p), label, K, 1.0, 0) for p, label in PHRASES.items()]
    out += [Template(plain_words(p), label, K, COVER, SLACK) for p, label in NOTICES.items()]
    for label, text in BODIES.items():
        words = plain_words(text)
        out.append(Template(words, label, BODY_K, BODY_COVER, max(SLACK, len(words) // SLACK_SHARE)))
    return out


TEMPLATES = _templates()


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """For two words the crc32 of either, side by side in 64 bits; for more, these mixed."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    out = (h[:n] << np.uint64(32)) | h[1 : n + 1]
    for j in range(2, k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j]
    return out.view(np.int64)


def _key(id_column: str = "doc_id") -> Column:
    return F.xxhash64(F.col(id_column), F.col("text"))


def votes(documents: DataFrame) -> DataFrame:
    """key (of equal rows), template, diagonal, part, mask: the template's places that voted, 64 in each part."""

    def run(batches):
        for b in batches:
            texts = [plain_words(t) for t in b.column("text").to_pylist()]
            rows = [gram_hashes(w, k) for w in texts for k in (K, BODY_K)]
            size = np.array([len(r) for r in rows], np.int64).reshape(-1, 2)
            ends = np.concatenate(([0], np.cumsum(size.sum(1))))
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            grams = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(size[:, 0]), grams], names=["key", "pairs", "grams"])

    spark = documents.sparkSession
    places = [(int(h), n, q) for n, t in enumerate(TEMPLATES) for q, h in enumerate(gram_hashes(t.words, t.k))]
    table = F.broadcast(spark.createDataFrame(places, "gram long, template int, q int"))
    texts = documents.where(F.col("text").isNotNull()).select(_key().alias("key"), "text")
    # a text's pairs, and its runs behind them
    rolled = map_arrow(texts, run, "key long, pairs long, grams array<long>").select("key", "pairs", F.posexplode("grams").alias("at", "gram"))
    p = F.when(F.col("at") < F.col("pairs"), F.col("at")).otherwise(F.col("at") - F.col("pairs"))
    hits = rolled.join(table, "gram").select("key", "template", "q", p.alias("p"))
    place = (F.col("q") / 64).cast("int").alias("part")
    return hits.groupBy("key", "template", (F.col("p") - F.col("q")).alias("diagonal"), place).agg(F.expr("bit_or(shiftleft(1L, q % 64))").alias("mask"))


def spans(documents: DataFrame) -> DataFrame:
    """key, found: array of (template, first word, word after the last) to verify."""

    def of(value) -> Column:
        return F.create_map(*[x for n, t in enumerate(TEMPLATES) for x in (F.lit(n), F.lit(value(t)))])[F.col("template")]

    words, grams, slack = of(lambda t: len(t.words)), of(lambda t: t.grams), of(lambda t: t.slack)
    least = of(lambda t: int(np.ceil(t.cover * t.grams - 1e-9)))
    merged = (
        votes(documents)
        .select("key", "template", "part", "mask", F.explode(F.sequence(F.col("diagonal") - slack, F.col("diagonal"))).alias("first"))
        .groupBy("key", "template", "first", "part")
        .agg(F.bit_or("mask").alias("mask"))
        .groupBy("key", "template", "first")
        .agg(F.sum(F.bit_count("mask")).alias("n"))
        .where((F.col("n") >= least) & (F.col("n") <= grams))
        .select("key", "template", F.greatest("first", F.lit(0)).alias("first"), (F.col("first") + words + slack).alias("after"))
    )
    return merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("template", "first", "after"))).alias("found"))


def aligned(template: list[bytes], own: list[bytes], k: int = K) -> tuple[float, int, int]:
    """Share of the template's k-grams that stand in own in the same order, and the places of the first and last such."""
    want, where = len(template) - k + 1, defaultdict(list)
    for j in range(len(own) - k, -1, -1):
        where[tuple(own[j : j + k])].append(j)
    # for each length, the alignment that ends earliest: place of its last k-gram, and of its first
    last: list[int] = []
    first: list[int] = []
    for i in range(want):
        for j in where.get(tuple(template[i : i + k]), ()):
            n = bisect_left(last, j)
            start = first[n - 1] if n else j
            if n == len(last):
                last.append(j)
                first.append(start)
            elif j < last[n]:
                last[n], first[n] = j, start
    return (len(last) / want, first[-1], last[-1]) if last else (0.0, 0, 0)


def verify(words: list[bytes], found: list[dict]) -> tuple[list[int], set[str], set[str], float, list[tuple]]:
    """Starts of phrases, their labels, labels of notices and texts, the best coverage, and the spans that hold."""
    starts, base, more, best, kept = [], set(), set(), 0.0, []
    for x in found:
        t = TEMPLATES[x["template"]]
        own = words[x["first"] : x["after"]]
        if x["template"] < len(PHRASES):
            if own == t.words:
                starts.append(x["first"])
                base.add(t.label)
                best = 1.0
                kept.append((x["first"], x["after"], t.label))
        else:
            share, first, last = aligned(t.words, own, t.k)
            span = (x["first"] + first, x["first"] + last + t.k, t.label)
            if share >= t.cover and span not in kept:
                more.add(t.label)
                best = max(best, share)
                kept.append(span)
    return starts, base, more, best, kept


def scan(documents: DataFrame, broadcast_rows: int = 400_000) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (first, after, label)."""
    found = durable(spans(documents), "spans")
    # a row with one span is about 60 bytes; the bound counts spans
    few = (found.agg(F.sum(F.size("found"))).first()[0] or 0) <= broadcast_rows
    rows = documents.select("doc_id", "text", _key().alias("key")).join(F.broadcast(found) if few else found, "key", "left")

    def run(batches):
        span = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("label", pa.string())]))
        for b in batches:
            out = []
            for text, own in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
                words = plain_words(text or "")
                starts, base, more, best, kept = verify(words, own or [])
                out.append(
                    (
                        len(words),
                        len(starts),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | more)),
                        best,
                        [{"first": a, "after": z, "label": x} for a, z, x in kept],
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return map_arrow(
        rows.select("doc_id", "text", "found"),
        run,
        f"doc_id {dict(documents.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long,"
        " base_labels string, labels string, score double, spans array<struct<first:long,after:long,label:string>>",
    )
