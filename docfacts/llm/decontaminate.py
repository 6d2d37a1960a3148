"""Benchmark decontamination: a prefix-filtered set join between documents and benchmark windows.

Each benchmark item gives windows of WINDOW consecutive words (a shorter item is one window). A document contains a
window only if it contains all its shingles (SHINGLE words, or the whole of a shorter window), so the necessary prefix
of a window is its single rarest shingle. How often each shingle of the benchmark stands in all documents is counted
first. Documents then send the places of prefix shingles, with the words around them, to an equi-join with the windows;
the shingle's offset bounds where the window would lie (position), the words there must be enough (length), and the
words are compared exactly.

Before each of the two passes over the documents, a bitmap of at most MOST_BITS bits goes to the tasks, so that only
shingles that may be in the benchmark travel; what passes it in vain finds no partner in the join. A benchmark of any
size takes two passes. Windows stay in tables, and neither driver nor task holds the benchmark.

Null texts have no words; items without words give no windows; items with equal ids and texts count once, a null
item_id counts as the empty string. Ties between equally rare shingles go to the smaller hash. Documents come back as
often as they are repeated, with further columns left alone. A very long text is cut into words whole in one task. An
empty benchmark leaves all documents clean, an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, durable, fresh, map_arrow, plain_words

WINDOW, SHINGLE = 13, 3
#: Bits of a bitmap at most (16 MB).
MOST_BITS = 1 << 27
#: Windows of an item that a task holds at a time.
PART = 20_000


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash of every run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    each = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def windows(items: DataFrame) -> DataFrame:
    """window (its words, joined by blanks), n (words), hashes (of its shingles), items (ids that have it, sorted)."""

    def run(batches):
        for b in batches:
            for item_id, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = plain_words(text)
                n = min(WINDOW, len(w))
                size = min(SHINGLE, n)
                h = shingle_hashes(w, size) if n else np.zeros(0, np.int64)
                last = len(w) - n + 1 if n else 0
                for a in range(0, last, PART):
                    own = range(a, min(last, a + PART))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([item_id] * len(own), pa.string()),
                            pa.array([b" ".join(w[i : i + n]).decode() for i in own], pa.string()),
                            pa.array([n] * len(own), pa.int32()),
                            pa.array([h[i : i + n - size + 1] for i in own], pa.list_(pa.int64())),
                        ],
                        names=["item_id", "window", "n", "hashes"],
                    )

    rows = map_arrow(items, run, "item_id string, window string, n int, hashes array<long>")
    return rows.groupBy("window").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"), F.array_sort(F.collect_set("item_id")).alias("items"))


def count_shingles(documents: DataFrame, wanted: Bitmap, sizes: list[int]) -> DataFrame:
    """h, seen: how often shingles that may be in the benchmark stand in all documents."""
    sent = documents.sparkSession.sparkContext.broadcast(wanted)  # MOST_BITS at most

    def run(batches):
        for b in batches:
            found = [np.zeros(0, np.int64)]
            for t in b.column("text").to_pylist():
                words = plain_words(t or "")
                for size in sizes:
                    h = shingle_hashes(words, size)
                    found.append(h[sent.value.holds(h)])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n, pa.int64())], names=["h", "n"])

    return map_arrow(documents.select("text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("seen"))


def prefixes(documents: DataFrame, items: DataFrame, most_bits: int) -> DataFrame:
    """window, n, items, and its rarest shingle: h, its offset (before), its size."""
    every = durable(windows(items), "windows")
    parts = every.select("window", "n", F.posexplode("hashes").alias("before", "h"))
    sizes = _sizes(every)
    seen = count_shingles(documents, Bitmap(parts.select("h").distinct(), most_bits), sizes)
    rarest = (
        parts.join(seen, "h", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "before")).alias("r"))
        .select("window", "r.h", "r.before")
    )
    return durable(every.drop("hashes").join(rarest, "window"), "prefixes")


def _sizes(found: DataFrame) -> list[int]:
    """Sizes of the shingles of these windows: SHINGLE at most."""
    return sorted(r["s"] for r in found.select(F.least("n", F.lit(SHINGLE)).alias("s")).distinct().collect())


def _print() -> Column:
    return F.xxhash64("text")


def candidates(documents: DataFrame, found: DataFrame, most_bits: int) -> DataFrame:
    """doc_id, print (hash of the text), n_words, and places of prefix shingles: hash, words around, how many of these
    come first, and where (places with the same words around are one entry)."""
    sizes = _sizes(found)
    sent = documents.sparkSession.sparkContext.broadcast(Bitmap(found.select("h").distinct(), most_bits))  # MOST_BITS at most

    def places(words: list[bytes]) -> list[dict]:
        out: dict[tuple, list[int]] = {}
        for size in sizes:
            h = shingle_hashes(words, size)
            back, ahead = (WINDOW - SHINGLE, WINDOW) if size == SHINGLE else (0, size)
            for i in np.flatnonzero(sent.value.holds(h)).tolist():
                a = max(0, i - back)
                out.setdefault((int(h[i]), b" ".join(words[a : i + ahead]), i - a), []).append(i)
        return [{"h": h, "around": around.decode(), "lead": lead, "at": at} for (h, around, lead), at in out.items()]

    kind = pa.list_(pa.struct([("h", pa.int64()), ("around", pa.string()), ("lead", pa.int32()), ("at", pa.list_(pa.int32()))]))

    def run(batches):
        for b in batches:
            rows = [plain_words(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("print"), pa.array(list(map(len, rows)), pa.int64()), pa.array([places(w) for w in rows], kind)],
                names=["doc_id", "print", "n_words", "places"],
            )

    rows = documents.select("doc_id", _print().alias("print"), "text")
    return map_arrow(
        rows, run, f"doc_id {dict(documents.dtypes)['doc_id']}, print long, n_words long, places array<struct<h:long,around:string,lead:int,at:array<int>>>"
    )


def _covered(spans: Column) -> Column:
    """Words inside any of the spans (first word, word after the last)."""
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))

    def step(a: Column, s: Column) -> Column:
        more = F.greatest(s["z"] - F.greatest(s["a"], a["end"]), F.lit(0))
        return F.struct((a["hit"] + more).alias("hit"), F.greatest(a["end"], s["z"]).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["hit"].cast("long"))


def _hits(placed: DataFrame, found: DataFrame) -> DataFrame:
    """d, p (a document's id and print), n_hit, items of each document in which a window stands."""
    one = placed.select("doc_id", "print", F.explode("places").alias("x")).select("doc_id", "print", "x.*")
    start = F.col("lead") - F.col("before")
    words = F.split("around", " ")
    fits = (start >= 0) & (F.size(words) >= start + F.col("n"))
    same = F.when(fits, F.array_join(F.slice(words, start + 1, F.col("n")), " ") == F.col("window"))
    spans = F.transform("at", lambda i: F.struct((i - F.col("before")).alias("a"), (i - F.col("before") + F.col("n")).alias("z")))
    return (
        one.join(found, "h")
        .where(same)
        .select("doc_id", "print", spans.alias("spans"), "items")
        .groupBy(F.col("doc_id").alias("d"), F.col("print").alias("p"))
        .agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select("d", "p", _covered(F.col("spans")).alias("n_hit"), "items")
    )


def _bad() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def judged(documents: DataFrame, benchmark: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, print, n_words, n_hit, items, one row a row of documents."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    found = prefixes(documents, items, most_bits)
    placed = durable(candidates(documents, found, most_bits), "places")
    met = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p"))
    none = F.array().cast("array<string>")
    return placed.join(_hits(placed, found), met, "left").select(
        "doc_id", "print", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items")
    )


def scan(documents: DataFrame, benchmark: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids, sorted as strings), items_sha256, contaminated."""
    return judged(documents, benchmark, most_bits).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        _bad().alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = judged(documents, benchmark, most_bits).where(_bad()).select("doc_id", "print").distinct()
    own = fresh(documents, "text_print")
    bad = bad.toDF(f"{own}_id", f"{own}_hash")
    same = F.col("doc_id").eqNullSafe(F.col(f"{own}_id")) & (F.col(own) == F.col(f"{own}_hash"))
    return documents.withColumn(own, _print()).join(bad, same, "left_anti").drop(own)
