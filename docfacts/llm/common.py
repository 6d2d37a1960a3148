"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import durable, shared_dir, spread

__all__ = ["durable", "shared_dir", "table"]

#: Rows an Arrow batch may hold. Texts are long, so batches are kept small.
BATCH_ROWS = 200

#: A-Z to a-z; every ASCII byte that is neither a letter nor a digit to a space; bytes over 0x7F stay.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is stored; texts and pages are dealt out where they come in fewer pieces than there are cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, unless the session sets its own bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, name, n = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def id_fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def labelled_sample(labels: DataFrame, most_rows: int) -> DataFrame:
    """doc_id and quality of at most most_rows labelled ids, chosen by hash. Rows without a label or an id are left out,
    of several labels of an id the smallest counts. A hash threshold thins a large table before the rows are ordered, so
    what meets in one place is about most_rows whatever the table's size."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = marked.count()
    if n > most_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1.1e6 * most_rows / n) + 1)
    return marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)


#: Bits of a bitmap for each value it holds, as long as there are few.
BITS_EACH = 64


class Bitmap:
    """Which hashes (a column h) may be among those given; bounded, so wrong (as yes, never as no) the more often the more there are."""

    def __init__(self, hashes: DataFrame, most_bits: int) -> None:
        n = hashes.count()
        self.bits = min(most_bits, 1 << max(16, (BITS_EACH * n - 1).bit_length()))
        at = F.pmod("h", F.lit(self.bits)) + 1  # Spark's bitmaps count from 1
        parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        self.raw = np.zeros(self.bits // 8, np.uint8)
        for r in parts.collect():
            own = np.frombuffer(bytes(r["bits"]), np.uint8)
            start = (r["part"] - 1) * len(own)
            self.raw[start : start + len(own)] = own[: len(self.raw) - start]

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.raw[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words: ASCII letters and digits and all characters beyond ASCII."""
    return text.encode("utf-8", "replace").translate(WORD_TABLE).split()
