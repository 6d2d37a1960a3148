"""Exact deduplication with DataFrame functions only: group by a 128-bit hash of the content, then compare bytes.

Texts are equal when they are identical after lower-casing A-Z. Rows are grouped by a 128-bit hash of that form; the
bytes behind each hash are then compared in Spark, by grouping whole texts under their hash. Each task sends a text once,
however many copies it has read, so a group of copies that holds a third of all rows is a row for each task. Where a hash
covers more than one text (a collision), its texts are numbered and make groups of their own. Groups are counted and
joined back by hash; the join has one row a group on one side, so Spark may split the other where a group is large.

A null text counts as the empty one. A null id never stays where the group has another; in a group without ids one row
stays and keep_id is null. Of repeated rows (same id and text) one stays. An empty table gives an empty result, further
columns are left alone, and very long texts are hashed and compared whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def content_hash(content: Column) -> Column:
    """128 bits of MD5."""
    return F.unhex(F.md5(content))


def collisions(contents: DataFrame) -> DataFrame:
    """h, content, class: the texts of hashes that cover several, numbered from 1 in their order. contents: h, content."""
    distinct = contents.groupBy("h", "content").agg(F.lit(1).alias("one"))
    odd = distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    found = durable(odd, "collisions")
    if found.isEmpty():
        return found.select("h", F.lit("").alias("content"), F.lit(1).alias("class"))
    number = F.row_number().over(Window.partitionBy("h").orderBy("content"))
    return durable(distinct.join(found, "h").select("h", "content", number.alias("class")), "classes")


def groups(documents: DataFrame, largest: bool = False, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row a document, dropped ones too. Of equal texts the row with
    the smallest doc_id stays, or with `largest` that with the largest. digest: another content hash."""
    contents = documents.select("doc_id", normalised(F.col("text")).alias("content"))
    contents = contents.withColumn("h", digest(F.col("content")))
    known = collisions(contents.select("h", "content"))
    rows = contents.withColumn("class", F.lit(0)) if known.isEmpty() else contents.join(known, ["h", "content"], "left")
    rows = durable(
        rows.select(
            "doc_id", "h", F.coalesce("class", F.lit(0)).alias("class"), F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "hashed",
    )
    best, by = (F.max, F.max_by) if largest else (F.min, F.min_by)
    sizes = rows.groupBy("h", "class").agg(
        best("doc_id").alias("keep_id"),
        F.count("*").alias("group_size"),
        F.coalesce(by("row_no", "doc_id"), F.min("row_no")).alias("keep_row"),
    )
    # stored, so that both sides of the join are shuffled for it and Spark may split the rows of a large group
    return rows.join(durable(sizes, "groups"), ["h", "class"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
