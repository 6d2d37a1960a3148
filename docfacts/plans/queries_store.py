"""Queries over tables that are written in place, partition by partition or batch by batch, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, structure
from ..sources import tables as src
from ..sources.stages import shared_dir
from ..sources.store import Store
from .catalog import query, table
from .queries_text import PAGED


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docfacts-{name}-{uuid.uuid4().hex}"


@query(f"WITH {PAGED} SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS lines, CAST(sum(length(array_to_string(w, ' '))) AS BIGINT) AS size FROM paged GROUP BY doc_id")
def bucketed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept in buckets by document; their lines and what is counted over them need no shuffle of words."""
    name = f"docfacts_words_{uuid.uuid4().hex}"
    src.save_text_words(table(spark, sf_dir, "documents"), name, place(spark, "words"), buckets=16)
    lines = structure.visual_lines(spark.table(name))
    return lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("lines"), F.sum(F.length("text")).alias("size"))


@query(
    """WITH u AS (SELECT o_orderkey, o_orderstatus, 'changed' AS o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0
      UNION ALL SELECT o_orderkey, 'F', o_orderpriority FROM orders WHERE o_orderstatus = 'P'
      UNION ALL SELECT -o_orderkey, 'N', o_orderpriority FROM orders WHERE o_orderkey > 0 AND o_orderkey % 100 = 0)
    SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u) UNION ALL SELECT * FROM u"""
)
def merged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: a table in folders by status is merged in place: rows change, move to another folder (one becomes empty), and
    come anew; it is read back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    s = Store(spark, place(spark, "orders"), o.withColumn("at", F.lit(0)).schema, ["o_orderstatus"])
    s.upsert(o.withColumn("at", F.lit(0)), ["o_orderkey"])
    changed = o.where("o_orderstatus = 'F' and o_orderkey % 5 = 0")
    up = changed.withColumn("at", F.lit(1)).unionByName(changed.withColumns({"o_orderpriority": F.lit("changed"), "at": F.lit(2)}))
    moved = o.where("o_orderstatus = 'P'").withColumns({"o_orderstatus": F.lit("F"), "at": F.lit(1)})
    new = o.where("o_orderkey > 0 and o_orderkey % 100 = 0").withColumns({"o_orderkey": -F.col("o_orderkey"), "o_orderstatus": F.lit("N"), "at": F.lit(1)})
    s.upsert(up.unionByName(moved).unionByName(new), ["o_orderkey"], "at")
    return s.read().drop("at")


@query(
    """SELECT l_returnflag, l_linestatus, l_orderkey % 4 AS part, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem
    WHERE NOT (l_returnflag = 'R' AND l_linestatus LIKE 'F%') AND NOT (l_returnflag = 'N' AND l_orderkey % 4 = 1) GROUP BY ALL
    UNION ALL SELECT l_returnflag, l_linestatus, l_orderkey % 4, count(*), CAST(sum(l_linenumber + 100) AS BIGINT) FROM lineitem WHERE l_returnflag = 'N' AND l_orderkey % 4 = 1 GROUP BY ALL"""
)
def reloaded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole folders and parts of folders are deleted in place; one part is loaded again."""
    columns = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    rows = table(spark, sf_dir, "lineitem").select(*columns, (F.col("l_orderkey") % 4).cast("int").alias("part"))
    s = Store(spark, place(spark, "lines"), rows.schema, ["l_returnflag", "part"])
    keys = ["l_returnflag", "part", "l_orderkey", "l_linenumber"]
    s.upsert(rows, keys)
    s.delete("l_returnflag = 'R' and l_linestatus like 'F%'")
    s.delete("l_returnflag = 'N' and part = 1")
    s.upsert(rows.where("l_returnflag = 'N' and part = 1").withColumn("l_linenumber", F.col("l_linenumber") + 100), keys)
    return s.read().groupBy("l_returnflag", "l_linestatus", F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query(
    """WITH n AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR) || ' ' || o_orderstatus || ' ' || o_orderpriority AS t FROM orders)
    SELECT CAST(o_custkey AS VARCHAR) AS scope_id, o_orderstatus AS subsection, o_orderpriority AS label, CAST(CASE WHEN o_custkey % 3 > 0 THEN 1 ELSE 2 END AS BIGINT) AS run,
      CAST(length(t) AS BIGINT) AS size, CAST(length(t) - length(replace(t, '1', '')) AS BIGINT) AS ones FROM n WHERE o_custkey % 10 <> 7"""
)
def embedded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts are embedded into a table in batches; a second run over all of them asks only for those that the
    first one has not written. The vector says which run made it; what has no vector is not there."""
    text = F.concat_ws(" ", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    o = table(spark, sf_dir, "orders").select(
        F.lit("AD").alias("scope_kind"), F.col("o_custkey").cast("string").alias("scope_id"), F.col("o_orderstatus").alias("subsection"),
        F.lit("").alias("entity"), F.col("o_orderpriority").alias("label"), text.alias("fact_text"),
    )
    every = o.distinct()
    path = place(spark, "vectors")

    def embed(run: int):
        return lambda texts: [None if t.split(" ")[0].endswith("7") else [float(run), float(len(t)), float(t.count("1"))] for t in texts]

    facts.embed_into(every.where("cast(scope_id as bigint) % 3 > 0"), path, embed(1), 100, 1 << 20)
    got = facts.embed_into(every, path, embed(2), 100, 1 << 20)
    return got.select("scope_id", "subsection", "label", *[F.get("embedding", F.lit(i)).cast("long").alias(c) for i, c in enumerate(("run", "size", "ones"))])
