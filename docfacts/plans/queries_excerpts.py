"""Queries over excerpts: what shares most words or numbers with a question, among all texts and among its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verify
from .catalog import query, table
from .queries_text import J

_NUMBERS = f"t AS (SELECT doc_id, {J.format(J.format(J.format('text')))} AS t FROM documents), w AS (SELECT DISTINCT doc_id AS id, replace(x, ',', '') AS term FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\\d[\\d,]*(?:\\.\\d+)?')) AS x FROM t))"
_WORDS = "w AS (SELECT id, term FROM (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS term FROM documents) WHERE regexp_full_match(term, '[a-z]{4,}'))"


def _most(terms: str) -> str:
    return f"""WITH {terms}, j AS (SELECT q.id AS query_id, e.id AS excerpt_no, count(*) AS overlap FROM w q JOIN w e USING (term) WHERE q.id % 20 = 0 AND q.id <> e.id GROUP BY ALL)
    SELECT query_id, excerpt_no, overlap FROM j QUALIFY overlap = max(overlap) OVER (PARTITION BY query_id)"""


def _sharing(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    asked = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), F.col("doc_id").alias("leave_out"))
    return verify.most_shared(asked, d.select(F.col("doc_id").alias("excerpt_no"), F.col("text").alias("content")), by)


@query(_most(_WORDS))
def documents_sharing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the documents that share most words with each twentieth one."""
    return _sharing(spark, sf_dir, "words")


@query(_most(_NUMBERS))
def documents_sharing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the documents that share most numbers with each twentieth one."""
    return _sharing(spark, sf_dir, "numbers")


def _own(split: str, digits: str) -> str:
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || (conv_id + turn) % 7 || ' and ' || conv_id % 5 AS t FROM conversations),
    w AS (SELECT conv_id, turn, list_distinct(list_filter({split}, lambda x: regexp_full_match(x, '{digits}'))) AS w FROM c)
    SELECT q.conv_id, CAST(e.turn AS INTEGER) AS turn, CAST(len(list_intersect(q.w, e.w)) AS BIGINT) AS overlap FROM w q JOIN w e USING (conv_id) WHERE q.turn = 0 AND e.turn > 0
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, CASE WHEN e.turn % 4 > 0 THEN e.turn * 7 % 10 END DESC NULLS LAST, e.turn) = 1"""


def _own_excerpts(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    turn, conv = F.col("turn"), F.col("conv_id")
    text = F.concat_ws(" ", F.coalesce("text", F.lit("")), ((conv + turn) % 7).cast("string"), F.lit("and"), (conv % 5).cast("string"))
    c = table(spark, sf_dir, "conversations").select(conv.alias("query_id"), turn.cast("int").alias("excerpt_no"), text.alias("content"))
    similarity = F.when(F.col("excerpt_no") % 4 > 0, F.col("excerpt_no") * 7 % 10 / 10)
    asked = c.where("excerpt_no = 0").select("query_id", F.col("content").alias("query"))
    best = verify.best_excerpt(asked, c.where("excerpt_no > 0").withColumn("similarity", similarity), by)
    return best.select(F.col("query_id").alias("conv_id"), F.col("excerpt_no").alias("turn"), F.col("overlap").cast("long").alias("overlap"))


@query(_own("regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}_]+')", "[a-z]{4,}"))
def own_excerpts_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of the turns of a conversation the one that shares most words with its first; then by similarity."""
    return _own_excerpts(spark, sf_dir, "words")


@query(_own(f"list_transform(regexp_extract_all({J.format(J.format(J.format('t')))}, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: replace(x, ',', ''))", ".*"))
def own_excerpts_by_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the same by numbers."""
    return _own_excerpts(spark, sf_dir, "numbers")
