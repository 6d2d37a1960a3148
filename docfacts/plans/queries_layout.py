"""Queries over the geometry of words: rows, columns and regions, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import extract
from .catalog import query, table

Place = tuple[float | Column, float | Column, str | Column]


def positioned(df: DataFrame, doc: Column, page: Column, places: list[Place]) -> DataFrame:
    """Words of sections: for each row of df one word at each place (x0, top, text); blank ones are left out. A word is
    six points wide a character."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    one = F.array(*[F.struct(as_column(x).cast("double").alias("x0"), as_column(y).cast("double").alias("top"), as_column(t).cast("string").alias("text"), F.lit(i).alias("i")) for i, (x, y, t) in enumerate(places)])
    w = df.select(doc.alias("doc_id"), F.lit("X").alias("scope_id"), F.lit("2.3").alias("subsection"), page.cast("int").alias("page"), F.col("nth"), F.explode(one).alias("w")).where("w.text is not null and w.text <> ''")
    return w.select("doc_id", "scope_id", "subsection", "page", (F.col("nth") * 100 + F.col("w.i")).cast("int").alias("word_no"), "w.x0", "w.top", (F.col("w.x0") + 6 * F.length("w.text")).alias("x1"), "w.text")


def numbered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their number (nth, from 0) among those of their brand."""
    return table(spark, sf_dir, "part").withColumn("nth", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)


PARTS = "n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS nth FROM part)"


def label_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form of twenty numbered rows a page: label and value on both sides of a gutter, two lines each, words of a line
    up to two points apart."""
    n, s = F.col("nth"), F.col("p_size")
    y = 50 + (n % 20) * 30
    word = lambda k: F.split("p_name", " ")[k]
    places = [(60, y, (n % 99 + 1).cast("string")), (110, y + s % 3, F.col("p_type")), (350, y + 2 - s % 3, word(0)), (420, y, word(1)), (112, y + 12, "of"), (352, y + 12, s.cast("string"))]
    return positioned(numbered_parts(spark, sf_dir), F.col("p_brand"), F.floor(n / 20) + 1, places)


@query(f"WITH {PARTS} SELECT p_brand AS doc_id, CAST(nth AS INT) AS row_no, CAST(nth % 99 + 1 AS VARCHAR) AS number, p_type || ' of' AS label, p_name || ' ' || p_size AS value FROM n")
def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered rows, their words by the side of the gutter."""
    return extract.label_value_rows(label_words(spark, sf_dir)).select("doc_id", "row_no", "number", "label", "value")


@query(f"WITH {PARTS} SELECT p_brand AS doc_id, CAST(nth AS INT) AS row_no, p_type || ' ' || p_name || ' of ' || p_size AS value FROM n")
def plain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered rows as one value each."""
    return extract.full_rows(label_words(spark, sf_dir)).select("doc_id", "row_no", "value")


@query(
    f"""WITH {PARTS} SELECT p_brand AS doc_id, CAST(nth + 1 AS BIGINT) AS row_no, lpad(CAST(p_size % 36 + 1 AS VARCHAR), 2, '0') || CASE WHEN p_size % 2 = 0 THEN 'L' ELSE '' END AS runway, CAST(1000 + p_size AS INT) AS tora_m, CAST(p_size * 10 AS INT) AS toda_m,
      CASE WHEN p_size % 3 > 0 THEN CAST(700 + p_size AS INT) END AS asda_m, CASE WHEN p_size % 4 > 0 THEN CAST(2000 + p_size AS INT) END AS lda_m, CASE WHEN p_size % 5 > 0 THEN p_name END AS remarks FROM n WHERE p_brand <> 'Brand#7'"""
)
def distance_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared distances under their headers; a section without all headers has no records."""
    p, n, s = numbered_parts(spark, sf_dir), F.col("nth"), F.col("p_size")
    y, word = 100 + n * 20, lambda k: F.when(s % 5 > 0, F.split("p_name", " ")[k])
    thousands = F.lpad(s.cast("string"), 3, "0")
    places = [
        (50, y, F.concat(F.lpad((s % 36 + 1).cast("string"), 2, "0"), F.when(s % 2 == 0, "L").otherwise(""))), (150, y, "1"), (160, y, thousands), (200, y, (s * 10).cast("string")), (250, y, F.when(s % 3 > 0, (700 + s).cast("string")).otherwise("NIL")),
        (296, y, F.when(s % 4 > 0, "2")), (306, y, F.when(s % 4 > 0, thousands)), (340, y, word(0)), (400, y, word(1)),
    ]
    w = positioned(p, F.col("p_brand"), F.lit(1), places)
    heads = p.where("nth = 0").withColumn("nth", F.lit(-1))
    h = positioned(heads, F.col("p_brand"), F.lit(1), [(150, 40, "TORA"), (200, 40, "TODA"), (250, 40, "ASDA"), (300, 40, "LDA"), (360, 40, F.when(F.col("p_brand") != "Brand#7", "Remarks").otherwise("Notes"))])
    return extract.columns_by_header_x(w.unionByName(h)).select("doc_id", F.col("row_no").cast("long").alias("row_no"), "runway", "tora_m", "toda_m", "asda_m", "lda_m", "remarks")


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS row_key, unnest(['18L', '36R']) AS runway, unnest(['3' || lpad(CAST(p_size AS VARCHAR), 3, '0'), '900']) AS tora, unnest([CAST(p_size AS VARCHAR), '1000.5']) AS lda FROM part WHERE p_size % 3 > 0"""
)
def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: cells with as many numbers as there are runways; other rows are left out."""
    s = F.col("p_size")
    three = F.lpad(s.cast("string"), 3, "0")
    r = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_key"), F.lit("RWY 18L and 36R").alias("runways"), F.concat(F.lit("3 "), three, F.lit(" / 900")).alias("tora"), F.when(s % 3 > 0, "1 2").otherwise("1").alias("toda"), F.lit("7 8").alias("asda"), F.concat_ws(" m ", s, F.lit("1000.5")).alias("lda")
    )
    return extract.count_aligned_rows(r).select("row_key", "runway", "tora", "lda")


CUSTOMERS = "n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS nth FROM customer)"


def numbered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("nth", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1)


@query(
    f"""WITH {CUSTOMERS} SELECT c_nationkey AS doc_id, CAST(nth AS INT) AS row_no, c_mktsegment || ' | ' || c_name || ' | x' || c_custkey || ' of' || CASE WHEN c_custkey % 4 > 0 THEN ' | lit' ELSE '' END AS text FROM n WHERE c_nationkey % 5 > 0
    UNION ALL SELECT c_nationkey, 0, 'Obstacle ' || string_agg(c_mktsegment || ' ' || c_name || ' x' || c_custkey || CASE WHEN c_custkey % 4 > 0 THEN ' lit' ELSE '' END || ' of', ' ' ORDER BY nth) FROM n WHERE c_nationkey % 5 = 0 GROUP BY c_nationkey"""
)
def marked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns by lettered markers; a section without them is one plain row."""
    c, n, k = numbered_customers(spark, sf_dir), F.col("nth"), F.col("c_custkey")
    y = 100 + n * 20
    w = positioned(c, F.col("c_nationkey"), F.lit(1), [(50, y, F.col("c_mktsegment")), (150, y, F.col("c_name")), (300, y, F.concat(F.lit("x"), k)), (302, y + 8, "of"), (400, y, F.when(k % 4 > 0, "lit"))])
    heads = c.where("nth = 0").withColumn("nth", F.lit(-1))
    marks = [(x, 60 + i % 2, F.when(F.col("c_nationkey") % 5 > 0, m)) for i, (x, m) in enumerate(((50, "a"), (150, "b"), (300, "c"), (400, "d")))]
    h = positioned(heads, F.col("c_nationkey"), F.lit(1), [(152, 40, "Obstacle"), *marks])
    return extract.marker_row_tables(w.unionByName(h)).select("doc_id", "row_no", "text")


@query(
    f"""WITH {CUSTOMERS}, o AS (SELECT *, nth % 2 AS side FROM n)
    SELECT c_nationkey AS doc_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY side, nth) AS BIGINT) AS row_no, CAST(nth + 1 AS VARCHAR) AS number, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' and more' ELSE '' END AS label, CASE WHEN c_custkey % 3 > 0 THEN c_name || ' end' END AS value FROM o"""
)
def column_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered items of two columns, the left one first; a short line in lower case goes on with the label."""
    c, n, k = numbered_customers(spark, sf_dir), F.col("nth"), F.col("c_custkey")
    x, y = F.when(n % 2 == 0, 40).otherwise(360), 100 + F.floor(n / 2) * 45
    places = [(x, y, F.concat(F.lit("2.20."), n + 1)), (x + 50, y, F.col("c_mktsegment")), (x, y + 12, F.when(k % 2 == 0, "and")), (x + 30, y + 12, F.when(k % 2 == 0, "more")), (x, y + 24, F.when(k % 3 > 0, F.col("c_name"))), (x, y + 36, F.when(k % 3 > 0, "end"))]
    w = positioned(c, F.col("c_nationkey"), F.lit(1), places)
    return extract.two_column_items(w).select("doc_id", F.col("row_no").cast("long").alias("row_no"), "number", "label", "value")


@query(
    f"""WITH {CUSTOMERS} SELECT c_nationkey AS doc_id, CASE WHEN c_nationkey % 2 = 0 THEN string_agg(c_mktsegment || ' ' || nth, ' ' ORDER BY nth) || ' ' || string_agg(c_name, ' ' ORDER BY nth) ELSE string_agg(c_mktsegment || ' ' || nth || ' ' || c_name, ' ' ORDER BY nth) END AS text FROM n GROUP BY c_nationkey"""
)
def read_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: left of a clean corridor, then right of it; without a corridor line by line. Title lines are dropped."""
    c, n, d = numbered_customers(spark, sf_dir), F.col("nth"), F.col("c_nationkey")
    y = 100 + n * 20
    x = F.when(d % 2 == 0, 300).otherwise(172)
    w = positioned(c, d, F.lit(1), [(40, y, F.col("c_mktsegment")), (130, y + n % 3, n.cast("string")), (x, y, F.col("c_name"))])
    h = positioned(c.where("nth = 0").withColumn("nth", F.lit(-1)), d, F.lit(1), [(100, 40, "Additional"), (180, 40, "INFORMATION"), (270, 42, "page")])
    wide = positioned(c.where("c_nationkey % 2 = 1 and nth = 0").withColumn("nth", F.lit(-2)), d, F.lit(1), [(100, 40, "Additional" * 5)])
    return extract.region_read(w.unionByName(h).unionByName(wide), "Additional").select("doc_id", "text")


@query(
    f"""WITH {CUSTOMERS}, l AS (SELECT c_nationkey AS d, nth // 30 + 1 AS page, nth, rpad(c_mktsegment, 20, ' ') || c_name AS a, 'right ' || c_custkey AS b FROM n),
    g AS (SELECT d, page, string_agg(a, chr(10) ORDER BY nth) AS a, string_agg(b, chr(10) ORDER BY nth) AS b FROM l GROUP BY d, page)
    SELECT d AS doc_id, CAST(page AS INT) AS page, CASE WHEN d % 2 = 0 THEN a || chr(10) || b ELSE a END AS text FROM g"""
)
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their words at their columns, two regions where the middle is clear."""
    c, n, d = numbered_customers(spark, sf_dir), F.col("nth"), F.col("c_nationkey")
    y = 60 + (n % 30) * 12
    right = F.when(d % 2 == 0, F.concat_ws(" ", F.lit("right"), F.col("c_custkey")))
    w = positioned(c, d, F.floor(n / 30) + 1, [(10, y, F.col("c_mktsegment")), (10 + 3.1 * 20, y + n % 2, F.col("c_name")), (330, y, right)])
    return extract.layout_render(w).select("doc_id", "page", "text")

