"""Queries over documents, pages of lines, and derived records, each beside the SQL it must equal."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.profile import AIP
from ..functions.text import number_set
from ..operators import charts, chunks, extract, facts, structure
from ..sources import tables as src
from ..sources.stages import spread
from .catalog import query, table

LINES = "lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
PAGED = f"{LINES}, paged AS (SELECT doc_id, CAST(line_no // 40 + 1 AS INT) AS page, line_no, regexp_split_to_array(trim(text), '\\s+') AS w FROM lines WHERE trim(text) <> '')"
#: Lines as pages: every event of a user is a page.
EVENT_PAGES = "pages AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, event_type, event_id, ts FROM events)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.words_from_text(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("doc_id"), n.alias("page"), "event_type", "event_id", "ts")


@query(
    f"""WITH {LINES}, f AS (
      SELECT d.lang AS scope_kind, CAST(l.doc_id AS VARCHAR) AS scope_id, string_split(trim(l.text), ' ')[1] AS label, trim(l.text) AS v, l.line_no AS seq
      FROM lines l JOIN documents d USING (doc_id) WHERE trim(l.text) <> '' AND d.lang IS NOT NULL),
    g AS (SELECT scope_kind, scope_id, label, v, min(seq) AS seq FROM f GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_id, label ORDER BY seq, v) AS n, count(*) OVER (PARTITION BY scope_kind, scope_id, label) AS c FROM g)
    SELECT scope_kind, scope_id, '1' AS subsection, CASE WHEN c > 1 THEN 'item ' || n ELSE '' END AS entity, label, v AS fact_value,
      CASE WHEN c > 1 THEN scope_id || '. Item ' || n || '. ' || label || ': ' || v ELSE scope_id || '. ' || label || ': ' || v END AS fact_text, CAST(seq AS BIGINT) AS seq FROM n"""
)
def heading_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document is a fact under its first word, made unique."""
    d = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang", "text")
    lines = d.select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    label = F.split("line", " ")[0]
    sid = F.col("doc_id").cast("string")
    rows = lines.select(
        F.col("lang").alias("scope_kind"), sid.alias("scope_id"), F.lit("1").alias("subsection"), F.lit("").alias("entity"), label.alias("label"), F.col("line").alias("fact_value"),
        F.concat(sid, F.lit(". "), label, F.lit(": "), F.col("line")).alias("fact_text"), F.col("line_no").cast("long").alias("seq"),
    )
    return facts.dedupe_facts(rows).select("scope_kind", "scope_id", "subsection", "entity", "label", "fact_value", "fact_text", "seq")


@query(
    f"""WITH {PAGED} SELECT doc_id, page, CAST(sum(len(w)) AS BIGINT) AS n_words, count(*) AS n_lines, CAST(max(length(array_to_string(w, ' ')) * 6) AS BIGINT) AS right_edge FROM paged GROUP BY doc_id, page"""
)
def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: positioned words of plain text, summed up by page."""
    return words(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("n_words"), F.count_distinct("line_no").alias("n_lines"), F.max("x1").cast("long").alias("right_edge"))


@query(f"""WITH {PAGED} SELECT doc_id, page, CAST((line_no % 40) * 4 + 7 AS INT) AS line, array_to_string(w, ' ') AS text FROM paged""")
def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words back to visual lines."""
    return structure.visual_lines(words(spark, sf_dir)).select("doc_id", "page", "line", "text")


@query(f"""WITH {PAGED} SELECT doc_id, page, array_to_string(list_concat([''], flatten(list(w ORDER BY line_no))), ' ')[2:] AS text FROM paged GROUP BY doc_id, page""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6 (first step): words of a page joined in order."""
    return structure.page_text(words(spark, sf_dir)).select("doc_id", "page", "text")


@query(
    f"""WITH RECURSIVE {PAGED}, w AS (SELECT doc_id, page, line_no, w, unnest(range(1, len(w) + 1)) AS i FROM paged), x AS (SELECT doc_id, page, w[i] AS word, i - 1 AS no, length(array_to_string(w[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS x0, (line_no % 40) * 12 + 20 + (i - 1) % 4 * 2 AS top FROM w),
    t AS (SELECT doc_id, page, top, row_number() OVER (PARTITION BY doc_id, page ORDER BY top) AS n FROM (SELECT DISTINCT doc_id, page, top FROM x)),
    r AS (SELECT doc_id, page, top, n, top AS start, 0 AS line FROM t WHERE n = 1 UNION ALL SELECT t.doc_id, t.page, t.top, t.n, CASE WHEN t.top - r.start <= 4 THEN r.start ELSE t.top END, CASE WHEN t.top - r.start <= 4 THEN r.line ELSE r.line + 1 END FROM r JOIN t ON t.doc_id = r.doc_id AND t.page = r.page AND t.n = r.n + 1)
    SELECT doc_id, page, CAST(line AS BIGINT) AS line, string_agg(word, ' ' ORDER BY x0, no) AS text FROM x JOIN r USING (doc_id, page, top) GROUP BY ALL"""
)
def reading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of words near the first word of their line; every word is set down up to six points."""
    w = words(spark, sf_dir).withColumn("top", F.col("top") + F.col("word_no") % 4 * 2)
    return structure.reading_lines(w, joined=True)


@query(
    f"""WITH {LINES}, l AS (SELECT doc_id, line_no, text, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b(the|and|of|de|la|le)\\b', '', 'g'), '[.,!]', '', 'g'), '\\b[A-Z][a-z]+\\b', '', 'g') AS r FROM lines)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, text FROM l WHERE trim(r) <> ''"""
)
def lines_without_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line goes only if nothing but furniture is on it."""
    profile = replace(AIP, chrome=(r"(?i)\b(the|and|of|de|la|le)\b", r"[.,!]", r"\b[A-Z][a-z]+\b"))
    return structure.drop_chrome(src.text_lines(table(spark, sf_dir, "documents")), profile)


@query(
    f"""WITH {LINES}, p AS (SELECT doc_id, CAST(line_no // 40 + 1 AS INT) AS page, (line_no % 40) * 12.0 + 20 AS top, text FROM lines WHERE trim(text) <> ''),
    b AS (SELECT *, coalesce(max(CASE WHEN starts_with(text, 'T') THEN top END) OVER w, -1e9) AS lo, coalesce(min(CASE WHEN starts_with(text, 'A') THEN top END) OVER w, 1e9) AS hi FROM p WINDOW w AS (PARTITION BY doc_id, page))
    SELECT doc_id, page, CAST(top AS DOUBLE) AS top, text FROM b WHERE top >= lo - 2 AND top < hi - 2"""
)
def band_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of a page between its last start header and its first end header."""
    lines = src.text_lines(table(spark, sf_dir, "documents")).where("trim(text) <> ''")
    p = lines.select("doc_id", (F.floor(F.col("line_no") / 40) + 1).cast("int").alias("page"), ((F.col("line_no") % 40) * 12.0 + 20).cast("double").alias("top"), "text")
    return structure.band_slice(p, "^T", "^A")


@query(
    f"""WITH {EVENT_PAGES}, k AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS c FROM pages),
    m AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM k)
    SELECT doc_id, CAST(page AS INT) AS page, b AS section_id FROM m WHERE event_type = 'error' AND a = b"""
)
def sandwiched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown pages between two pages of one section."""
    p = event_pages(spark, sf_dir)
    unknown = F.col("event_type") == "error"
    return structure.sandwiched_unknown(p.select("doc_id", "page", F.when(unknown, "UNKNOWN").otherwise("AD_CONTENT").alias("category"), F.when(~unknown, F.col("event_type")).alias("section_id")))


@query("SELECT event_type AS category, count(*) AS n FROM events GROUP BY event_type")
def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by category."""
    return structure.page_manifest(event_pages(spark, sf_dir).withColumnRenamed("event_type", "category"))


@query(
    """SELECT c_custkey AS section_id, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
    UNION ALL SELECT DISTINCT o_custkey + 1, 'unexpected' FROM orders WHERE o_custkey + 1 NOT IN (SELECT c_custkey FROM customer) AND o_custkey IS NOT NULL"""
)
def manifest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected ids that are missing, and unexpected ones."""
    o = table(spark, sf_dir, "orders")
    held = o.select(F.col("o_custkey").alias("section_id")).unionByName(o.select((F.col("o_custkey") + 1).alias("section_id")).where("section_id > 0"))
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("section_id"))
    missing = structure.manifest_completeness(o.select(F.col("o_custkey").alias("section_id")), expected).where("problem = 'missing'")
    return missing.unionByName(structure.manifest_completeness(held, expected).where("problem = 'unexpected'"))


@query(
    """WITH p AS (SELECT o_custkey % 25 AS doc_id, CAST(month(o_orderdate) AS INT) AS page FROM orders),
    s AS (SELECT CAST(n_nationkey AS BIGINT) AS doc_id, unnest([1, 2, 3]) AS seq, unnest(['S1', 'S2', 'S3']) AS section_id, unnest([1, 3, 9]) AS a, unnest([4, 7, 10]) + n_nationkey % 2 AS z FROM nation),
    h AS (SELECT p.doc_id, p.page, min_by(s.section_id, s.seq) AS section_id FROM (SELECT DISTINCT * FROM p) p LEFT JOIN s ON p.doc_id = s.doc_id AND p.page BETWEEN s.a AND s.z GROUP BY ALL)
    SELECT doc_id, page, section_id, count(*) AS n FROM p JOIN h USING (doc_id, page) GROUP BY ALL"""
)
def range_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: pages to the first section whose range holds them."""
    pages = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("doc_id"), F.month("o_orderdate").alias("page"))
    odd = F.col("n_nationkey") % 2
    each = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(f"S{i}").alias("section_id"), F.lit(a).alias("start_page"), (F.lit(z) + odd).alias("end_page")) for i, a, z in ((1, 1, 4), (2, 3, 7), (3, 9, 10))])
    sections = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.explode(each).alias("s")).select("doc_id", "s.*", F.lit("standard").alias("kind"))
    return structure.assign_section(pages, sections).groupBy("doc_id", "page", "section_id").agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT o_custkey % 20 AS doc_id, o_orderkey AS page FROM orders), s AS (SELECT c_custkey % 20 AS doc_id, c_custkey AS seq, c_custkey * 3 AS a, CASE WHEN c_custkey % 40 = 7 THEN 100000000 ELSE c_custkey * 3 + c_nationkey END AS z FROM customer WHERE c_custkey % 2 = 1)
    SELECT p.doc_id, p.page, min(s.seq) AS section FROM (SELECT DISTINCT * FROM p) p LEFT JOIN s ON p.doc_id = s.doc_id AND p.page BETWEEN s.a AND s.z GROUP BY ALL"""
)
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: pages to the first of many ranges, short ones and some of a hundred million pages, by an index of intervals."""
    pages = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("doc_id"), F.col("o_orderkey").alias("page"))
    c = F.col("c_custkey")
    end = F.when(c % 40 == 7, 100_000_000).otherwise(c * 3 + F.col("c_nationkey"))
    sections = table(spark, sf_dir, "customer").where(c % 2 == 1).select((c % 20).alias("doc_id"), c.alias("section_id"), F.lit("standard").alias("kind"), (c * 3).alias("start_page"), end.alias("end_page"), c.alias("seq"))
    return structure.assign_section(pages, sections, 0).select("doc_id", "page", F.col("section_id").alias("section")).distinct()


@query(
    f"""WITH {EVENT_PAGES}, m AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN page END) OVER (PARTITION BY doc_id) AS s FROM pages),
    g AS (SELECT doc_id, any_value(s) AS s, min(CASE WHEN event_type = 'purchase' AND page > s THEN page END) AS e, max(page) AS z FROM m GROUP BY doc_id)
    SELECT doc_id, 'x' AS section_id, CAST(s AS INT) AS start_page, CAST(CASE WHEN s IS NOT NULL THEN coalesce(e, z) END AS INT) AS end_page,
      CASE WHEN s IS NULL THEN 'no start' WHEN e IS NULL THEN 'no end: last page of the section' END AS note FROM g"""
)
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First start and first later end of each section."""
    return structure.find_spans(event_pages(spark, sf_dir).select("doc_id", F.lit("x").alias("section_id"), "page", F.col("event_type").alias("text")), "signup", "purchase")


SEGMENT = f"""{EVENT_PAGES}, k AS (SELECT doc_id, page, event_id, CASE WHEN event_type <> 'error' THEN page END AS content, event_type FROM pages),
    b AS (SELECT *, CASE WHEN lag(page) OVER (PARTITION BY doc_id ORDER BY page) = page - 1 THEN 0 ELSE 1 END AS broken FROM k WHERE event_type <> 'error'),
    i AS (SELECT *, sum(broken) OVER (PARTITION BY doc_id ORDER BY page) AS island FROM b),
    o AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN page END IGNORE NULLS) OVER (PARTITION BY doc_id, island ORDER BY page) AS opened FROM i)"""


@query(f"""WITH {SEGMENT} SELECT doc_id, '2.1' AS subsection, CAST(page AS INT) AS page, opened < page AS is_continuation, 'event ' || event_id AS text FROM o WHERE opened IS NOT NULL AND event_type <> 'signup'
    UNION ALL SELECT doc_id, '2.1', CAST(page AS INT), false, 'AD 2.1 START' FROM o WHERE event_type = 'signup'""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under the header that is open; another kind of page closes it."""
    p = event_pages(spark, sf_dir)
    lines = p.select("doc_id", "page", F.lit(0).alias("line"), F.when(F.col("event_type") == "signup", "AD 2.1 START").otherwise(F.concat(F.lit("event "), F.col("event_id"))).alias("text"))
    classes = p.select("doc_id", "page", F.when(F.col("event_type") == "error", "CHART_PLATE").otherwise("AD_CONTENT").alias("category"), F.lit("DNAA").alias("section_id"))
    return structure.segment_sections(lines, classes).select("doc_id", "subsection", "page", "is_continuation", "text")


@query(
    f"""WITH {EVENT_PAGES}, m AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN 'S' || event_id % 3 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) AS entity FROM pages)
    SELECT doc_id, entity, count(*) AS n_words, CAST(min(page) AS INT) AS first_page FROM m WHERE entity IS NOT NULL GROUP BY doc_id, entity"""
)
def entity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: lines go to the last entity line before them; an entity that comes again goes on."""
    p = event_pages(spark, sf_dir)
    start = F.when(F.col("event_type") == "signup", F.concat(F.lit("S"), F.col("event_id") % 3))
    lines = p.select("doc_id", F.lit("X").alias("scope_id"), F.lit("2.18").alias("subsection"), "page", F.lit(0).alias("line"), F.col("event_type").alias("text"), start.alias("start"))
    got = extract.bucket_by_entity(lines, F.col("start"))
    return got.select("doc_id", "entity", F.size(F.split("raw_text", " ")).cast("long").alias("n_words"), F.col("first.page").alias("first_page"))


@query(
    f"""WITH {LINES}, t AS (SELECT doc_id, unnest(regexp_split_to_array(trim(text), '\\s+')) AS token, line_no FROM lines WHERE trim(text) <> ''),
    a AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT doc_id, token, count(*) AS n FROM t WHERE line_no % 3 <> 1 GROUP BY ALL)
    SELECT a.doc_id, a.token, a.n - coalesce(b.n, 0) AS lost FROM a LEFT JOIN b USING (doc_id, token) WHERE a.n > coalesce(b.n, 0)"""
)
def word_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a rendering lost."""
    w = src.tokens(table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id"))  # texts take less than their tokens
    return extract.word_loss(w, w.where("line_no % 3 <> 1"), ["doc_id"])


@query(
    """WITH r AS (SELECT l_orderkey, l_partkey, CAST(l_linenumber AS VARCHAR) AS a FROM lineitem), p AS (SELECT p_partkey, CAST(p_size % 7 + 1 AS VARCHAR) AS b FROM part WHERE p_partkey % 10 <> 3)
    SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, CAST(l_partkey AS VARCHAR) AS name, CASE WHEN b IS NULL THEN 'unknown point' ELSE 'positions differ' END AS problem, a, b FROM r LEFT JOIN p ON l_partkey = p_partkey WHERE b IS NULL OR a <> b"""
)
def point_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of routes against the point table."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("entity_id"), F.array(F.struct(F.col("l_partkey").cast("string").alias("name"), F.col("l_linenumber").cast("string").alias("coordinates"))).alias("points"))
    p = table(spark, sf_dir, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").cast("string").alias("entity_id"), (F.col("p_size") % 7 + 1).cast("string").alias("coordinates"))
    return extract.cross_section_agreement(l, p)


@query(
    """WITH r AS (SELECT p_partkey, p_size FROM part), i AS (
      SELECT p_partkey AS doc_id, 'error' AS severity, 'category' AS field, 'no category' AS message FROM r WHERE p_size % 4 = 0
      UNION ALL SELECT p_partkey, 'warning', 'field', 'label is not known' FROM r WHERE p_size % 3 = 0)
    SELECT severity, field, message, count(*) AS n, (SELECT count(*) FROM r WHERE p_partkey NOT IN (SELECT doc_id FROM i WHERE severity = 'error')) AS passed FROM i GROUP BY ALL"""
)
def validation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by rule, and results that pass the gate."""
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("category"), F.when(F.col("p_size") % 3 != 0, F.lit("x")).alias("field"))
    issues = extract.validate_records(r, extract.RULES["category"] + extract.RULES["label"], ["doc_id"])
    passed = extract.gate(r, issues, ["doc_id"]).agg(F.count("*").alias("passed")).withColumn("_j", F.lit(1))
    return issues.groupBy("severity", "field", "message").agg(F.count("*").alias("n")).withColumn("_j", F.lit(1)).join(passed, "_j").drop("_j")


@query(
    """WITH f AS (SELECT CAST(l_orderkey AS VARCHAR) AS scope_id, l_returnflag AS label, CAST(l_partkey AS VARCHAR) AS v, min(l_linenumber * 1000000 + l_partkey) AS seq FROM lineitem GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY scope_id, label ORDER BY seq, v) AS n, count(*) OVER (PARTITION BY scope_id, label) AS c FROM f)
    SELECT scope_id, label, CASE WHEN c > 1 THEN 'line ' || n ELSE 'line' END AS entity, v AS fact_value, CASE WHEN c > 1 THEN 'Order. Line ' || n || '. ' || label || ': ' || v ELSE 'Order. ' || label || ': ' || v END AS fact_text FROM n"""
)
def dedupe_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several values of a key are numbered by appearance."""
    l = table(spark, sf_dir, "lineitem")
    v = F.col("l_partkey").cast("string")
    rows = l.select(
        F.lit("AD").alias("scope_kind"), F.col("l_orderkey").cast("string").alias("scope_id"), F.lit("2.1").alias("subsection"), F.lit("line").alias("entity"), F.col("l_returnflag").alias("label"),
        v.alias("fact_value"), F.concat(F.lit("Order. "), F.col("l_returnflag"), F.lit(": "), v).alias("fact_text"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"),
    )
    return facts.dedupe_facts(rows).select("scope_id", "label", "entity", "fact_value", "fact_text")


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS scope_id, label, v AS fact_value FROM (
      SELECT p_partkey, 'size' AS label, p_size || ' m / ' || p_size * 3 || ' ft' AS v FROM part UNION ALL SELECT p_partkey, 'brand name', p_brand FROM part UNION ALL SELECT p_partkey, 'load', p_size + 2 || ' kg' FROM part WHERE p_size % 2 = 0) t"""
)
def unit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar columns with unit suffixes, merged for each base."""
    p = table(spark, sf_dir, "part")
    r = p.select(
        F.lit("AD").alias("scope_kind"), F.col("p_partkey").cast("string").alias("scope_id"), F.col("p_name").alias("scope_name"), F.lit("2.2").alias("subsection"), F.col("p_partkey").alias("seq"),
        (F.col("p_size") * 3).alias("size_ft"), F.col("p_size").alias("size_m"), F.col("p_brand").alias("brand_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 2).alias("load_kg"),
    )
    return facts.scalar_facts(r, ["size_ft", "size_m", "brand_name", "load_kg"]).select("scope_id", "label", "fact_value")


DISTANCES = "r AS (SELECT CAST(p_partkey AS VARCHAR) AS scope_id, p_name, lpad(CAST(p_size % 36 + 1 AS VARCHAR), 2, '0') AS rwy, CASE WHEN p_size % 5 > 0 THEN p_size * 100 END AS tora, p_size * 101 AS toda, CASE WHEN p_size % 3 > 0 THEN p_size * 102 END AS asda, p_brand FROM part)"


@query(
    f"""WITH {DISTANCES}, i AS (SELECT *, 'TORA' AS label, 'take-off run available' AS long, tora AS v FROM r UNION ALL SELECT *, 'TODA', 'take-off distance available', toda FROM r UNION ALL SELECT *, 'ASDA', 'accelerate-stop distance available', asda FROM r)
    SELECT scope_id, 'RWY ' || rwy AS entity, label, v || ' m' AS fact_value, p_name || ' (' || scope_id || ') AD 2.13 declared distances. RWY ' || rwy || '. ' || label || ' (' || long || '): ' || v || ' m' AS fact_text FROM i WHERE v IS NOT NULL
    UNION ALL SELECT scope_id, 'RWY ' || rwy, 'Remarks', p_brand, p_name || ' (' || scope_id || ') AD 2.13 declared distances. RWY ' || rwy || '. Remarks: ' || p_brand FROM r"""
)
def record_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance records as facts; nulls make none."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    r = p.select(
        F.lit("AD").alias("scope_kind"), F.col("p_partkey").cast("string").alias("scope_id"), F.col("p_name").alias("scope_name"), F.lit("2.13").alias("subsection"), F.col("p_partkey").alias("seq"),
        F.lpad((size % 36 + 1).cast("string"), 2, "0").alias("runway"), F.when(size % 5 > 0, size * 100).alias("tora_m"), (size * 101).alias("toda_m"), F.when(size % 3 > 0, size * 102).alias("asda_m"), F.lit(None).cast("int").alias("lda_m"), F.col("p_brand").alias("remarks"),
    )
    return facts.facts_from_records({"distances": r}).select("scope_id", "entity", "label", "fact_value", "fact_text")


ORDER_FACTS = "SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'X_KIND' WHEN o_orderkey % 3 = 0 THEN 'ENR_AREA' ELSE 'AD' END AS scope_kind, CAST(o_custkey AS VARCHAR) AS scope_id, CASE WHEN o_orderkey % 11 = 0 THEN 'other' ELSE CAST(o_custkey AS VARCHAR) END AS icao_code, o_orderstatus AS subsection, '' AS entity, o_orderpriority AS label FROM orders"


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cust = F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 50 == 0, F.lit(None)).when(k % 7 == 0, "X_KIND").when(k % 3 == 0, "ENR_AREA").otherwise("AD").alias("scope_kind"), cust.alias("scope_id"),
        F.when(k % 11 == 0, "other").otherwise(cust).alias("icao_code"), F.col("o_orderstatus").alias("subsection"), F.lit("").alias("entity"), F.col("o_orderpriority").alias("label"), k,
    )


@query(
    f"""WITH f AS ({ORDER_FACTS}), k AS (SELECT scope_kind, count(*) AS c FROM f GROUP BY scope_kind, scope_id, subsection, entity, label HAVING count(*) > 1)
    SELECT 'facts' AS "check", scope_kind, count(*) AS n FROM f GROUP BY scope_kind
    UNION ALL SELECT 'unscoped', scope_kind, count(*) FROM f WHERE scope_kind IS NULL GROUP BY scope_kind
    UNION ALL SELECT 'disagreeing', scope_kind, count(*) FROM f WHERE scope_kind = 'AD' AND icao_code <> scope_id GROUP BY scope_kind
    UNION ALL SELECT 'unknown kind', scope_kind, count(*) FROM f WHERE scope_kind = 'X_KIND' GROUP BY scope_kind
    UNION ALL SELECT 'repeated keys', scope_kind, count(*) FROM k GROUP BY scope_kind
    UNION ALL SELECT 'scopes', scope_kind, count(DISTINCT scope_id) FROM f GROUP BY scope_kind"""
)
def fact_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of the fact table."""
    return facts.fact_quality(order_facts(spark, sf_dir))


@query(
    f"""WITH f AS ({ORDER_FACTS}) SELECT coalesce(scope_kind, 'AD') AS scope_kind, scope_id, CASE WHEN coalesce(scope_kind, 'AD') = 'AD' THEN icao_code ELSE scope_kind END AS icao_code, count(*) AS n FROM f GROUP BY ALL"""
)
def scope_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing scopes filled."""
    return facts.scope_backfill(order_facts(spark, sf_dir)).groupBy("scope_kind", "scope_id", "icao_code").agg(F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS scope_id, o_orderstatus AS subsection, o_orderpriority AS label FROM orders), e AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS scope_id, o_orderstatus AS subsection, o_orderpriority AS label FROM orders WHERE o_orderkey % 4 > 0 OR o_custkey % 5 = 0),
    t AS (SELECT scope_id FROM (SELECT scope_id, count(*) AS w FROM n GROUP BY 1) LEFT JOIN (SELECT scope_id, count(*) AS h FROM e GROUP BY 1) USING (scope_id) WHERE coalesce(h, 0) < w)
    SELECT scope_id, subsection, label FROM n WHERE scope_id IN (SELECT scope_id FROM t) EXCEPT SELECT scope_id, subsection, label FROM e"""
)
def facts_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an interrupted load still has to write."""
    f = order_facts(spark, sf_dir).withColumn("scope_kind", F.lit("AD"))
    some = f.where("o_orderkey % 4 > 0 or cast(scope_id as bigint) % 5 = 0").select(*facts.KEY).distinct()
    return facts.facts_pending(f.select(*facts.KEY).distinct(), some).select("scope_id", "subsection", "label")


@query(
    """WITH n AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders), w AS (SELECT * FROM n WHERE o_custkey % 3 > 0 AND o_custkey % 10 > 0)
    SELECT (SELECT count(*) FROM n) AS attempted, (SELECT count(*) FROM n WHERE o_custkey % 10 > 0) AS embedded, (SELECT count(*) FROM n WHERE NOT o_custkey % 10 > 0) AS failed, (SELECT count(*) FROM w) AS written,
      (SELECT count(*) FROM n WHERE o_custkey % 10 > 0) - (SELECT count(*) FROM w) AS lost, true AS error"""
)
def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that were intended and are not there."""
    f = order_facts(spark, sf_dir).withColumn("scope_kind", F.lit("AD")).select(*facts.KEY).distinct()
    c = F.col("scope_id").cast("long")
    return facts.write_report(f, f.where(c % 10 > 0), f.where((c % 3 > 0) & (c % 10 > 0))).select("attempted", "embedded", "failed", "written", "lost", "error")


CONTEXT = f"""{EVENT_PAGES}, t AS (SELECT doc_id, page, CASE event_type WHEN 'signup' THEN 'PART 1 GEN 1.2' WHEN 'purchase' THEN 'PART 2 ENR 3.1' WHEN 'click' THEN '(AD) AD 2.12 DN' || chr(CAST(65 + event_id % 2 AS INT)) || 'A' ELSE 'plain' END AS text FROM pages),
    p AS (SELECT *, CASE WHEN text LIKE 'PART 1%' THEN 'GEN' WHEN text LIKE 'PART 2%' THEN 'ENR' WHEN text LIKE '(AD)%' THEN 'AD' END AS p, nullif(regexp_extract(text, '(?:GEN|ENR|AD) +\\d+(?:\\.\\d+)?'), '') AS s FROM t),
    c AS (SELECT doc_id, page, text, coalesce(last_value(p IGNORE NULLS) OVER w, 'GEN') AS part, coalesce(last_value(s IGNORE NULLS) OVER w, 'GEN 0.1') AS s, p FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
    r AS (SELECT *, CASE WHEN part = 'AD' THEN nullif(regexp_extract(text, 'DN[A-Z]{{2}}'), '') WHEN p = 'GEN' THEN 'NATIONAL' WHEN p = 'ENR' THEN 'AIRSPACE' END AS own FROM c),
    x AS (SELECT doc_id, page, text, part, s, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page), 'NATIONAL') AS reference FROM r),
    y AS (SELECT doc_id, page, text, part, CASE WHEN part = 'AD' AND s LIKE 'AD 2%' AND reference LIKE 'DN%' THEN 'AD 2' ELSE s END AS section, reference FROM x)"""


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    text = F.when(t == "signup", "PART 1 GEN 1.2").when(t == "purchase", "PART 2 ENR 3.1").when(t == "click", F.concat(F.lit("(AD) AD 2.12 DN"), F.char(65 + F.col("event_id") % 2), F.lit("A"))).otherwise("plain")
    return chunks.carry_page_context(event_pages(spark, sf_dir).select("doc_id", "page", text.alias("text")))


@query(f"WITH {CONTEXT} SELECT doc_id, CAST(page AS INT) AS page, part, section, reference FROM y")
def page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part, section and reference carried over pages."""
    return context(spark, sf_dir).select("doc_id", "page", "part", "section", "reference")


@query(
    f"""WITH {CONTEXT}, b AS (SELECT *, CASE WHEN lag(part || section || reference) OVER (PARTITION BY doc_id ORDER BY page) = part || section || reference AND section IN ('AD 2', 'ENR 3.1') THEN 0 ELSE 1 END AS n FROM y),
    i AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY page) AS k FROM b)
    SELECT doc_id, part, section, reference, CAST(min(page) AS INT) AS first_page, count(*) AS n_pages, string_agg(text, ' ' ORDER BY page) AS text FROM i GROUP BY doc_id, k, part, section, reference"""
)
def accumulated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of pages with equal context."""
    return chunks.accumulate(context(spark, sf_dir))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE length(trim(text)) >= 400 AND NOT contains(upper(text), 'SCALE 1:') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are no plates: not catalogued, without markers, not nearly empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    catalogue = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit(1).alias("source_page"))
    return chunks.exclude_plates(d, catalogue, 400).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _behind(sep: str, width: int) -> str:
    """Place (from 0, within the window) behind the first character of the last separator in a window's second half."""
    return f"CASE WHEN instr(reverse(win), reverse({sep})) > 0 AND length(win) - instr(reverse(win), reverse({sep})) + 1 - {width} > 750 THEN length(win) - instr(reverse(win), reverse({sep})) + 2 - {width} END"


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS row_no, text, length(text) AS len FROM documents WHERE text <> ''),
    r AS (SELECT doc_id, row_no, text, len, CAST(0 AS BIGINT) AS start, substr(text, 1, 1500) AS win, 0 AS i FROM d
      UNION ALL SELECT doc_id, row_no, text, len, nxt, substr(text, nxt + 1, 1500), i + 1 FROM (SELECT *, start + CASE WHEN start + 1500 >= len THEN length(win) ELSE coalesce({_behind("'. '", 2)}, {_behind("chr(10)", 1)}, {_behind("'; '", 2)}, {_behind("', '", 2)}, 1500) END - 300 AS nxt FROM r) WHERE nxt > start AND nxt < len),
    e AS (SELECT *, CASE WHEN start + 1500 >= len THEN length(win) ELSE coalesce({_behind("'. '", 2)}, {_behind("chr(10)", 1)}, {_behind("'; '", 2)}, {_behind("', '", 2)}, 1500) END AS size FROM r),
    c AS (SELECT doc_id, row_no, i, regexp_replace(substr(win, 1, size), '^\\s+|\\s+$', '', 'g') AS chunk FROM e)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY row_no ORDER BY i) - 1 AS INT) AS chunk_no, chunk FROM c WHERE length(chunk) > 50"""
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: overlapping chunks that end at separators."""
    return chunks.chunk_text(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    f"""WITH RECURSIVE {LINES}, p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n, text || CASE WHEN line_no < max(line_no) OVER (PARTITION BY doc_id) THEN chr(10) ELSE '' END AS t FROM lines),
    k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, t, length(t) AS len FROM p WHERE trim(t, ' ') <> ''),
    r AS (SELECT doc_id, n, t, len AS size, 0 AS chunk_no FROM k WHERE n = 1 UNION ALL SELECT k.doc_id, k.n, k.t, CASE WHEN r.size + k.len <= 2000 THEN r.size + k.len ELSE k.len END, CASE WHEN r.size + k.len <= 2000 THEN r.chunk_no ELSE r.chunk_no + 1 END FROM r JOIN k ON k.doc_id = r.doc_id AND k.n = r.n + 1)
    SELECT doc_id, chunk_no, string_agg(t, '' ORDER BY n) AS chunk FROM r GROUP BY ALL"""
)
def packed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed up to a limit."""
    return chunks.pack_sections(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=2000, heading=r"(?<=\n)")


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, '[Parts | ' || p_type || ' | AD 2 — ' || p_brand || ' | ' || CASE WHEN p_size % 2 = 0 THEN p_name || ' (' || p_partkey || ')' ELSE CAST(p_partkey AS VARCHAR) END || ']' AS prefix FROM part"""
)
def chunk_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix that tells where a chunk stands."""
    name = F.when(F.col("p_size") % 2 == 0, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", chunks.build_prefix(F.col("p_type"), F.lit("AD 2"), F.col("p_brand"), name, F.col("p_partkey").cast("string"), "Parts").alias("prefix"))


@query(
    """WITH t AS (SELECT DISTINCT p_brand AS section, 'Title of ' || p_brand AS title, CASE WHEN substr(p_brand, 7, 1) = '1' THEN NULL WHEN substr(p_brand, 7, 1) = '2' THEN '' ELSE 'terms: ' || p_brand END AS terms FROM part)
    SELECT CAST(p_partkey AS BIGINT) AS p_partkey, '[Parts | ' || p_type || ' | ' || p_brand || ' — ' || title || CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 2 = 0 THEN ' | Place ' || p_size || ' (S' || p_size || ')' ELSE ' | S' || p_size END || ']' ||
      CASE WHEN coalesce(terms, '') <> '' THEN ' ' || terms ELSE '' END || coalesce(' ' || CASE WHEN p_partkey % 10 > 0 THEN p_name END, '') AS content FROM part JOIN t ON p_brand = section"""
)
def enriched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks under their prefix with the term pack of their section."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    reference = F.when(size % 3 == 0, "NATIONAL").otherwise(F.concat(F.lit("S"), size.cast("string")))
    c = p.select("p_partkey", F.col("p_type").alias("part"), F.col("p_brand").alias("section"), reference.alias("reference"), F.when(F.col("p_partkey") % 10 > 0, F.col("p_name")).alias("chunk"))
    digit = F.substring("p_brand", 7, 1)
    titles = p.select(F.col("p_brand").alias("section"), F.concat(F.lit("Title of "), "p_brand").alias("title")).distinct()
    terms = p.select(F.col("p_brand").alias("section"), F.when(digit == "1", None).when(digit == "2", "").otherwise(F.concat(F.lit("terms: "), "p_brand")).alias("terms")).distinct()
    names = p.where("p_size % 2 = 0 and p_size % 3 > 0").select(F.concat(F.lit("S"), size.cast("string")).alias("reference"), F.concat(F.lit("Place "), size.cast("string")).alias("name")).distinct()
    return chunks.enrich(c, titles, names, terms, "Parts").select("p_partkey", "content")


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, (['Precision Approach Terrain Chart', 'ILS Approach Chart', 'ILS Approach Chart', 'RNAV Approach Chart', 'RNAV Approach Chart', 'VOR Approach Chart', 'NDB Approach Chart', 'Instrument Approach Chart', 'Visual Approach Chart', 'Aerodrome Obstacle Chart', 'SID Chart', 'SID Chart', 'STAR Chart', 'STAR Chart', 'Area Chart - Arrival and Transit Routes', 'Area Chart - Departure and Transit Routes', 'Area Chart', 'Ground Movement Chart', 'Parking / Docking Chart', 'Aerodrome Chart', 'Heliport Chart', 'Helicopter Traffic Chart', 'En-Route Chart', 'Search and Rescue Units Chart', 'Aerodrome Index Chart', NULL])[CAST(p_partkey % 26 AS INT) + 1] AS kind,
      (['', '18L', '04', '23', '36R', '05', '09', '22', '31', '18', '', '', '', '', '', '', '', '', '', '', '', '', '', '', '', NULL])[CAST(p_partkey % 26 AS INT) + 1] AS runway FROM part"""
)
def chart_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart types of titles, the first pattern winning; every pattern occurs, and a title of no type."""
    names = (
        "Precision approach terrain chart", "ILS/DME RWY 18L", "ILS or LOC RWY 04", "RNAV (GNSS) RWY 23", "RNP RWY 36R", "VOR/DME RWY 05", "NDB RWY 09", "Instrument approach RWY 22", "Visual approach RWY 31", "Obstacle chart type A RWY 18", "Standard instrument departure", "SID - ICAO", "Standard arrival", "STAR ICAO", "Area chart arrival and transit", "Area chart departure and transit", "Area chart", "Ground movement chart", "Aircraft parking/docking chart", "Aerodrome chart", "Heliport chart", "Helicopter traffic chart", "En-route chart", "Search and rescue", "Aerodrome index", "none",
    )
    title = F.concat_ws(" ", "p_name", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int")))
    kind, runway = charts.chart_type(title)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), runway.alias("runway"))


J = "regexp_replace({}, '(\\d) (\\d{{3}})(\\D|$)', '\\1\\2\\3', 'g')"


@query(
    f"""WITH t AS (SELECT doc_id, {J.format(J.format(J.format("text")))} AS t FROM documents), n AS (SELECT doc_id, unnest(regexp_extract_all(t, '\\d[\\d,]*(?:\\.\\d+)?')) AS x FROM t)
    SELECT d.doc_id, coalesce(c, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT replace(x, ',', '')) AS c FROM n GROUP BY doc_id) USING (doc_id)"""
)
def number_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distinct numbers of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(number_set(F.coalesce("text", F.lit("")))).cast("long").alias("n"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderpriority END AS o_orderpriority, o_custkey FROM orders
    UNION ALL SELECT o_orderkey + 10000000, 'changed', o_custkey FROM orders WHERE o_orderkey % 1000 = 0"""
)
def upserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: keyed upsert; the last of several updates wins."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    some = o.where("o_orderkey % 3 = 0")
    new = o.where("o_orderkey % 1000 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    up = some.withColumn("at", F.lit(1)).unionByName(some.unionByName(new).withColumns({"at": F.lit(2), "o_orderpriority": F.lit("changed")}))
    return src.upsert(o.withColumn("at", F.lit(0)), up, ["o_orderkey"], "at").select("o_orderkey", "o_orderpriority", "o_custkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus LIKE 'F%') GROUP BY ALL")
def kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a reload keeps."""
    kept = src.delete_where(table(spark, sf_dir, "lineitem"), "l_returnflag = 'R' and l_linestatus like 'F%'")
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
