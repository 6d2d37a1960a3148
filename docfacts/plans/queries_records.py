"""Queries over records, positions, charts and replies that are derived from the tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import charts, chunks, evaluate, extract, facts, log, resolve, retrieve, structure, verify
from ..sources import tables as src
from .catalog import query, table
from .queries_search import LOG, event_log
from .queries_text import LINES

def two(c, n: int = 2):
    return F.lpad(c.cast("string"), n, "0")


@query(
    """SELECT o_orderkey, round((CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END) * (o_orderkey % 90 + o_orderkey % 60 / 60 + (o_orderkey % 59 + 0.5) / 3600), 6) + 0.0 AS lat,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round((CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * (o_orderkey % 180 + o_orderkey % 60 / 60 + (o_orderkey % 60) / 3600), 6) + 0.0 END AS lon FROM orders"""
)
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed positions to degrees; an absent one is null."""
    k = F.col("o_orderkey")
    lat = F.concat(two(k % 90), two(k % 60), two(k % 59), F.lit(".5"), F.when(k % 5 == 0, "S").otherwise("N"))
    lon = F.concat(two(k % 180, 3), two(k % 60), two(k % 60), F.when(k % 7 == 0, "").when(k % 3 == 0, "W").otherwise("E"))
    t = F.concat_ws(" ", F.lit("ARP"), lat, lon)
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.dms_to_decimal(t, "lat").alias("lat"), tx.dms_to_decimal(t, "lon").alias("lon"))


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(1000 + p_size AS DOUBLE) END AS m, CAST(p_size * 3 AS DOUBLE) AS ft, CASE WHEN p_size % 3 = 0 THEN CAST(p_size % 10 + 1 AS INT) END AS cat FROM part"""
)
def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths written with odd blanks, and categories."""
    s = F.col("p_size")
    t = F.concat(F.when(s % 4 == 0, "").otherwise(F.concat(F.lit("1 "), F.substring((1000 + s).cast("string"), 2, 3), F.lit(" m / "))), (s * 3).cast("string"), F.lit(" f t"), F.when(s % 3 == 0, F.concat(F.lit(" CAT "), (s % 10 + 1).cast("string"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", tx.measure(t, "m").alias("m"), tx.measure(t, "ft").alias("ft"), tx.rff_category(t).alias("cat"))


@query(
    """WITH e AS (SELECT DISTINCT l_orderkey AS doc_id, lpad(CAST(l_partkey % 36 + 1 AS VARCHAR), 2, '0') AS e, lpad(CAST((l_partkey % 36 + 18) % 36 + 1 AS VARCHAR), 2, '0') AS o FROM lineitem)
    SELECT doc_id, string_agg(DISTINCT e, '/' ORDER BY e) AS designation, count(DISTINCT e) AS n FROM e GROUP BY doc_id, least(e, o), greatest(e, o)"""
)
def paired_runways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends that face each other are one runway."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("X").alias("scope_id"), F.lit("2.12").alias("subsection"), two(F.col("l_partkey") % 36 + 1).alias("end")).distinct()
    none = F.lit(None).cast("int")
    ends = l.select("*", F.struct(F.lit(1).alias("page"), F.lit(1).alias("line")).alias("first"), none.alias("length_m"), none.alias("width_m"), F.lit("x").alias("raw_text"))
    return extract.pair_opposite_ends(ends).select("doc_id", "designation", F.size("end_detail").cast("long").alias("n"))


@query(
    """WITH s AS (SELECT o_orderkey, o_orderkey % 3 AS m, 118 + (o_orderkey % 10) / 10 AS a FROM orders)
    SELECT o_orderkey, CASE m WHEN 0 THEN a WHEN 1 THEN a END AS value, CASE m WHEN 0 THEN 'H24' WHEN 1 THEN 'HJ' END AS hours, CASE m WHEN 0 THEN 'Primary frequency' END AS remark, CAST(CASE WHEN m = 2 THEN 0 ELSE 1 END AS BIGINT) AS n, m = 1 AS inferred FROM s"""
)
def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies count only with hours behind them; bare ones only if there are no others."""
    k = F.col("o_orderkey")
    n = F.concat(F.lit("118."), (k % 10).cast("string"))
    t = F.when(k % 3 == 0, F.concat(F.lit("TWR "), n, F.lit(" MHz H24 Primary frequency, call 8903KHz or 124.1MHz on request of the crew"))).when(k % 3 == 1, F.concat(F.lit("TWR "), n, F.lit(" HJ"))).otherwise(F.lit("call 8903KHz as alternative"))
    freq, inferred = extract.service_frequencies(F.col("t"))
    f = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", freq.alias("f"), inferred.alias("inferred"))
    one = F.get(F.col("f"), F.lit(0))
    return f.select("o_orderkey", one["value"].alias("value"), one["hours"].alias("hours"), one["remark"].alias("remark"), F.size("f").cast("long").alias("n"), "inferred")


@query(
    """WITH r AS (SELECT c_nationkey, c_custkey, CASE WHEN c_mktsegment LIKE 'BUILD%' THEN 'house' WHEN c_mktsegment LIKE 'MACH%' THEN 'machine' WHEN c_mktsegment LIKE 'FURN%' THEN 'chair' END AS field FROM customer),
    n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, field ORDER BY c_custkey) AS n FROM r)
    SELECT CAST(c_custkey AS BIGINT) AS row_no, field, CASE WHEN field IS NULL THEN 'unknown label' WHEN n > 1 THEN 'repeated label' END AS warning FROM n"""
)
def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to keys, unknown and repeated ones marked."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.lit("X").alias("scope_id"), F.lit("2.4").alias("subsection"), F.col("c_custkey").alias("row_no"), F.col("c_mktsegment").alias("label"))
    return extract.canonicalize_labels(c, [("build", "house"), ("mach", "machine"), ("furn", "chair")]).select("row_no", "field", "warning")


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_suppkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)
    SELECT l_orderkey AS doc_id, max(CASE WHEN n = 1 THEN l_returnflag || l_partkey END) AS a, max(CASE WHEN n = 2 THEN l_returnflag || l_partkey END) AS b, CASE WHEN max(c) <> 2 THEN max(c) || ' rows, 2 expected' END AS warning FROM n GROUP BY l_orderkey"""
)
def positional_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the i-th row fills the i-th field."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag", "l_suppkey"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("X").alias("scope_id"), F.lit("2.6").alias("subsection"), nth.alias("row_no"), F.concat("l_returnflag", "l_partkey").alias("value"))
    return extract.positional_record(l, ["a", "b"]).select("doc_id", "a", "b", "warning")


@query(
    """WITH lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '(\\d)\\.(\\d)', '\\1,\\2', 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
    b AS (SELECT doc_id, line_no, trim(text) AS body FROM lines WHERE length(trim(text)) >= 12)
    SELECT CAST(doc_id AS VARCHAR) AS scope_id, '2.22.' || line_no AS entity, 'Heading' AS label, CASE WHEN length(body) > 1200 THEN regexp_replace(substr(body, 1, 1200), ' [^ ]*$', '') || ' …' ELSE body END AS fact_value FROM b"""
)
def text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: one fact for each numbered heading with a body, cut at a blank where it is long. Every line of every document
    is a body; runs of blanks are one blank, and dots within numbers commas, so that no line is a heading itself."""
    plain = F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r"(\d)\.(\d)", "$1,$2")
    numbered = F.array_join(F.transform(F.split(plain, "\n"), lambda line, i: F.concat(F.lit("2.22."), i.cast("string"), F.lit(" Heading\n"), line)), "\n")
    t = table(spark, sf_dir, "documents").select(F.lit("AD").alias("scope_kind"), F.col("doc_id").cast("string").alias("scope_id"), F.lit("x").alias("scope_name"), F.lit("2.22").alias("subsection"), numbered.alias("text"))
    return facts.facts_from_text(t).where("entity <> ''").select("scope_id", "entity", "label", "fact_value")


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS scope_id, label, v AS fact_value FROM (SELECT p_partkey, 'Name' AS label, p_name AS v FROM part UNION ALL SELECT p_partkey, 'Upper limit', 'FL ' || p_size FROM part WHERE p_size % 2 = 0
      UNION ALL SELECT p_partkey, 'Coordinates', p_brand || ' ' || p_type FROM part WHERE p_size % 3 > 0) t"""
)
def entity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of en-route records; coordinates are one fact."""
    s = F.col("p_size")
    r = table(spark, sf_dir, "part").select(
        F.lit("ENR_AREA").alias("scope_kind"), F.col("p_partkey").cast("string").alias("scope_id"), F.lit("5.1").alias("subsection"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"),
        F.when(s % 2 == 0, F.concat(F.lit("FL "), s)).alias("upper_limit"), F.lit(" ").alias("remarks"), F.when(s % 3 > 0, F.array("p_brand", "p_type")).alias("coordinates"),
    )
    return facts.facts_from_entities(r).select("scope_id", "label", "fact_value")


@query(
    """WITH w AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS word FROM benchmark), k AS (SELECT * FROM w WHERE regexp_full_match(word, '[a-z]{4,}')),
    j AS (SELECT q.item_id AS query_id, e.item_id AS excerpt_no, count(*) AS overlap FROM k q JOIN k e USING (word) WHERE q.item_id % 20 = 0 AND q.item_id <> e.item_id GROUP BY ALL)
    SELECT query_id, excerpt_no, overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, excerpt_no) AS n FROM j) WHERE n = 1"""
)
def best_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of all items the one that shares most words with a query."""
    b = table(spark, sf_dir, "benchmark")
    e = b.select(F.col("item_id").alias("excerpt_no"), F.col("text").alias("content"))
    asked = b.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("item_id").alias("leave_out"))
    return verify.best_of(verify.most_shared(asked, e).withColumn("similarity", F.lit(0.0))).select("query_id", "excerpt_no", "overlap")


@query(
    """WITH t AS (SELECT DISTINCT upper(string_split(p_name, ' ')[2]) AS token FROM part WHERE length(string_split(p_name, ' ')[2]) BETWEEN 2 AND 6), w AS (SELECT p_partkey, unnest(string_split(upper(p_type || ' ' || p_name), ' ')) AS token, unnest(range(10)) AS i FROM part),
    h AS (SELECT p_partkey, arg_min(token, i) AS token FROM w JOIN t USING (token) GROUP BY p_partkey) SELECT CAST(p_partkey AS BIGINT) AS query_id, token FROM part LEFT JOIN h USING (p_partkey)"""
)
def spotted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first word of a question that is published."""
    p = table(spark, sf_dir, "part")
    published = resolve.published_entities([("ENR_POINT", p.select(F.split("p_name", " ")[1].alias("scope_id")).distinct())])
    none = spark.createDataFrame([], "scope_id string")
    q = p.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_type", "p_name").alias("raw"))
    return resolve.spot_entities(q, published, none)


@query(
    """WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'AD' ELSE 'ENR_AREA' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'rwy_char' ELSE 'subsection' END AS status FROM customer), h AS (SELECT o_custkey, max((o_orderkey % 100) / 100) AS top FROM orders GROUP BY o_custkey)
    SELECT CAST(c_custkey AS BIGINT) AS query_id, coalesce(top >= 0.42, false) AND (kind <> 'AD' OR status = 'subsection') AS use_facts, CASE WHEN coalesce(top >= 0.42, false) AND (kind <> 'AD' OR status = 'subsection') THEN 'facts' WHEN kind <> 'AD' THEN 'not_found' ELSE status END AS outcome FROM q LEFT JOIN h ON o_custkey = c_custkey"""
)
def gated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts answer only if they are allowed to and near enough."""
    k = F.col("c_custkey")
    q = table(spark, sf_dir, "customer").select(k.alias("query_id"), F.when(k % 4 == 0, "AD").otherwise("ENR_AREA").alias("scope_kind"), F.when(k % 3 == 0, "rwy_char").otherwise("subsection").alias("status"))
    h = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 100 / 100).alias("similarity"))
    return retrieve.facts_gate(q, h).select("query_id", "use_facts", "outcome")


@query(
    """SELECT o_custkey AS scope_id, o_orderstatus AS entity, string_agg(o_orderpriority || ': ' || o_orderkey, ' | ' ORDER BY o_orderkey) AS lines, CASE WHEN count(DISTINCT o_orderkey % 2) = 1 THEN 'AD 2.' || min(o_orderkey % 2) ELSE 'AD' END AS cite FROM orders GROUP BY ALL"""
)
def grouped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts of an entity in order, with what they cite."""
    k = F.col("o_orderkey")
    f = table(spark, sf_dir, "orders").select(F.lit("AD").alias("scope_kind"), F.col("o_custkey").alias("scope_id"), F.concat(F.lit("2."), (k % 2).cast("string")).alias("subsection"), F.col("o_orderstatus").alias("entity"), F.col("o_orderpriority").alias("label"), k.cast("string").alias("fact_value"), k.alias("seq"))
    return retrieve.facts_by_entity(f).select("scope_id", "entity", F.array_join("lines", " | ").alias("lines"), "cite")


@query(
    f"""WITH {LOG} SELECT CAST(id AS VARCHAR) AS id, path, CAST(needs_review AS VARCHAR) AS needs_review, CASE WHEN id % 9 = 0 THEN 'down' ELSE '' END AS feedback, query FROM l"""
)
def exported_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as text, nulls as ''."""
    return src.export_log(event_log(spark, sf_dir)).select("id", "path", "needs_review", "feedback", "query")


@query(
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND event_id % 2 = 0 THEN 'acted' ELSE 'expired' END AS outcome FROM events"""
)
def tapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tap acts only on what is pending."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    chart = F.col("event_type").isin("click", "view")
    pending = F.when(F.col("event_type") != "error", F.concat(F.lit('{"kind": "'), F.when(chart, "chart").otherwise("scope"), F.lit('", "qid": "q'), k - k % 2, F.lit('"}')))
    return log.pending_tap(e.select(k, F.lit("chart").alias("kind"), F.concat(F.lit("q"), k).alias("qid"), pending.alias("ctx_pending"))).select("event_id", "outcome")


@query(
    """WITH r AS (SELECT o_orderkey, o_orderkey % 4 AS t, o_orderkey % 7 AS x FROM orders)
    SELECT ['out_of_scope', 'mapping', 'currency', 'retrieval'][CAST(t AS INT) + 1] AS category, count(*) FILTER (v = 'PASS') AS pass, count(*) FILTER (v = 'PARTIAL') AS partial, count(*) FILTER (v = 'FAIL') AS fail, count(*) FILTER (v = 'REVIEW') AS review FROM (
      SELECT *, CASE t WHEN 0 THEN CASE WHEN x < 3 THEN 'PASS' ELSE 'FAIL' END WHEN 1 THEN CASE WHEN x % 2 = 0 THEN 'PASS' ELSE 'FAIL' END WHEN 2 THEN CASE WHEN x = 1 THEN 'PASS' ELSE 'FAIL' END ELSE CASE WHEN x < 2 THEN 'PASS' WHEN x < 5 THEN 'PARTIAL' ELSE 'FAIL' END END AS v FROM r) GROUP BY t"""
)
def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8, H9: ground-truth verdicts by category."""
    k = F.col("o_orderkey")
    t, x = k % 4, k % 7
    kind = F.element_at(F.array(*[F.lit(v) for v in ("out_of_scope", "mapping", "currency", "retrieval")]), (t + 1).cast("int"))
    truth = F.when(t == 1, "DNAA is Abuja").when(t == 3, "3 610 m and 60").otherwise("")
    reply = F.when(t == 1, F.when(x % 2 == 0, "that is abuja").otherwise("no")).when(t == 2, F.when(x == 1, "AIRAC 03/2026").otherwise("no")).when(t == 3, F.when(x < 2, "3610 by 60").when(x < 5, "3610").otherwise("36100")).otherwise("")
    path = F.when(t == 0, F.when(x < 3, "abstain").otherwise("answer")).otherwise("answer")
    rows = table(spark, sf_dir, "orders").select(kind.alias("test_type"), kind.alias("category"), truth.alias("ground_truth"), reply.alias("reply"), path.alias("path"), F.lit(0).alias("charts"), F.lit(None).cast("string").alias("icao"), F.lit(None).cast("array<string>").alias("sections"))
    return evaluate.category_report(evaluate.score_ground_truth(rows))


@query(
    """SELECT o_orderkey, CAST((CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_fails, CAST(CASE WHEN o_orderkey % 10 < 4 THEN 1 ELSE 0 END AS BIGINT) AS n_warns FROM orders"""
)
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every answer must and must not hold."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    reply = F.concat(F.when(k % 2 == 0, "").otherwise("Reference aid only "), F.lit("03/2026 [50% match]"), F.when(k % 3 == 0, " SCALE 1: 5").otherwise(""))
    rows = table(spark, sf_dir, "orders").select(k, F.lit("answer").alias("path"), F.lit("DNAA").alias("icao"), none.alias("ref"), reply.alias("reply"), (k % 10 / 10).alias("similarity"), none.alias("exp_path"), F.when(k % 5 == 0, "DNBB").alias("exp_icao"), none.alias("exp_ref"), F.lit(None).cast("array<string>").alias("exp_contains"), F.lit(0.4).alias("exp_min_similarity"))
    return evaluate.invariant_checks(rows, "Reference aid only", "03/2026").select("o_orderkey", F.size("fails").cast("long").alias("n_fails"), F.size("warns").cast("long").alias("n_warns"))


@query(
    """WITH c AS (SELECT p_brand AS section_id, ['ILS', 'VOR', 'RNAV'][CAST(p_size % 3 AS INT) + 1] AS label, lpad(CAST(p_size % 4 + 1 AS VARCHAR), 2, '0') AS rwy FROM part WHERE p_size % 5 > 0),
    r AS (SELECT c_custkey, 'Brand#' || c_custkey % 30 AS section_id, CASE WHEN c_custkey % 2 = 0 THEN 'VOR' END AS t, CASE WHEN c_custkey % 3 = 0 THEN '02' END AS r FROM customer),
    g AS (SELECT c_custkey, r.t, r.r, count(label) AS n, count(DISTINCT label) AS types, count(DISTINCT rwy) AS rwys FROM r LEFT JOIN c ON r.section_id = c.section_id AND (t IS NULL OR label = t) AND (r IS NULL OR rwy = r) GROUP BY ALL)
    SELECT CAST(c_custkey AS BIGINT) AS request_id, CASE WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'send' WHEN types > 1 AND t IS NULL THEN 'ask_type' WHEN rwys > 1 AND r IS NULL THEN 'ask_runway' ELSE 'send' END AS action, n FROM g"""
)
def clarifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Send a chart, or ask for the one thing that is open."""
    s, k = F.col("p_size"), F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(v) for v in ("ILS Approach Chart", "VOR Approach Chart", "RNAV Approach Chart")]), (s % 3 + 1).cast("int"))
    c = table(spark, sf_dir, "part").select(F.col("p_brand").alias("section_id"), F.when(s % 5 > 0, kind).otherwise("Aerodrome Chart").alias("procedure_type"), two(s % 4 + 1).alias("runway"))
    r = table(spark, sf_dir, "customer").select(k.alias("request_id"), F.concat(F.lit("Brand#"), k % 30).alias("section_id"), F.when(k % 2 == 0, "vor plate").otherwise("approach plate").alias("term"), F.when(k % 3 == 0, "02").alias("runway"))
    return charts.clarify_decision(r, c).select("request_id", "action", "n")


@query(
    """WITH i AS (SELECT DISTINCT p_brand AS section_id, p_size AS ref FROM part WHERE p_size % 2 = 0), m AS (SELECT DISTINCT p_brand AS section_id, p_size AS ref FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 = 0)
    SELECT section_id, CAST(ref AS INT) AS ref, 'no page' AS problem FROM i WHERE (section_id, ref) NOT IN (SELECT section_id, ref FROM m) UNION ALL SELECT DISTINCT p_type, NULL, 'no index' FROM part"""
)
def chart_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries without a page, and sections without an index."""
    p = table(spark, sf_dir, "part")
    ix = p.where("p_size % 2 = 0").select(F.col("p_brand").alias("section_id"), F.col("p_size").alias("ref"), F.lit("x").alias("name")).distinct()
    m = p.where("p_size % 2 = 0 and p_partkey % 3 = 0").select(F.col("p_brand").alias("section_id"), F.col("p_size").alias("ref")).distinct()
    sections = p.select(F.col("p_type").alias("section_id")).unionByName(ix.select("section_id"))
    return charts.chart_reconciliation(m, ix, sections).select("section_id", "ref", "problem")


@query(
    """SELECT doc_id, md5(substr(CASE WHEN lang IS NULL OR contains(text, lang || ' ') THEN text ELSE lang || ' ' || chr(10) || chr(10) || text END, 1, 8000)) AS payload_md5, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS squeezed_md5 FROM documents"""
)
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded for a section, cut at the model's limit; and its text, white space collapsed (md5 of both, to
    keep the table narrow)."""
    d = table(spark, sf_dir, "documents")
    steer = F.concat("lang", F.lit(" "))
    digest = lambda c: F.md5(c.cast("binary"))
    return d.select("doc_id", digest(chunks.embed_payload(steer, F.col("text"))).alias("payload_md5"), digest(chunks.strip_header(F.col("text"), r"\Zx")).alias("squeezed_md5"))


@query(
    f"""WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, trim(text) AS text FROM lines WHERE trim(text) <> '' AND NOT regexp_matches(trim(text), '^(?:[A-Z][a-z]*\\.|Released under.*)$')"""
)
def content_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed lines that are no furniture as a whole."""
    return structure.content_lines(src.text_lines(table(spark, sf_dir, "documents")), r"[A-Z][a-z]*\.|Released under.*")
