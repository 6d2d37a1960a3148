"""Queries over scopes, charts, fields and procedure texts, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import focus_window
from ..operators import charts, evaluate, extract, resolve, retrieve, route, verify
from .catalog import query, table
from .queries_pages import one_of


def names(spark: SparkSession, *rows: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


@query(
    """WITH q AS (SELECT conv_id, turn, CAST((conv_id + turn) % 3 AS INT) AS s, CASE CAST(conv_id % 4 AS INT) WHEN 0 THEN 'GEN' WHEN 1 THEN 'AD' END AS part, CASE CAST(turn % 3 AS INT) WHEN 0 THEN 'NATIONAL' WHEN 1 THEN 'AIRSPACE' END AS ref FROM conversations),
    p AS (SELECT *, list_distinct(list_filter([part, 'GEN', 'ENR', 'AD'], lambda x: x IS NOT NULL)) AS ps, list_distinct(list_filter([ref, 'NATIONAL', 'AIRSPACE'], lambda x: x IS NOT NULL)) AS rs FROM q),
    o AS (SELECT *, CASE WHEN part IS NULL THEN ['GEN', 'ENR', 'AD'] WHEN part = 'GEN' THEN ['GEN', 'ENR', 'AD'] ELSE ['AD', 'GEN', 'ENR'] END AS po, CASE WHEN ref = 'AIRSPACE' THEN ['AIRSPACE', 'NATIONAL'] ELSE ['NATIONAL', 'AIRSPACE'] END AS ro FROM p),
    e AS (SELECT conv_id, turn, s, po, ro, unnest(range(CASE WHEN s = 0 THEN 3 ELSE 6 END)) AS a FROM o)
    SELECT conv_id || '-' || turn AS query_id, CAST(a AS INT) AS attempt, CASE WHEN s = 0 THEN ['AD', 'ENR', 'GEN'][CAST(a AS INT) + 1] ELSE po[CAST(a % 3 AS INT) + 1] END AS part, CASE WHEN s = 0 THEN 'DN' || conv_id ELSE ro[CAST(a // 3 AS INT) + 1] END AS reference FROM e"""
)
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """which parts and references a question tries, in order."""
    c, t = F.col("conv_id"), F.col("turn")
    q = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", c, t).alias("query_id"), F.when((c + t) % 3 == 0, F.concat(F.lit("DN"), c)).alias("scope_id"),
        F.when(c % 4 == 0, "GEN").when(c % 4 == 1, "AD").alias("preferred_part"), F.when(t % 3 == 0, "NATIONAL").when(t % 3 == 1, "AIRSPACE").alias("preferred_reference"),
    )
    return retrieve.search_attempts(q)


@query(
    """WITH c AS (SELECT lang AS reference, source, doc_id, md5(coalesce(text, '')) AS h FROM documents WHERE lang IS NOT NULL AND doc_id % 4 < 2)
    SELECT reference, string_agg(h, chr(10) ORDER BY CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id // 10 END, doc_id, h) AS text, 'family' AS mode FROM c WHERE doc_id % 4 = 0 GROUP BY reference
    UNION ALL SELECT reference, string_agg(h, chr(10) ORDER BY CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id // 10 END, doc_id, h), 'prefix' FROM c GROUP BY reference"""
)
def texts_of_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: a section's chunks in page order; its family leaves out sections whose number only begins alike."""
    k = F.col("doc_id")
    c = table(spark, sf_dir, "documents").where("lang is not null").select(
        F.col("lang").alias("reference"), F.when(k % 4 == 0, "AD 2.2").when(k % 4 == 1, "AD 2.21").otherwise("AD 2.3").alias("section"),
        F.when(k % 5 > 0, F.floor(k / 10).cast("int")).alias("source_page"), k.cast("int").alias("source_chunk"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"),
    )
    return retrieve.section_texts(c, "AD 2.2", "family").withColumn("mode", F.lit("family")).unionByName(retrieve.section_texts(c, "AD 2.2").withColumn("mode", F.lit("prefix")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS scope_id, p_size AS record_index, p_name AS name, CASE WHEN p_size % 3 > 0 THEN p_size * 10 END AS tora FROM part WHERE p_size % 2 = 0")
def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """typed records of a section; distances lose their unit."""
    s = F.col("p_size")
    record = F.to_json(F.struct(F.col("p_name").alias("name"), F.when(s % 3 > 0, s * 10).alias("tora_m")))
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("scope_id"), s.alias("record_index"), F.when(s % 2 == 0, "2.13").otherwise("2.12").alias("subsection"), record.alias("record"))
    return retrieve.records_for(r, "2.13", "name string, tora_m int")


#: Customers ask for a place; the cases go round by their key.
PLACES = """k AS (SELECT c_custkey AS query_id, CAST(c_custkey % 19 AS INT) AS t, c_nationkey AS n, c_custkey % 2 = 0 AS even FROM customer)"""


@query(
    f"""WITH {PLACES} SELECT CAST(query_id AS BIGINT) AS query_id, CASE WHEN t IN (0, 5, 9, 11, 16) THEN 'scope' WHEN t IN (1, 2, 4, 8, 18) THEN 'national' WHEN t IN (10, 12) THEN 'ambiguous' WHEN t IN (6, 13) THEN 'out_of_scope' WHEN t = 7 THEN 'invalid' WHEN t IN (3, 14, 15, 17) THEN 'unresolved' END AS status,
      CASE t WHEN 0 THEN 'ENR_AIRSPACE' WHEN 5 THEN 'AD' WHEN 9 THEN 'AD' WHEN 11 THEN 'AD' WHEN 16 THEN 'ENR_POINT' WHEN 10 THEN 'aerodrome' WHEN 12 THEN 'scope' END AS scope_kind,
      CASE t WHEN 0 THEN 'KANO FIR' WHEN 5 THEN 'DNAA' WHEN 9 THEN 'DNAA' WHEN 11 THEN 'DNMM' WHEN 16 THEN 'ABCDE' WHEN 6 THEN 'DNXX' WHEN 13 THEN 'DNXX' WHEN 7 THEN 'DNQQ' END AS scope_id,
      CASE t WHEN 0 THEN 'ENR' WHEN 1 THEN 'ENR' WHEN 2 THEN 'GEN' WHEN 4 THEN 'ENR' WHEN 8 THEN 'ENR' WHEN 5 THEN 'AD' WHEN 9 THEN 'AD' WHEN 11 THEN 'AD' WHEN 16 THEN 'ENR' WHEN 18 THEN CASE WHEN even THEN 'ENR' ELSE 'GEN' END END AS part,
      CASE t WHEN 10 THEN 'DNAI,DNAL' WHEN 12 THEN 'DNAA,ABC' ELSE '' END AS candidates FROM k"""
)
def resolved_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what each kind of question about a place comes to, by a fixed order of rules; every rule occurs."""
    n, none = F.col("c_custkey"), F.lit(None).cast("string")
    asked = F.array(*[
        F.struct(F.lit(i).alias("intent"), F.lit(c).alias("code"), F.lit(x).alias("name"), F.lit(p).alias("preferred_part"))
        for i, c, x, p in (
            ("airspace_lookup", None, "Kano FIR", None), ("airspace_lookup", "DNAA", None, None), ("national_lookup", "DNAA", None, None), ("aerodrome_fact", None, None, None),
            ("aerodrome_fact", "DNKK", None, None), ("aerodrome_fact", " dnaa ", "Ikeja", None), ("runway_data", "DNXX", None, None), ("runway_data", "DNQQ", None, None),
            ("aerodrome_fact", None, "the en-route part", None), ("aerodrome_fact", None, "Abuja international", None), ("aerodrome_fact", None, "twin city", None), ("aerodrome_fact", "nonsense", "Lagos", None),
            ("aerodrome_fact", None, "ABC", None), ("aerodrome_fact", None, "near Lomé Accra road", None), ("aerodrome_fact", None, "no such place", None), ("chart_retrieval", None, "  ", None),
            ("aerodrome_fact", None, "ab cde", None), ("icao_lookup", None, None, "ENR"), ("small_talk", None, None, None),
        )
    ])
    q = table(spark, sf_dir, "customer").select(n.alias("query_id"), F.element_at(asked, (n % 19 + 1).cast("int")).alias("a")).select("query_id", "a.*")
    q = q.withColumn("preferred_part", F.when((F.col("query_id") % 19 == 18) & (F.col("query_id") % 2 == 0), "ENR").otherwise(F.col("preferred_part")))
    aliases = names(spark, ("DNAA", "Abuja"), ("DNMM", "Lagos"), ("DNAI", "twin city"), ("DNAL", "Twin City"), ("DNAA", "ABC"), schema="scope_id string, alias string")
    published = names(spark, ("KANOFIR", "ENR_AIRSPACE", "KANO FIR"), ("ABCDE", "ENR_POINT", "ABCDE"), ("ABC", "ENR_NAVAID", "ABC"), schema="token string, scope_kind string, scope_id string")
    valid = names(spark, ("DNAA", "ABC"), ("DNMM", None), ("DNAI", None), ("DNAL", None), schema="scope_id string, ident string")
    lost = names(spark, ("DNXX", "Accra"), schema="scope_id string, place string")
    got = resolve.resolve_scope(q, aliases, published, valid, lost)
    return got.select("query_id", "status", "scope_kind", "scope_id", "part", F.array_join("candidates", ",").alias("candidates"))


@query(
    """WITH k AS (SELECT c_custkey AS query_id, CAST(c_custkey % 15 AS INT) AS t FROM customer)
    SELECT CAST(query_id AS BIGINT) AS query_id, CASE t WHEN 0 THEN 'aerodrome_fact' WHEN 1 THEN 'aerodrome_fact' WHEN 2 THEN 'chart_retrieval' WHEN 3 THEN 'chart_retrieval' WHEN 4 THEN 'procedure_lookup' WHEN 5 THEN 'icao_lookup' WHEN 6 THEN 'runway_data' WHEN 7 THEN 'aerodrome_fact' WHEN 8 THEN 'out_of_scope'
        WHEN 9 THEN 'general_greeting' WHEN 10 THEN 'aerodrome_fact' WHEN 11 THEN 'aerodrome_fact' WHEN 12 THEN 'out_of_scope' WHEN 13 THEN 'aerodrome_fact' ELSE 'small_talk' END AS intent,
      CASE t WHEN 0 THEN NULL WHEN 1 THEN 'DNMM' WHEN 2 THEN 'DNAA' WHEN 5 THEN 'DNMM' WHEN 6 THEN 'DNAA' WHEN 7 THEN 'DNMM' WHEN 8 THEN 'DNMM' WHEN 13 THEN 'DNXX' END AS code FROM k"""
)
def corrected_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corrections of what was extracted from a question; every rule occurs."""
    k = F.col("c_custkey")
    asked = F.array(*[
        F.struct(F.lit(i).alias("intent"), F.lit(c).alias("code"), F.lit(x).alias("name"), F.lit(r).alias("raw"))
        for i, c, x, r in (
            ("aerodrome_fact", "DNQQ", None, "how high is it"), ("aerodrome_fact", None, None, "elevation of DNMM please"), ("aerodrome_fact", "dnaa", None, "ILS approach"), ("national_lookup", None, None, "which charts are there"),
            ("procedure_lookup", None, None, "approach by ILS somewhere"), ("out_of_scope", None, None, "what is the ICAO code for Lagos"), ("out_of_scope", "DNAA", None, "how many runways are there"), ("out_of_scope", None, None, "the elevation in Lagos"),
            ("out_of_scope", None, None, "weather right now in Lagos"), ("general_greeting", None, None, "Good morning!"), ("general_greeting", None, None, "hello, elevation?"), ("out_of_scope", None, "KADUNA", "where is it"),
            ("out_of_scope", None, None, "who won the match"), ("aerodrome_fact", "DNXX", None, "elevation"), ("small_talk", None, None, "nice"),
        )
    ])
    q = table(spark, sf_dir, "customer").select(k.alias("query_id"), F.element_at(asked, (k % 15 + 1).cast("int")).alias("a")).select("query_id", "a.*")
    aliases = names(spark, ("DNAA", "Abuja"), ("DNMM", "Lagos"), schema="scope_id string, alias string")
    valid = names(spark, ("DNAA",), ("DNMM",), schema="scope_id string")
    lost = names(spark, ("DNXX",), schema="scope_id string")
    published = names(spark, ("KADUNA",), schema="token string")
    return route.intent_backstops(q, aliases, valid, lost, published).select("query_id", "intent", "code")


@query(
    """WITH t AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS keyword, min(p_size) OVER (PARTITION BY string_split(p_name, ' ')[1]) AS rank FROM part),
    q AS (SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS w FROM part), b AS (SELECT p_partkey, arg_min(keyword, (rank, keyword)) AS keyword FROM q JOIN t ON contains(p_name, keyword) WHERE p_partkey % 3 < 2 GROUP BY p_partkey)
    SELECT CAST(q.p_partkey AS BIGINT) AS query_id, 'REF ' || keyword AS reference, upper(keyword) AS title FROM q LEFT JOIN b USING (p_partkey)"""
)
def toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first entry of a table of contents whose keyword a question about structure holds, within words too."""
    p = table(spark, sf_dir, "part")
    word = F.split("p_name", " ")[0]
    toc = p.groupBy(word.alias("keyword")).agg(F.min("p_size").alias("rank")).select("rank", "keyword", F.concat(F.lit("REF "), "keyword").alias("reference"), F.upper("keyword").alias("title"))
    k = F.col("p_partkey")
    asks = F.when(k % 3 == 0, "Which section has the ").when(k % 3 == 1, "where in the AIP is the ").otherwise("tell me about the ")
    q = p.select(k.alias("query_id"), F.concat(asks, F.col("p_name"), F.lit("?")).alias("question"))
    return resolve.toc_lookup(q, toc).select("query_id", "reference", "title")


FLAT = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT doc_id, {FLAT} AS t FROM documents), n AS (SELECT *, instr(lower(t), 'that') AS a, instr(lower(t), 'que') AS b FROM t),
    x AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN least(a, b) WHEN a > 0 THEN a WHEN b > 0 THEN b END AS lo, greatest(a, b) AS hi FROM n), s AS (SELECT *, greatest(lo - 1 - 90, 0) AS st FROM x), e AS (SELECT *, least(greatest(hi - 1 + 210, st), st + 500, length(t)) AS en FROM s)
    SELECT doc_id, CASE WHEN length(t) <= 500 THEN t WHEN lo IS NOT NULL THEN CASE WHEN st > 0 THEN '… ' ELSE '' END || trim(substr(t, CAST(st + 1 AS BIGINT), CAST(en - st AS BIGINT))) || CASE WHEN en < length(t) THEN ' …' ELSE '' END ELSE trim(substr(t, 1, 500)) || ' …' END AS shown FROM e"""
)
def focused_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a window of a text around what was asked for."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", focus_window(F.col("text"), F.array(F.lit("THAT"), F.lit("que"))).alias("shown"))


@query(
    """WITH r AS (SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_size % 4 < 3)
    SELECT CAST(p_partkey AS BIGINT) AS query_id, 1 AS field_no, 'Name' AS label, p_name AS value FROM r UNION ALL SELECT p_partkey, 2, 'Brand of it', p_brand FROM r UNION ALL SELECT p_partkey, 3, 'RWY data', CASE WHEN p_size % 4 = 0 THEN 'of' ELSE p_type END FROM r
    UNION ALL SELECT p_partkey, 4, 'RWY length', p_size || ' m' FROM r WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, 5, 'RWY surface', p_type FROM r WHERE p_size % 4 = 0"""
)
def field_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts of 'key=value' pairs as fields; pairs inside a value go under their entity."""
    s = F.col("p_size")
    last = F.when(s % 4 == 0, F.concat(F.lit("RWY data=of length="), s, F.lit(" m surface="), F.col("p_type"))).otherwise(F.concat(F.lit("RWY data="), F.col("p_type")))
    body = F.concat(F.lit("Aerodrome: Name="), F.col("p_name"), F.lit("; Brand  of it="), F.col("p_brand"), F.lit("; "), last)
    text = F.when(s % 4 == 3, F.concat(F.lit("Remarks: Name="), "p_name")).otherwise(body)
    f = verify.parse_field_table(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), text.alias("text")))
    return f.select("query_id", "field_no", "label", "value")


@query(
    """WITH f AS (SELECT p_partkey AS q, unnest(range(1, 5)) AS n, p_size % 3 AS s FROM part),
    c AS (SELECT *, CASE CAST(n AS INT) WHEN 1 THEN CASE s WHEN 0 THEN 20 + 8 + 6 ELSE 8 + 6 END WHEN 2 THEN CASE s WHEN 0 THEN -1 ELSE 8 + 6 END WHEN 3 THEN 3 + 1 ELSE 0 END AS score FROM f)
    SELECT CAST(q AS BIGINT) AS query_id, CAST(n AS INT) AS field_no, CAST(score AS INT) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, n) AS INT) AS rank, n = 1 AND s = 0 AS lead FROM c"""
)
def ranked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fields by how well they fit a question; ends that disagree fall behind, ties give no lead."""
    p, s = table(spark, sf_dir, "part"), F.col("p_size") % 3
    rows = F.array(*[F.struct(F.lit(n).alias("field_no"), F.lit(x).alias("label"), F.lit(v).alias("value")) for n, x, v in ((1, "runway lengths 18L", "3000 m"), (2, "Runway length 36R", "2000 m"), (3, "width of strip", "runway 30 m"), (4, "hours", "H24"))])
    f = p.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("runway length"), F.when(s == 0, " 18L").otherwise(""), F.lit(" width in Kano")).alias("query"), F.lit("Kano").alias("place"), F.explode(rows).alias("f")).select("query_id", "query", "place", "f.*")
    # 'width' stands in the third label, 'runway' in its value; 'length width' is a pair that no field has
    return verify.rank_fields(f).select("query_id", "field_no", "score", "rank", "lead")


@query(
    """WITH k AS (SELECT c_custkey, c_name, CAST(c_custkey % 6 AS INT) AS t FROM customer)
    SELECT CAST(c_custkey AS BIGINT) AS request_id, '18L' AS runway, 'VOR/DME RWY' AS type, 'hold at ' || c_name || ' for long' AS holding, 'descend with ' || c_name || ' in sight' AS letdown, 'climb back to ' || c_name AS missed FROM k WHERE t IN (0, 1)"""
)
def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the parts of the one approach that a request names; none if it is not just one, or a part is missing."""
    k, n = F.col("c_custkey"), F.col("c_name")
    t = k % 6

    def block(runway: str, kind: str, missed: Column) -> Column:
        return F.concat(
            F.lit(f"Instrument approach procedures for RWY {runway} based on {kind}\\n".replace("\\n", "\n")), F.lit("2.22.3.1 Holding procedures: hold at "), n, F.lit(" for long\n2.22.3.2 Letdown procedures - descend with "), n, F.lit(" in sight.\n2.22.3.3 "), missed,
            F.lit("\n2.22.4 Radar Procedures\nnot this\n"),
        )

    back = F.when(t == 2, "missing").when(t == 3, F.concat(F.lit("Missed approach: climb A 1200 (900) 3000 to "), n)).otherwise(F.concat(F.lit("Missed approach procedure climb back to "), n))
    text = F.concat(block("18L", "VOR/DME RWY", back), block("18R", "VOR/DME RWY", back), F.when(t == 4, block("18L", "VOR/DME RWY", back)).otherwise(""))
    c = table(spark, sf_dir, "customer")
    requests = c.select(k.alias("request_id"), k.alias("scope_id"), F.when(t == 1, "18L ").otherwise("18l").alias("runway"), F.when(t == 5, "ils").when(t == 1, "").otherwise("VOR").alias("type_asked"))
    return route.procedure_sections(requests, c.select(k.alias("scope_id"), text.alias("text")))


@query(
    """SELECT CAST(c_custkey AS BIGINT) AS query_id, CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN c_name || ' is preferred' WHEN 1 THEN 'visibility 5 km at ' || c_name WHEN 2 THEN 'call ' || c_name WHEN 3 THEN NULL ELSE 'about ' || c_name END AS shown FROM customer"""
)
def info_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the text under the heading whose words a question holds."""
    k, n = F.col("c_custkey"), F.col("c_name")
    text = F.concat(F.lit("2.22.1 General\nabout "), n, F.lit("\n2.22.2 Runway in use\n"), n, F.lit("  is preferred\n\nAD 2-DNAA-17\n2.22.5 Procedures for VFR flights: call "), n, F.lit(".\n2.22.6.1 VFR weather minima\nvisibility 5 km at "), n)
    question = one_of(k, ("which RUNWAY is in use", "vfr minima?", "VFR", "radar", "in general"))
    return table(spark, sf_dir, "customer").select(k.alias("query_id"), route.info_block(text, question).alias("shown"))


@query(
    """WITH d AS (SELECT p_partkey AS scope_id, p_size, unnest(['18L', '18R', '05']) AS runway FROM part), r AS (SELECT p_partkey AS request_id, CAST(p_size % 4 AS INT) AS t FROM part),
    j AS (SELECT request_id, runway, t, p_size, unnest(['TORA', 'TODA', 'ASDA', 'LDA']) AS metric FROM r JOIN d ON request_id = scope_id WHERE t = 0 OR (t = 1 AND runway IN ('18L', '18R')) OR (t = 2 AND runway = '18R') OR (t = 3 AND runway = '05'))
    SELECT CAST(request_id AS BIGINT) AS request_id, runway, metric, CASE metric WHEN 'TORA' THEN p_size * 10 || ' m' WHEN 'TODA' THEN 'not published' WHEN 'ASDA' THEN p_size * 12 || ' m' ELSE '900 m' END AS shown FROM j WHERE t <> 2 OR metric IN ('TODA', 'LDA')"""
)
def distance_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distances asked for, or all; a runway without a side is both."""
    p, s = table(spark, sf_dir, "part"), F.col("p_size")
    none = F.lit(None).cast("int")
    d = p.select(F.col("p_partkey").alias("scope_id"), F.explode(F.array(F.lit("18L"), F.lit("18R"), F.lit("05"))).alias("runway"), (s * 10).alias("tora"), none.alias("toda"), (s * 12).alias("asda"), F.lit(900).alias("lda"))
    asked = F.when(s % 4 == 1, "18").when(s % 4 == 2, "18R").when(s % 4 == 3, "5")
    r = p.select(F.col("p_partkey").alias("request_id"), F.col("p_partkey").alias("scope_id"), asked.alias("runway"), F.when(s % 4 == 2, F.array(F.lit("TODA"), F.lit("LDA"))).when(s % 4 == 1, F.array().cast("array<string>")).alias("metrics"))
    return retrieve.distances_reply(r, d)


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS doc_id, 1 AS page, upper('Aerodrome chart ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' RWY ' || p_size ELSE '' END) AS title FROM part"""
)
def chart_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text at the top of a page, without boilerplate."""
    p, s = table(spark, sf_dir, "part"), F.col("p_size")
    block = lambda top, text: F.struct(F.lit(float(top)).alias("top"), text.alias("text"))
    more = F.when(s % 2 == 0, F.concat(F.lit("Rwy "), s)).otherwise(F.lit(""))
    blocks = F.array(block(150, F.lit("not the title")), block(60, more), block(20, F.lit("AD 2-DNAA-17 Nigeria AIP  Nigerian Airspace Management Agency")), block(40, F.concat(F.lit("Aerodrome\n chart "), "p_name")))
    b = p.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(800.0).alias("height"), F.explode(blocks).alias("b")).select("doc_id", "page", "height", "b.*")
    return charts.title_zone(b)


INDEXED = """i AS (SELECT p_brand AS section_id, CAST(p_size % 12 + 1 AS INT) AS ref, max_by('ILS RWY 18L Chart ' || p_name, p_partkey) AS name FROM part WHERE p_size % 3 > 0 AND p_brand <> 'Brand#5' GROUP BY ALL)"""


def chart_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index pages of each brand: chart entries and others."""
    p, s = table(spark, sf_dir, "part").where("p_brand <> 'Brand#5'"), F.col("p_size")
    name = F.when(s % 3 > 0, F.concat(F.lit("ILS RWY 18L Chart  "), F.col("p_name"))).otherwise("Textual data")
    entry = F.concat(name, F.lit(" AD 2-"), F.col("p_brand"), F.lit("-"), (s % 12 + 1).cast("string"), F.lit("\n"))
    one = F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e"))))
    text = F.concat(F.lit("Charts related to an aerodrome Chart name Page "), F.array_join(F.transform(one, lambda x: x["e"]), ""))
    return charts.chart_index(p.groupBy(F.col("p_brand").alias("section_id")).agg(text.alias("text")))


@query(f"WITH {INDEXED} SELECT section_id, ref, name FROM i")
def chart_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of printed chart indexes."""
    return chart_entries(spark, sf_dir)


@query(
    f"""WITH {INDEXED}, p AS (SELECT p_partkey, p_brand, p_size, p_name, CAST(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE p_partkey % 14 END AS INT) AS ref FROM part WHERE p_partkey % 9 > 0)
    SELECT CAST(p_partkey AS BIGINT) AS doc_id, section_id, p.ref, 'ILS Approach Chart' AS procedure_type, '18L' AS runway FROM p JOIN i ON p_brand = section_id AND p.ref = i.ref
    UNION ALL SELECT p_partkey, p_brand, ref, CASE WHEN p_size % 2 = 0 THEN 'VOR Approach Chart' ELSE 'Aerodrome Chart' END, CASE WHEN p_size % 2 = 0 THEN '05' ELSE '' END FROM p WHERE p_brand = 'Brand#5' AND p_size % 5 > 0"""
)
def matched_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart pages by their own number in an index, or by title where a section has none."""
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    body = F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("AD 2-"), F.col("p_brand"), F.lit("-"), (k % 14).cast("string"), F.lit(" "), F.when((s % 5 > 0) & (s % 2 == 1), "Aerodrome chart").otherwise("plan")))
    title = F.when((s % 5 > 0) & (s % 2 == 0), "VOR RWY 05").otherwise("")
    pages = p.select(k.alias("doc_id"), F.lit(1).alias("page"), F.col("p_brand").alias("section_id"), body.alias("text"), title.alias("title"), F.lit(False).alias("is_index"))
    index_pages = pages.withColumn("is_index", F.lit(True))
    overrides = p.where("p_partkey % 7 = 0").select(k.alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("ref"))
    got = charts.match_charts(pages.unionByName(index_pages), chart_entries(spark, sf_dir), overrides)
    return got.select("doc_id", "section_id", "ref", "procedure_type", "runway")


@query(
    """WITH c AS (SELECT DISTINCT p_brand AS section_id, CAST(p_size % 4 AS INT) AS t, lpad(CAST(p_size % 3 + 1 AS VARCHAR), 2, '0') || 'L' AS runway FROM part), r AS (SELECT c_custkey, 'Brand#' || c_custkey % 30 AS section_id, CAST(c_custkey % 5 AS INT) AS a, CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN '02' WHEN 1 THEN '09' END AS asked FROM customer),
    j AS (SELECT c_custkey, t, runway, coalesce(asked = substr(runway, 1, 2), false) AS x FROM r JOIN c USING (section_id) WHERE a = 4 OR (a = 0 AND t = 0) OR (a = 1 AND t = 1) OR (a = 2 AND t IN (0, 1)) OR (a = 3 AND t = 3))
    SELECT CAST(c_custkey AS BIGINT) AS request_id, ['ILS Approach Chart', 'RNAV Approach Chart', 'Aerodrome Chart', 'SID Chart - Departure'][t + 1] AS procedure_type, runway FROM (SELECT *, bool_or(x) OVER (PARTITION BY c_custkey) AS any_x FROM j) WHERE x OR NOT any_x"""
)
def requested_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's charts that match a request's words; those for its runway alone, if there are any."""
    p, s, k = table(spark, sf_dir, "part"), F.col("p_size"), F.col("c_custkey")
    kind = one_of(s, ("ILS Approach Chart", "RNAV Approach Chart", "Aerodrome Chart", "SID Chart - Departure"))
    c = p.select(F.col("p_brand").alias("section_id"), kind.alias("procedure_type"), F.concat(F.lpad((s % 3 + 1).cast("string"), 2, "0"), F.lit("L")).alias("runway")).distinct()
    term = one_of(k, ("the ILS plate", "GNSS approach", "an approach plate", "departure", "whatever you have"))
    r = table(spark, sf_dir, "customer").select(k.alias("request_id"), F.concat(F.lit("Brand#"), k % 30).alias("section_id"), term.alias("term"), F.when(k % 3 == 0, "2").when(k % 3 == 1, "09").alias("runway"))
    return charts.charts_for_requests(r, c).select("request_id", "procedure_type", "runway")


@query(
    """WITH c AS (SELECT p_brand AS section_id, p_partkey AS name, CAST(p_size % 4 AS INT) AS t, CASE WHEN p_size % 3 = 0 THEN '18L' ELSE '05' END AS rwy FROM part), r AS (SELECT c_custkey, 'Brand#' || c_custkey % 30 AS section_id, CAST(c_custkey % 3 AS INT) AS a FROM customer),
    j AS (SELECT c_custkey, name, CASE WHEN t = 0 THEN [] WHEN t = 1 THEN ['ils'] WHEN t = 2 THEN ['ils', 'vor'] ELSE ['vor'] END AS types, CASE a WHEN 1 THEN 'ils' ELSE '' END AS key FROM r JOIN c USING (section_id) WHERE (a < 2 OR rwy = '18L') AND (a <> 1 OR t < 3))
    SELECT CAST(c_custkey AS BIGINT) AS request_id, CAST(name AS BIGINT) AS name, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN types = [key] THEN 0 ELSE 1 END, len(types), lpad(CAST(name AS VARCHAR), 9, '0')) AS INT) AS rank FROM j"""
)
def ranked_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific chart first."""
    p, s, k = table(spark, sf_dir, "part"), F.col("p_size"), F.col("c_custkey")
    types = F.when(s % 4 == 1, F.array(F.lit("ils"))).when(s % 4 == 2, F.array(F.lit("ils"), F.lit("vor"))).when(s % 4 == 3, F.array(F.lit("vor")))
    c = p.select(F.col("p_brand").alias("section_id"), F.array(F.when(s % 3 == 0, "18L").otherwise("05")).alias("runways"), types.alias("approach_types"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("name"))
    r = table(spark, sf_dir, "customer").select(k.alias("request_id"), F.concat(F.lit("Brand#"), k % 30).alias("section_id"), F.when(k % 3 == 1, "ILS").alias("term"), F.when(k % 3 == 2, "18").alias("runway"))
    return charts.rank_charts(r, c).select("request_id", F.col("name").cast("long").alias("name"), "rank")


@query(
    """SELECT CAST(c_custkey AS BIGINT) AS case_id, CASE CAST(c_custkey % 6 AS INT) WHEN 4 THEN 'CLARIFY_MISS' WHEN 5 THEN 'HARNESS_ERROR' ELSE 'CLARIFY_OK' END AS verdict FROM customer"""
)
def clarified_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: replies to open questions: asking back, listing what there is, or saying that there is nothing."""
    k, n = F.col("c_custkey"), F.col("c_name")
    reply = F.when(k % 6 == 0, F.concat(F.lit("Which runway do you mean, "), n, F.lit("?"))).when(k % 6 == 1, F.concat(F.lit("• "), n, F.lit("\n• other"))).when(k % 6 == 2, F.concat(F.lit("Length: "), n, F.lit("\nWidth of it: 45"))).when(k % 6 == 3, F.lit("that is NIL")).otherwise(n)
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "customer").select(k.alias("case_id"), F.lit("answer").alias("path"), F.lit("2.12").alias("subsection"), none.alias("match_mode"), none.alias("expected_value"), F.lit("clarify").alias("expected_behaviour"), reply.alias("reply"), (k % 6 == 5).alias("harness_error"))
    return evaluate.verdicts(rows).select("case_id", "verdict")


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(6.5 AS DOUBLE) AS latitude, CASE WHEN p_size % 3 > 0 THEN CAST(-3.25 AS DOUBLE) END AS longitude, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE CAST(1200 AS DOUBLE) END AS elevation_m, CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 3 AS DOUBLE) ELSE CAST(3900 AS DOUBLE) END AS elevation_ft, CASE WHEN p_size % 2 = 0 THEN CAST(31 AS DOUBLE) END AS ref_temp_c, p_size % 2 = 1 AS from_text FROM part"""
)
def geographic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position and elevation from their fields, else from the whole text."""
    s = F.col("p_size")
    field = F.when(s % 2 == 0, F.concat(s, F.lit(" m ("), s * 3, F.lit(" F T) / 31°C")))
    arp = F.concat(F.lit("063000N"), F.when(s % 3 == 1, " 0031500W").otherwise(""))
    text = F.concat(F.lit("ARP "), F.when(s % 3 == 2, "063000N 0031500W ").otherwise("063000N "), F.lit("elevation 1 200 m / 3 900 ft"))
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), arp.alias("arp"), field.alias("elevation"), text.alias("text"))
    return extract.geographic_record(r).select("doc_id", "latitude", "longitude", "elevation_m", "elevation_ft", "ref_temp_c", "from_text")
