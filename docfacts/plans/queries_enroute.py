"""Queries over entities of the en-route part, services and runways, each beside the SQL it must equal. Every row of a
table is an entity, which is printed as lines; which form it takes goes round by its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract
from .catalog import query, table


def letters(k: Column) -> Column:
    """A name of five letters for a number."""
    return F.concat(*[F.char(65 + F.floor(k / 26**i) % 26) for i in range(5)])


def _letters(k: str) -> str:
    return "(" + " || ".join(f"chr(CAST(65 + ({k}) // {26**i} % 26 AS INT))" for i in range(5)) + ")"


def printed(df: DataFrame, doc: Column, order: Column, texts: list[Column | str | None]) -> DataFrame:
    """Lines of sections: each row of df prints its texts in turn, those that are not null, one row a page."""
    as_column = lambda t: t if isinstance(t, Column) else F.lit(t)
    line = F.posexplode(F.array(*[as_column(t).cast("string") for t in texts])).alias("line", "text")
    return df.select(doc.alias("doc_id"), F.lit("X").alias("scope_id"), F.lit("5.1").alias("subsection"), order.alias("page"), line).where("text is not null")


ORDER = {"part": ("p_brand", "p_partkey"), "customer": ("c_nationkey", "c_custkey")}


def lines_of(spark: SparkSession, sf_dir: str, name: str, texts: list[Column | str | None]) -> DataFrame:
    doc, key = ORDER[name]
    return printed(table(spark, sf_dir, name), F.col(doc), F.col(key), texts)




@query(
    f"""WITH a AS (SELECT *, CAST(p_partkey % 4 AS INT) AS t, p_partkey % 1000 AS n FROM part)
    SELECT p_brand AS doc_id, 'DN' || CASE t WHEN 0 THEN 'P' WHEN 1 THEN 'R' WHEN 2 THEN 'D' ELSE 'P' END || n AS entity_id, CASE t WHEN 1 THEN 'restricted' WHEN 2 THEN 'danger' ELSE 'prohibited' END AS family,
      CASE t WHEN 0 THEN {_letters("p_partkey")} || ' area' WHEN 2 THEN 'NAF Local flying' END AS name, CASE t WHEN 0 THEN 'coordinates' WHEN 1 THEN 'navaid_relative' WHEN 3 THEN 'coordinates' END AS position_kind,
      CASE t WHEN 0 THEN '063000N 0031500E;064000.5N 0032500E' WHEN 3 THEN '*063000N 0031500W' END AS coordinates, CASE t WHEN 0 THEN 'FL150' WHEN 1 THEN '3000 FT AMSL' WHEN 3 THEN 'UNL' END AS upper_limit, CASE WHEN t IN (0, 3) THEN 'GND' END AS lower_limit,
      CASE t WHEN 1 THEN 'one level only' WHEN 2 THEN 'no level' END AS warning,
      CASE t WHEN 0 THEN {_letters("p_partkey")} || ' area 063000N 0031500E 064000.5N 0032500E FL150 GND ' || p_name WHEN 1 THEN 'A circle of LAG VOR 5 NM up to 3000 FT AMSL' WHEN 2 THEN 'NAF Local flying. ' || p_name ELSE '*063000N 0031500W UNL GND' END AS lateral_limits FROM a"""
)
def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by their ids: family, name, position, levels."""
    part = F.col("p_partkey")
    t, n = part % 4, part % 1000
    pick = lambda *v: F.when(t == 0, v[0]).when(t == 1, v[1]).when(t == 2, v[2]).otherwise(v[3])
    none = F.lit(None).cast("string")
    texts = [
        F.concat(pick(F.lit("DNP"), F.lit("DNR "), F.lit("DND"), F.lit("DNP ")), n),
        pick(F.concat(letters(part), F.lit(" area")), F.lit("A circle of LAG VOR 5 NM up to"), F.concat(F.lit("NAF Local flying. "), F.col("p_name")), F.lit("*063000N 0031500W")),
        pick(F.lit("063000N 0031500E 064000.5N 0032500E"), F.lit("3000 FT AMSL"), none, F.lit("UNL  GND.")),
        pick(F.lit("FL150"), none, none, none),
        pick(F.concat(F.lit("GND "), F.col("p_name")), none, none, F.lit("5.1.2 RESTRICTED AREAS")),
    ]
    got = extract.area_rows(lines_of(spark, sf_dir, "part", texts))
    return got.select("doc_id", "entity_id", "family", "name", "position_kind", F.array_join("coordinates", ";").alias("coordinates"), "upper_limit", "lower_limit", "warning", "lateral_limits")


@query(
    f"""WITH p AS (SELECT *, CAST(p_partkey % 5 AS INT) AS t, {_letters("p_partkey")} AS name FROM part)
    SELECT p_brand AS doc_id, name AS entity_id, '063000N' AS latitude, CASE WHEN t = 1 THEN '0031500' ELSE '0031500.5E' END AS longitude, CASE t WHEN 0 THEN 'UA123, B45' WHEN 1 THEN 'B45' WHEN 2 THEN 'H/UM998' END AS routes, CASE t WHEN 0 THEN 'EX' END AS fra_relevance,
      CASE t WHEN 0 THEN p_name WHEN 2 THEN p_name WHEN 3 THEN 'IAD FIR only' END AS remarks, t = 1 AS coordinate_defect, CASE t WHEN 1 THEN 'no hemisphere' WHEN 2 THEN 'repeated name' END AS warning FROM p WHERE t < 4"""
)
def point_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of rows 'name latitude longitude tail'; the first row of a name counts."""
    part = F.col("p_partkey")
    t = part % 5
    tail = F.when(t == 0, F.concat(F.lit("UA123, B45 EX "), F.col("p_name"))).when(t == 1, "B45").when(t == 2, F.concat(F.lit("H/UM998 , "), F.col("p_name"))).otherwise("IAD FIR only")
    row = F.concat(F.when(t < 4, letters(part)).otherwise("ABCD"), F.lit(" 063000N "), F.when(t == 1, "0031500 ").otherwise("0031500.5E "), tail)
    texts = ["NAME-CODE designator and position", row, F.when(t == 2, F.concat(letters(part), F.lit(" 070000N 0040000E again")))]
    got = extract.regex_rows(lines_of(spark, sf_dir, "part", texts))
    return got.select("doc_id", "entity_id", "latitude", "longitude", "routes", "fra_relevance", "remarks", "coordinate_defect", "warning")


FAMILIES = f"""f AS (SELECT c_nationkey AS doc_id, c_custkey AS k, {_letters("c_custkey")} AS n, c_custkey % 2 = 0 AS two FROM customer)"""


@query(
    f"""WITH {FAMILIES} SELECT doc_id, n || ' FIR' AS name, NULL AS parent FROM f UNION ALL SELECT doc_id, n || ' SECTOR', n || ' FIR' FROM f UNION ALL SELECT doc_id, n || ' TMA', n || ' FIR' FROM f WHERE two
    UNION ALL SELECT doc_id, n || ' Control Area' || CASE WHEN two THEN ' (CTA)' ELSE '' END, NULL FROM f"""
)
def airspace_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airspaces that a section declares, with what they are part of."""
    key = F.col("c_custkey")
    n, two = letters(key), key % 2 == 0
    said = F.concat(F.lit("("), n, F.lit(" FIR consists of "), n, F.lit(" SECTOR"), F.when(two, F.concat(F.lit(" and "), n, F.lit(" TMA"))).otherwise(", runways"), F.lit(")"))
    texts = [said, F.concat(n, F.lit(" Control Area")), F.when(two, "(CTA)").otherwise("nothing else")]
    # declared names stand in one section each, since a section is read as one text
    df = table(spark, sf_dir, "customer")
    lines = printed(df, F.concat_ws(":", "c_nationkey", "c_custkey"), key, texts)
    return extract.discover_hierarchy(lines).select(F.split("doc_id", ":")[0].cast("int").alias("doc_id"), "name", "parent")


@query(
    f"""WITH {FAMILIES} SELECT doc_id, n || ' TMA' AS entity_id, CASE WHEN two THEN n || ' FIR' END AS parent, two AS is_grouping, '(note ' || n || ' (more) and on)' AS note, 'from 063000N 0031500E to the coast of ' || n AS lateral_limits, 'FL 195 / 1500 FT ALT' AS vertical_limits, 'D' AS airspace_class, 'H24' AS hours,
      n || ' CONTROL' AS ats_unit, 'EN / FR' AS languages, 'NIL / CPDLC LOGON ' || n AS remarks, '118.1 MHz / 124,3 MHz' AS frequencies FROM f"""
)
def airspace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands under an airspace's name, each line by its kind."""
    key = F.col("c_custkey")
    n, two = F.col("n"), key % 2 == 0
    texts = [
        F.concat(n, F.lit(" TMA is described below")), F.concat(n, F.lit(" TMA.")), F.concat(F.lit("(note "), n, F.lit(" (more)")), "and on)", "from 063000N 0031500E to", F.concat(F.lit("the coast of "), n), "FL 195", "Class of airspace: D", "1500 FT ALT", "H24", "EN", "118.1 MHz NIL", F.concat(n, F.lit(" CONTROL")), "FR", "EN",
        "124,3 MHz", "NIL", F.concat(F.lit("CPDLC LOGON "), n),
    ]
    # customers are dealt out by section before lines are made of them, and a name is spelt once; Spark would join parts
    # that are small before they are printed
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    doc = F.col("doc_id")
    df = table(spark, sf_dir, "customer").select(F.concat_ws(":", "c_nationkey", "c_custkey").alias("doc_id"), key).repartition(parts, "doc_id").withColumn("n", letters(key))
    h = df.select(doc, F.lit("X").alias("scope_id"), F.lit("5.1").alias("subsection"), F.concat(n, F.lit(" TMA")).alias("name"), F.when(two, F.concat(n, F.lit(" FIR"))).alias("parent"))
    child = df.where(two).select(doc, F.lit("X").alias("scope_id"), F.lit("5.1").alias("subsection"), F.concat(n, F.lit(" SECTOR")).alias("name"), F.concat(n, F.lit(" TMA")).alias("parent"))
    got = extract.airspace_fields(printed(df, doc, key, texts), h.unionByName(child))
    return got.select(F.split("doc_id", ":")[0].cast("int").alias("doc_id"), "entity_id", "parent", "is_grouping", "note", "lateral_limits", "vertical_limits", "airspace_class", "hours", "ats_unit", "languages", "remarks", "frequencies")


@query(
    """WITH s AS (SELECT c_custkey AS k, CAST(c_custkey % 3 AS INT) AS t, chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + c_custkey // 26 % 26 AS INT)) || chr(CAST(65 + c_custkey // 676 % 26 AS INT)) AS i FROM customer)
    SELECT CAST(k AS BIGINT) AS doc_id, i AS entity_id, CASE WHEN t = 2 THEN 'PORT ' || 'HARCOURT' ELSE 'KANO' END AS station, CASE t WHEN 0 THEN 'VOR/DME' WHEN 1 THEN 'NDB' ELSE 'ILS' END AS navaid_type, CASE t WHEN 0 THEN '113.5 MHZ / CH 82X' WHEN 1 THEN '340 kHz' ELSE '110.3 MHZ' END AS frequency, false AS frequency_is_ambiguous,
      CASE WHEN t < 2 THEN 'H24' END AS hours, '063000N 0031500E' AS coordinates, t = 2 AS coordinates_are_ambiguous, CASE t WHEN 0 THEN '30 m (98 ft)' END AS elevation, CASE t WHEN 1 THEN 'AD' END AS fra_relevance, CASE t WHEN 0 THEN 'on ' || k WHEN 1 THEN 'FRA (AD)' END AS remarks FROM s
    UNION ALL SELECT k, 'Z' || substr(i, 1, 2) || 'Q', 'PORT HARCOURT', 'DME', '110.4 MHZ', false, NULL, '063000N 0031500E', true, NULL, NULL, NULL FROM s WHERE t = 2"""
)
def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navaids of stations; where numbers do not agree a record carries the station's list, marked."""
    key = F.col("c_custkey")
    t = key % 3
    code = lambda d: F.char(65 + F.floor(key / d) % 26)
    i = F.concat(code(1), code(26), code(676))
    other = F.concat(F.lit("Z"), code(1), code(26), F.lit("Q"))
    none = F.lit(None).cast("string")
    pick = lambda *v: F.when(t == 0, v[0]).when(t == 1, v[1]).otherwise(v[2])
    texts = [
        "Name of station", pick(F.lit("KANO"), F.lit("KANO"), F.lit("PORT")), pick(none, none, F.lit("HARCOURT")),
        pick(F.lit("VOR/DME"), F.lit("NDB"), F.concat(F.lit("ILS "), i, F.lit(" 110.3 MHZ"))), pick(F.concat(i, F.lit(" 113.5 MHZ")), i, F.concat(F.lit("DME "), other, F.lit(" 110.4 MHZ"))),
        pick(F.lit("CH 82X"), F.lit("340 kHz"), none), pick(F.concat(F.lit("H24 063000N 0031500E 30 m (98 ft) on "), key), F.lit("H24 063000N 0031500E FRA (AD)"), F.lit("063000N 0031500E")),
    ]
    got = extract.station_navaids(printed(table(spark, sf_dir, "customer"), key, F.lit(1), texts))
    return got.select("doc_id", "entity_id", "station", "navaid_type", "frequency", "frequency_is_ambiguous", "hours", "coordinates", "coordinates_are_ambiguous", "elevation", "fra_relevance", "remarks")


@query(
    f"""WITH c AS (SELECT c_nationkey AS d, c_custkey AS k, CAST(c_custkey % 3 AS INT) AS t, {_letters("c_custkey")} AS n FROM customer)
    SELECT CAST(k AS BIGINT) AS doc_id, 'UA' || k % 900 AS entity_id, CASE WHEN t = 0 THEN 'RNAV 5' END AS navigation_spec, n || ' → KANO DVOR/DME' || CASE t WHEN 1 THEN ' → LAG' ELSE '' END AS point_sequence, CASE t WHEN 1 THEN 3 ELSE 2 END AS point_count,
      n || ':significant_point::063000N 0031500E;KANO DVOR/DME:navaid:KAN:064000N 0032500E' || CASE t WHEN 1 THEN ';LAG:navaid:LAG:070000N 0040000E' ELSE '' END AS points FROM c WHERE k % 900 > 99"""
)
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of routes in order; a name counts once its position follows, a header that comes again goes on."""
    key = F.col("c_custkey")
    n, t = letters(key), key % 3
    head = F.concat(F.lit("UA"), key % 900)
    texts = [
        F.when(t == 0, F.concat(head, F.lit(" (RNAV 5)"))).otherwise(head), "a name that nothing follows", n, "063000N 0031500E", F.when(t == 2, n), F.when(t == 2, "063000N 0031500E"), F.concat(F.lit("remark of more than sixty characters, which is no name of any point "), n), "KANO DVOR/DME (KAN)",
        "064000N 0032500E FL 250", F.when(t == 1, head), F.when(t == 1, "LAG"), F.when(t == 1, "070000N 0040000E"),
    ]
    got = extract.ordered_points(printed(table(spark, sf_dir, "customer").where("c_custkey % 900 > 99"), key, F.lit(1), texts))
    shown = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["name"], p["kind"], F.coalesce(p["ident"], F.lit("")), p["coordinates"])), ";")
    return got.select("doc_id", "entity_id", "navigation_spec", "point_sequence", "point_count", shown.alias("points"))


def direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    n, t = letters(key), key % 4
    texts = [
        F.concat(n, F.lit(" DCT BBBBB"), F.when(t == 1, " H24").when(t == 2, " 0600 - 1800").otherwise("")), F.when(t == 3, "DCT CCCCC"), F.when(t == 0, "H24"), n, "063000N 0031500E FL 450", "BBBBB", F.when(t == 1, "064000N 003250E").otherwise("064000N 0032500E"), F.when(t == 3, "CCCCX"), F.when(t == 3, "070000N 0040000E"),
        F.when(t == 2, "DDDDD"), F.when(t == 2, "071000N 0041000E"), "FL 245",
    ]
    return extract.direct_combinations(printed(table(spark, sf_dir, "customer"), F.col("c_nationkey"), key, texts))


DIRECT = f"""c AS (SELECT c_nationkey AS d, c_custkey AS k, CAST(c_custkey % 4 AS INT) AS t, {_letters("c_custkey")} AS n FROM customer)"""


@query(
    f"""WITH {DIRECT} SELECT d AS doc_id, n || CASE t WHEN 3 THEN '-CCCCX' ELSE '-BBBBB' END AS entity_id, n || ' DCT BBBBB' || CASE t WHEN 3 THEN ' DCT CCCCC' ELSE '' END AS dct, CASE t WHEN 0 THEN 'H24' WHEN 1 THEN 'H24' WHEN 2 THEN '0600 - 1800' END AS availability, n || ' → BBBBB' || CASE t WHEN 3 THEN ' → CCCCX' ELSE '' END AS point_sequence,
      CASE t WHEN 3 THEN 3 ELSE 2 END AS point_count, 'FL 450' AS upper_limit, 'FL 245' AS lower_limit, CASE t WHEN 1 THEN 1 ELSE 0 END AS corrected FROM c"""
)
def direct_routings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct routings with as many points as their header declares; a short longitude is padded and marked."""
    fixed = F.size(F.filter("points", lambda p: p["longitude_corrected"]))
    return direct(spark, sf_dir).select("doc_id", "entity_id", "dct", "availability", "point_sequence", "point_count", "upper_limit", "lower_limit", fixed.alias("corrected"))


@query(f"WITH {DIRECT} SELECT n || '-CCCCX' AS entity_id, n || ' DCT BBBBB DCT CCCCC' AS dct, n || ' → BBBBB → CCCCX' AS point_sequence FROM c WHERE t = 3")
def disagreeing_routings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct routings whose declared names differ from their points."""
    return extract.routing_self_agreement(direct(spark, sf_dir))


@query(
    """WITH s AS (SELECT s_suppkey AS k, CAST(s_suppkey % 3 AS INT) AS t FROM supplier)
    SELECT CAST(k AS BIGINT) AS doc_id, line, e FROM (SELECT k, 0 AS line, '18L' AS e FROM s UNION ALL SELECT k, 1, CASE WHEN t = 0 THEN '04' END FROM s UNION ALL SELECT k, 2, NULL FROM s UNION ALL SELECT k, 3, '04' FROM s UNION ALL SELECT k, 4, '18L' FROM s UNION ALL SELECT k, 5, CASE WHEN t = 1 THEN '04' END FROM s)"""
)
def marked_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runway ends that a heading opens; a bare number counts only for an end that was opened before."""
    k = F.col("s_suppkey")
    t = k % 3
    texts = ["18l 178.5 ° 3000 x 60", F.when(t == 0, "RWY 4 surface").otherwise("4 is the number of exits"), F.concat_ws(" ", F.lit("turn pads"), "s_name"), "RWY 04 threshold", "18L displaced by 300", F.when(t == 1, "4 stopway").otherwise(F.concat_ws(" ", F.lit("36 exits,"), "s_name"))]
    got = extract.confirmed_markers(printed(table(spark, sf_dir, "supplier"), k, F.lit(1), texts), [r"(?i)^(\d{1,2}[LRC]?)\s+\d{2,3}(?:\.\d+)?\s*°", r"(?i)^RWY\s+(\d{1,2}[LRC]?)\b"], r"(?i)^(\d{1,2}[LRC]?)\b(?!\s*\.)")
    return got.select("doc_id", "line", F.col("end").alias("e"))


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN p_size % 4 = 0 THEN 3000 + p_size WHEN p_size % 4 = 1 THEN 900 + p_size END AS length_m, CASE WHEN p_size % 4 = 0 THEN 60 WHEN p_size % 4 = 1 THEN 45 END AS width_m FROM part"""
)
def runway_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: lengths and widths that can be a runway's."""
    part, size = F.col("p_partkey"), F.col("p_size")
    text = F.when(size % 4 == 0, F.concat(F.lit("RWY "), F.lit("3 "), F.lpad(size.cast("string"), 3, "0"), F.lit(" x 60 asphalt"))).when(size % 4 == 1, F.concat(900 + size, F.lit("X45"))).when(size % 4 == 2, "250 x 30").otherwise(F.concat_ws(" ", F.lit("3000 x 120"), "p_name"))
    length, width = extract.runway_dims(text)
    return table(spark, sf_dir, "part").select(part.alias("doc_id"), length.alias("length_m"), width.alias("width_m"))


AIDS = """s AS (SELECT s_suppkey AS k, s_name AS n, CAST(s_suppkey % 3 AS INT) AS t FROM supplier)"""


def aid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = k % 3
    texts = [
        "VOR/ILS/MLS, CAT of aid", "ILS/DME KAN", F.when(t == 0, "110.3 MHz H24").when(t == 1, "109.1 0600 - 1800 MHz").otherwise("no value"), "063000.5N 0031500E", F.concat_ws(" ", F.lit("on request of"), "s_name"), F.when(t < 2, "340 KHz").otherwise("at night"), "NDB", "LA H24", "DVOR", "113.7 MHz",
    ]
    return printed(table(spark, sf_dir, "supplier"), k, F.lit(1), texts)


@query(
    f"""WITH {AIDS} SELECT CAST(k AS BIGINT) AS doc_id, instance, kind, n_lines FROM (SELECT k, 1 AS instance, 'ILS/DME' AS kind, CASE WHEN t < 2 THEN 4 ELSE 5 END AS n_lines FROM s UNION ALL SELECT k, 2, 'NDB', CASE WHEN t < 2 THEN 3 ELSE 2 END FROM s UNION ALL SELECT k, 3, 'DVOR', 2 FROM s)"""
)
def aid_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the navaid they belong to; a frequency printed above a navaid goes with it."""
    got = extract.number_instances(aid_lines(spark, sf_dir))
    return got.groupBy("doc_id", F.col("instance").cast("int").alias("instance"), "kind").agg(F.count("*").cast("int").alias("n_lines"))


@query(
    f"""WITH {AIDS} SELECT CAST(k AS BIGINT) AS doc_id, 'ILS/DME' AS aid_type, CAST(CASE t WHEN 0 THEN 110.3 WHEN 1 THEN 109.1 END AS DOUBLE) AS frequency, CASE WHEN t < 2 THEN 'MHZ' END AS freq_unit, CASE t WHEN 0 THEN 'H24' WHEN 1 THEN '0600 - 1800' END AS hours, round(CAST(6.5 + 0.5 / 3600 AS DOUBLE), 6) AS lat, CAST(3.25 AS DOUBLE) AS lon, CASE t WHEN 1 THEN 'number and unit apart' WHEN 2 THEN 'no frequency' END AS warning FROM s
    UNION ALL SELECT k, 'NDB', CASE WHEN t < 2 THEN 340.0 END, CASE WHEN t < 2 THEN 'KHZ' END, 'H24', NULL, NULL, CASE WHEN t = 2 THEN 'no frequency' END FROM s UNION ALL SELECT k, 'DVOR', 113.7, 'MHZ', NULL, NULL, NULL, NULL FROM s"""
)
def aids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of each navaid, each read on its own."""
    return extract.navaid_fields(aid_lines(spark, sf_dir)).select("doc_id", "aid_type", "frequency", "freq_unit", "hours", "lat", "lon", "warning")
