"""Queries over pages: classification, bands, columns, and sources that are written and read again."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.profile import AIP
from ..functions.text import multi_facility
from ..operators import chunks, extract, facts, structure
from ..sources import tables as src
from ..sources.stages import shared_dir
from .catalog import query, table
from .queries_search import LOG, event_log
from .queries_text import EVENT_PAGES, LINES, PAGED, event_pages, words


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docfacts-{name}-{uuid.uuid4().hex}"


def one_of(n: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


#: What the events' pages print, by event; the section a page lies in hangs on its user.
SHAPES = (
    "",
    "page INTENTIONALLY BLANK",
    "AD 2 - DNXX specimen",
    "DNAA AD 2.3 OPERATIONAL HOURS",
    "CHARTS RELATED TO AN AERODROME",
    "DNAA AD 2.24 CHARTS RELATED TO AN AERODROME",
    "AD 2-DNAA-17 plan",
    "AD 3-DNBB-5 routes",
    "AD 2-DNBB-6 CHARTS RELATED TO A HELIPORT",
    "AD 2-DNBB-6 pad",
    "DNAA AD 2.24 OTHER MATTERS",
    "GEN 0.1 - 3",
    "AD 1.2 - 4",
    "ENR 3.1 - 2",
    "GEN 2.1 - 7",
    "nothing of note",
)
SECTIONS = (("DNAA", "standard"), ("DNAB", "standard"), ("DNBB", "heliport"), ("DNCC", "special"))
PRINTED = f"""{EVENT_PAGES}, printed AS (SELECT doc_id, CAST(page AS INT) AS page, event_id, CAST(event_id % {len(SHAPES)} AS INT) AS t, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'DNAA' WHEN 1 THEN 'DNAB' WHEN 2 THEN 'DNBB' WHEN 3 THEN 'DNCC' END AS s, event_id % 7 = 3 AND event_id % 2 = 1 AS far FROM pages)"""


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the events' pages. Of seven pages one begins with many other words; half have a band at the top."""
    p = event_pages(spark, sf_dir)
    head = F.filter(F.split(one_of(F.col("event_id"), SHAPES), " "), lambda w: w != "")
    filler = F.when((F.col("event_id") % 7 == 3) & (F.size(head) > 0), F.array_repeat(F.col("event_type"), 45)).otherwise(F.array().cast("array<string>"))
    w = p.select("doc_id", "page", "event_id", F.size(filler).alias("n"), F.posexplode(F.concat(filler, head)).alias("word_no", "text"))
    banded = (F.col("event_id") % 2 == 0) & (F.col("word_no") >= F.col("n"))
    top = F.when(banded, 20.0).otherwise(100.0)
    return w.select("doc_id", "page", F.lit(0).alias("line_no"), "word_no", (F.col("word_no") * 30.0).alias("x0"), top.alias("top"), (F.col("word_no") * 30.0 + 25).alias("x1"), "text")


def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = printed(spark, sf_dir)
    where = F.when(F.col("doc_id") % 5 < 4, F.element_at(F.array(*[F.struct(F.lit(s).alias("section_id"), F.lit(k).alias("kind")) for s, k in SECTIONS]), (F.least(F.col("doc_id") % 5, F.lit(3)) + 1).cast("int")))
    pages = event_pages(spark, sf_dir).select("doc_id", "page", where.alias("s")).select("doc_id", "page", "s.*")
    return pages.join(structure.page_text(w), ["doc_id", "page"], "left").join(structure.header_blob(w), ["doc_id", "page"], "left")


CATEGORY = """CASE WHEN t <= 1 THEN 'BLANK' WHEN t = 2 THEN 'AD_SPECIMEN'
      WHEN s IN ('DNAA', 'DNAB') THEN CASE WHEN t IN (4, 5, 8) THEN 'CHART_INDEX' WHEN s = 'DNAA' AND t IN (3, 10) THEN 'AD_CONTENT' WHEN s = 'DNAA' AND t = 6 THEN 'CHART_PLATE' ELSE 'UNKNOWN' END
      WHEN s = 'DNBB' THEN CASE t WHEN 7 THEN 'AD3_HELIPORT_PROC' WHEN 8 THEN 'CHART_INDEX' WHEN 9 THEN 'CHART_PLATE' ELSE 'UNKNOWN' END
      WHEN s = 'DNCC' THEN 'SPECIAL_CHART_SECTION' WHEN far THEN 'UNKNOWN'
      ELSE CASE t WHEN 11 THEN 'FRONT_MATTER' WHEN 12 THEN 'AD_INTRO' WHEN 13 THEN 'ENR_CONTENT' WHEN 14 THEN 'GEN_CONTENT' ELSE 'UNKNOWN' END END"""


@query(
    f"""WITH {PRINTED}, c AS (SELECT *, {CATEGORY} AS category FROM printed)
    SELECT doc_id, page, category, CASE WHEN category IN ('AD_SPECIMEN', 'AD_CONTENT', 'CHART_INDEX', 'CHART_PLATE') THEN 'AD2' WHEN category = 'AD3_HELIPORT_PROC' THEN 'AD3' WHEN category IN ('FRONT_MATTER', 'GEN_CONTENT') THEN 'GEN' WHEN category = 'AD_INTRO' THEN 'AD' WHEN category = 'ENR_CONTENT' THEN 'ENR' END AS part,
      CASE WHEN category = 'AD_CONTENT' THEN CASE t WHEN 3 THEN '2.3' ELSE '2.24' END WHEN category = 'ENR_CONTENT' THEN '3' WHEN category = 'GEN_CONTENT' THEN '2' END AS seq FROM c"""
)
def classified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of each page by its text, the band at its top and the section it lies in."""
    return structure.classify_pages(printed_pages(spark, sf_dir)).select("doc_id", "page", "category", "part", "seq")


@query(
    f"""WITH {PRINTED} SELECT doc_id, page, CASE WHEN s = 'DNAA' AND t = 6 THEN 17 WHEN s = 'DNBB' AND t = 7 THEN 5 WHEN s = 'DNBB' AND t IN (8, 9) THEN 6 END AS reference,
      CASE WHEN s = 'DNAA' AND t = 6 THEN '2' WHEN s = 'DNBB' AND t = 7 THEN '3' WHEN s = 'DNBB' AND t IN (8, 9) THEN '2' END AS part, t IN (4, 5, 8) AS is_index FROM printed WHERE t > 0"""
)
def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number and part that a page prints for itself, and whether it is an index."""
    p = printed_pages(spark, sf_dir).where("text is not null")
    t, s = F.col("text"), F.col("section_id")
    return p.select("doc_id", "page", structure.own_reference(t, s).alias("reference"), structure.own_part(t, s).alias("part"), structure.is_index_page(t).alias("is_index"))


@query(
    f"""WITH {EVENT_PAGES}, k AS (SELECT doc_id, page, event_id, event_type FROM pages WHERE event_type <> 'error'),
    b AS (SELECT *, CASE WHEN lag(page) OVER (PARTITION BY doc_id ORDER BY page) = page - 1 THEN 0 ELSE 1 END AS broken FROM k), i AS (SELECT *, sum(broken) OVER (PARTITION BY doc_id ORDER BY page) AS island FROM b),
    o AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '2.22' WHEN 1 THEN '2.3' ELSE '2.4' END END IGNORE NULLS) OVER (PARTITION BY doc_id, island ORDER BY page) AS subsection FROM i)
    SELECT doc_id, subsection, string_agg(CASE WHEN event_type = 'signup' THEN 'AD ' || subsection || ' START' ELSE 'event ' || event_id END, ' ' ORDER BY page) AS text FROM o WHERE subsection <> '2.22' GROUP BY ALL"""
)
def joined_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each section joined over its pages, excluded sections left out."""
    p = event_pages(spark, sf_dir)
    head = F.concat(F.lit("AD "), one_of(F.col("event_id"), ("2.22", "2.3", "2.4")), F.lit(" START"))
    lines = p.select("doc_id", "page", F.lit(0).alias("line"), F.when(F.col("event_type") == "signup", head).otherwise(F.concat(F.lit("event   "), F.col("event_id"))).alias("text"))
    classes = p.select("doc_id", "page", F.when(F.col("event_type") == "error", "CHART_PLATE").otherwise("AD_CONTENT").alias("category"), F.lit("DNAA").alias("section_id"))
    return structure.section_text(structure.segment_sections(lines, classes)).select("doc_id", "subsection", "text")


@query(f"WITH {PAGED} SELECT doc_id, page, line_no % 40 AS line, CAST((line_no % 40) * 12 + 20 + page * 2000 AS DOUBLE) AS position FROM paged")
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position for lines of several pages."""
    l = structure.visual_lines(words(spark, sf_dir))
    return l.select("doc_id", "page", ((F.col("top") - 20) / 12).cast("long").alias("line"), structure.reading_position(F.col("page"), F.col("top")).alias("position"))


@query(
    f"""WITH {LINES}, p AS (SELECT doc_id, CAST(line_no // 40 + 1 AS INT) AS page, (line_no % 40) * 12.0 + 20 AS top, text FROM lines WHERE trim(text) <> '' AND doc_id % 3 > 0),
    a AS (SELECT *, min(CASE WHEN contains(text, ' the ') THEN top END) OVER (PARTITION BY doc_id, page) AS lo FROM p), b AS (SELECT *, min(CASE WHEN starts_with(text, 'A') AND top > lo THEN top END) OVER (PARTITION BY doc_id, page) AS hi FROM a)
    SELECT doc_id, page, CAST(top AS DOUBLE) AS top, text FROM b WHERE top >= lo - 2 AND (hi IS NULL OR top < hi - 2)"""
)
def salvaged_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands from a header to the next heading, on pages of sections that were not found."""
    lines = src.text_lines(table(spark, sf_dir, "documents")).where("trim(text) <> ''")
    p = lines.select("doc_id", F.lit("x").alias("section_id"), (F.floor(F.col("line_no") / 40) + 1).cast("int").alias("page"), ((F.col("line_no") % 40) * 12.0 + 20).cast("double").alias("top"), "text")
    segments = p.where("doc_id % 3 = 0").select("doc_id", "section_id")
    return structure.salvage_band(p, segments, " the ", "^A").select("doc_id", "page", "top", "text")


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 IN (1, 2) THEN p_name WHEN p_size % 5 = 3 THEN p_name || ' ' || p_type ELSE p_name || ', ' || p_type END AS cell FROM part"""
)
def tidy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without the table's title and reprinted header rows."""
    s, title, head = F.col("p_size") % 5, F.lit("DNAA AD 2.14 APPROACH AND RUNWAY LIGHTING"), F.lit("RWY APCH LGT type len INTST 1 2 3 4 5 6 7 8 9")
    cell = F.when(s == 0, F.concat(title, F.lit("  ; "), head)).when(s == 1, F.concat_ws(" ", title, "p_name")).when(s == 2, F.concat_ws(" ", head, "p_name", F.lit(";")))
    cell = cell.when(s == 3, F.concat_ws("   ", "p_name", head, "p_type")).otherwise(F.concat(F.lit(". "), F.col("p_name"), F.lit(", "), F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", structure.drop_table_furniture(cell).alias("cell"))


@query(f"WITH {EVENT_PAGES} SELECT doc_id, CAST(page AS INT) AS page FROM pages WHERE event_id % 4 IN (0, 3)")
def headed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose start prints the section's own number; a contents line or another section does not."""
    n = F.col("event_id")
    text = F.when(n % 4 == 0, F.concat(F.lit("  ENR 5.1 - "), n, F.lit(" areas"))).when(n % 4 == 1, F.concat(F.lit("areas ... ENR 5.1 - "), n)).when(n % 4 == 2, "ENR 5.11 - 3 birds").otherwise("ENR5.1-9")
    return structure.select_pages_by_header(event_pages(spark, sf_dir).select("doc_id", "page", text.alias("text")), "5.1").select("doc_id", "page")


@query(
    f"""WITH {PAGED}, w AS (SELECT doc_id, page, line_no, w, unnest(range(1, len(w) + 1)) AS i FROM paged), x AS (SELECT *, w[i] AS word, length(array_to_string(w[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS pos FROM w),
    l AS (SELECT doc_id, page, line_no, trim(regexp_replace(regexp_replace(string_agg(word, ' ' ORDER BY i), '(?i)\\b(the|de)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM x WHERE pos * 6 < 100 GROUP BY ALL)
    SELECT doc_id, page, CAST((line_no % 40) * 4 + 7 AS INT) AS line, text FROM l WHERE trim(regexp_replace(regexp_replace(text, '(?i)\\b(and|of|la|le)\\b', '', 'g'), '[.,!]', '', 'g')) <> ''"""
)
def left_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a column's words, without what bleeds in from the next one, and furniture."""
    profile = replace(AIP, chrome=(r"(?i)\b(and|of|la|le)\b", r"[.,!]"))
    return structure.column_slice(words(spark, sf_dir), 100.0, r"(?i)\b(the|de)\b", profile).select("doc_id", "page", "line", "text")


@query(f"WITH {PAGED} SELECT doc_id, page, CAST(sum(len(w)) AS BIGINT) AS n FROM paged GROUP BY doc_id, page")
def stored_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: words that were written and are read again; blank ones are dropped."""
    path = scratch(spark, "words")
    w = words(spark, sf_dir)
    blank = w.where("word_no = 0").withColumn("text", F.lit("  "))
    w.unionByName(blank).write.parquet(path)
    return src.read_words(spark, path).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query("SELECT conv_id || '-' || turn AS id, role AS category, text AS question, CASE WHEN turn % 2 = 0 THEN 'say \"' || role || '\", then' || chr(10) || 'stop' END AS ground_truth, CASE WHEN turn % 3 = 0 THEN '  ' || role || ' ' ELSE '' END AS test_type FROM conversations")
def read_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: test cases with quotes, line ends, outer blanks, empty and missing texts, from CSV."""
    path = scratch(spark, "cases")
    c = table(spark, sf_dir, "conversations")
    truth = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('say "'), "role", F.lit('", then\nstop')))
    kind = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), "role", F.lit(" "))).otherwise("")
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("category"), F.col("text").alias("question"), truth.alias("ground_truth"), kind.alias("test_type"))
    src.write_cases_csv(rows, path)
    return src.read_eval_csv(spark, path)


@query(
    "SELECT conv_id || '-' || turn AS id, CAST(turn AS VARCHAR) AS turn, substr(regexp_replace(text, '\\r?\\n', ' ⏎ ', 'g'), 1, 200) AS reply, role || CASE WHEN turn % 2 = 0 THEN ', said \"x\"' ELSE '' END AS note FROM conversations"
)
def written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: results with replies on one line and cut to a width, as a CSV file, read again."""
    path = scratch(spark, "results")
    note = F.concat("role", F.when(F.col("turn") % 2 == 0, ', said "x"').otherwise(""))
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "turn", F.col("text").alias("reply"), note.alias("note"))
    src.write_results_csv(rows, path, 200)
    return src.read_eval_csv(spark, path, "id string, turn string, reply string, note string")


@query(
    f"""WITH {EVENT_PAGES}, m AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN page END) OVER (PARTITION BY doc_id) AS s FROM pages), g AS (SELECT doc_id, any_value(s) AS s, min(CASE WHEN event_type = 'purchase' AND page > s THEN page END) AS e, max(page) AS z FROM m GROUP BY doc_id)
    SELECT 'U' || doc_id AS section_id, CAST(s AS INT) AS start_page, CAST(coalesce(e, z) AS INT) AS end_page, CASE WHEN e IS NULL THEN 'no end: last page of the section' END AS note FROM g WHERE s IS NOT NULL"""
)
def stored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans written as a JSON map and read again; those without a start are left out."""
    p = event_pages(spark, sf_dir)
    spans = structure.find_spans(p.select("doc_id", F.concat(F.lit("U"), "doc_id").alias("section_id"), "page", F.col("event_type").alias("text")), "signup", "purchase")
    path = scratch(spark, "spans")
    src.write_spans(spans, path)
    return src.read_spans(spark, path, lines=True)


@query(
    f"""WITH {LOG} SELECT CAST(id AS VARCHAR) AS id, path, 'x' AS intent, icao, CAST(reviewed AS VARCHAR) AS reviewed, nullif(CASE WHEN id % 9 = 0 THEN 'down' ELSE '' END, '') AS feedback, query FROM l"""
)
def log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a CSV file, read again."""
    path = scratch(spark, "log")
    src.export_log_csv(event_log(spark, sf_dir), path)
    return spark.read.csv(path, header=True).select("id", "path", "intent", "icao", "reviewed", "feedback", "query")


@query(
    f"""WITH {EVENT_PAGES} SELECT doc_id, CAST(page AS INT) AS page, event_type || ' of ' || event_id AS text, CASE WHEN event_id % 3 = 0 THEN event_type || ' of ' || event_id END AS kept FROM pages"""
)
def stripped_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without the running header, wherever it stands."""
    head = F.concat(F.lit("AD 2-DNAA-"), F.col("event_id"), F.lit("  NIGERIA AIP \n NIGERIAN AIRSPACE MANAGEMENT AGENCY  "))
    body = F.concat(F.col("event_type"), F.lit("  of "), F.col("event_id"))
    p = event_pages(spark, sf_dir)
    text = chunks.strip_header(F.concat(head, body))
    return p.select("doc_id", "page", text.alias("text"), F.when(F.col("event_id") % 3 == 0, chunks.strip_header(body)).alias("kept"))


@query("WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 2 THEN coalesce(text, '') || ' Bearings, tracks and radials are magnetic' ELSE text END AS t FROM documents) SELECT doc_id, md5(t) AS text_md5 FROM d WHERE contains(lower(t), 'bearings, tracks and radials are magnetic') OR contains(upper(t), 'SCALE 1:')")
def leaked_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold what only a chart plate prints."""
    d = table(spark, sf_dir, "documents")
    marked = d.select("doc_id", F.when(F.col("doc_id") % 9 == 2, F.concat(F.coalesce("text", F.lit("")), F.lit(" Bearings, tracks and radials are magnetic"))).otherwise(F.col("text")).alias("text"))
    return chunks.leak_scan(marked).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    f"""WITH {LINES}, b AS (SELECT doc_id, line_no, text, CAST(line_no % 24 + 1 AS VARCHAR) AS no FROM lines)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS nth, '2.' || no AS subsection, trim('DNAA AD 2.' || no || ' ' || text) AS chunk FROM b WHERE length(trim('DNAA AD 2.' || no || ' ' || text)) > 30"""
)
def subsection_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that begin at a subsection header; every line of a document is one."""
    d = table(spark, sf_dir, "documents")  # a missing text has no chunk
    headed = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit("DNAA AD 2."), (i % 24 + 1).cast("string"), F.lit(" "), line)), "\n")
    got = chunks.split_subsections(d.select("doc_id", headed.alias("text")))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    return got.select("doc_id", nth.alias("nth"), "subsection", "chunk")


@query(
    """SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE WHEN c_custkey % 4 < 3 THEN lower(c_mktsegment) END AS city, CASE WHEN c_custkey % 4 < 3 THEN c_name END AS name, CASE WHEN c_custkey % 4 = 3 THEN 'no identity line' END AS warning FROM customer"""
)
def identity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City and name behind a section's own id."""
    k, id_ = F.col("c_custkey"), F.concat(F.lit("DN"), F.col("c_nationkey"))
    line = F.concat(id_, F.when(k % 4 == 0, " - ").when(k % 4 == 1, " – ").otherwise("-"), F.lower("c_mktsegment"), F.lit(" / "), F.col("c_name"), F.lit(" \nmore / text"))
    text = F.when(k % 4 == 3, F.concat(F.lit("XX - a / b\n"), F.col("c_name"))).otherwise(line)
    t = table(spark, sf_dir, "customer").select(k.alias("doc_id"), id_.alias("scope_id"), F.lit("2.1").alias("subsection"), text.alias("text"))
    return extract.identity_line(t).select("doc_id", "city", "name", "warning")


@query(
    f"""WITH {EVENT_PAGES}, m AS (SELECT *, last_value(CASE event_type WHEN 'error' THEN true WHEN 'signup' THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) AS note FROM pages)
    SELECT doc_id, CAST(page AS INT) AS page, CASE event_type WHEN 'signup' THEN '4 SIGNUP' ELSE event_type END AS text FROM m WHERE NOT coalesce(note, false)"""
)
def lines_outside_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note runs up to the next numbered line."""
    t = F.col("event_type")
    text = F.when(t == "error", F.concat(F.lit("Note: "), t)).when(t == "signup", "4 SIGNUP").otherwise(t)
    lines = event_pages(spark, sf_dir).select("doc_id", F.lit("X").alias("scope_id"), F.lit("2.6").alias("subsection"), "page", F.lit(0).alias("line"), text.alias("text"))
    return extract.skip_note_block(lines).select("doc_id", "page", "text")


@query(
    """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 1 THEN NULL WHEN c_custkey % 6 = 5 THEN NULL ELSE c_name || ' x' END AS general_notes, CASE WHEN c_custkey % 6 = 5 THEN 'no text' ELSE 'no rows: whole text kept' END AS warning FROM customer WHERE c_custkey % 3 <> 1"""
)
def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections without records are kept as their whole text, without private-use characters."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit("X").alias("scope_id"), F.lit("2.9").alias("subsection"), F.when(k % 6 == 5, "  ").otherwise(F.concat(F.col("c_name"), F.lit("  \n x"))).alias("text"))
    return extract.whole_text_fallback(c, c.where("doc_id % 3 = 1")).select("doc_id", "general_notes", "warning")


@query(
    f"""WITH {LINES}, p AS (SELECT doc_id, line_no, CASE line_no % 4 WHEN 0 THEN text || '  063210.5N 0031200E lit' WHEN 1 THEN '063210.5N 0031200E ' || text WHEN 3 THEN '. ' || text || ' 063210N tail' ELSE text END AS t FROM lines),
    n AS (SELECT doc_id, line_no, trim(regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g')) AS line FROM p),
    k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(line, '\\s+\\d{{6}}.*$', '', 's'), '^[ .;:]+', ''), '[ .;:]+$', '') AS name FROM n WHERE regexp_matches(line, '\\d{{6}}(?:\\.\\d+)?[NS]\\s') AND length(line) >= 20)
    SELECT 'D' || doc_id AS scope_id, CASE WHEN name = '' OR length(name) > 60 THEN substr(line, 1, 40) ELSE name END AS entity, 'Obstacle' AS label, line AS fact_value, CAST(line_no AS BIGINT) AS seq FROM k"""
)
def obstacle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact for each line with a position, called by the text before it, or by its start. Positions are put before
    or behind the lines of the documents."""
    at = "063210.5N 0031200E"

    def row(line: Column, i: Column) -> Column:
        return F.when(i % 4 == 0, F.concat(line, F.lit(f"  {at} lit"))).when(i % 4 == 1, F.concat(F.lit(f"{at} "), line)).when(i % 4 == 3, F.concat(F.lit(". "), line, F.lit(" 063210N tail"))).otherwise(line)

    text = F.array_join(F.transform(F.split("text", "\n"), row), "\n")
    t = table(spark, sf_dir, "documents").select(F.lit("AD").alias("scope_kind"), F.concat(F.lit("D"), "doc_id").alias("scope_id"), F.lit("n").alias("scope_name"), F.lit("2.10").alias("subsection"), text.alias("text"))
    return facts.obstacle_facts(t).select("scope_id", "entity", "label", "fact_value", "seq")


@query(
    """WITH t AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) || (doc_id % 10) AS t FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 10 <> 7 THEN CAST(length(t) AS BIGINT) END AS size, CASE WHEN doc_id % 10 <> 7 THEN CAST(length(t) - length(replace(t, 'e', '')) AS BIGINT) END AS letters, doc_id % 10 = 7 AS failed FROM t"""
)
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a function that is given, in batches; what it cannot embed has none."""

    def embed(texts: list[str]) -> list:
        if len(texts) > 10 or any("\n" in t for t in texts):
            raise ValueError("batches of ten one-line texts were asked for")
        return [[float(len(t)), float(t.count("e"))] if t[-1] != "7" else None for t in texts]

    one = F.concat(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")), (F.col("doc_id") % 10).cast("string"))
    got = facts.embedding_batches(table(spark, sf_dir, "documents").select("doc_id", one.alias("fact_text")), embed, 10)
    size, letters = (F.get("embedding", F.lit(i)).cast("long") for i in (0, 1))
    return got.select("doc_id", size.alias("size"), letters.alias("letters"), F.col("embedding").isNull().alias("failed"))


@query(
    """WITH t AS (SELECT p_partkey, p_name, p_size FROM part) SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_size % 3 = 0 AS two FROM t"""
)
def many_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that name a surface or a strength more than once."""
    s = F.col("p_size")
    label = F.when(s % 6 == 0, F.concat(F.lit("Surface of "), "p_name", F.lit(" and surface of TWY"))).when(s % 3 == 0, F.concat_ws(" ", F.lit("Strength and"), "p_name", F.lit("strength"))).when(s % 3 == 1, F.concat_ws(" ", F.lit("Surface and strength"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", multi_facility(label).alias("two"))
