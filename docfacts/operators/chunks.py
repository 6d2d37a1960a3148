"""Chunks of prose for embedding: context carried over pages, accumulation, splitting, packing, prefixes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import found, squeeze
from ..sources.stages import bounded_batches

PLATE_MARKERS = ("SCALE 1:", "BEARINGS, TRACKS AND RADIALS", "BEARINGS TRACKS AND RADIALS")
HEADER = r"(?i)[\w\s.\-]+-\d+\s+NIGERIA\s+AIP\s+NIGERIAN\s+AIRSPACE\s+MANAGEMENT\s+AGENCY\s*"
TABULAR = tuple(f"ENR {k}" for k in (2, 3, 4, 5)) + tuple(f"ENR {k}.{n}" for k, m in ((2, 2), (3, 4), (4, 5), (5, 6)) for n in range(1, m + 1))


def is_plate(text: Column) -> Column:
    """Text that holds a marker of a chart plate."""
    hit = F.lit(False)
    for m in PLATE_MARKERS:
        hit = hit | F.contains(F.upper(text), F.lit(m))
    return hit


def leak_scan(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.where(is_plate(F.col(column)))


def carry_page_context(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text) with part, section, reference: what a page's head does not say is carried over from
    the page before."""
    head = F.substring("text", 1, 800)
    said = lambda n, p: F.contains(head, F.lit(f"PART {n}")) | F.contains(head, F.lit(f"({p})"))
    part = F.when(said(1, "GEN"), "GEN").when(said(2, "ENR"), "ENR").when(said(3, "AD"), "AD")
    section = F.upper(found(head, r"(?i)((?:GEN|ENR|AD)\s+\d+(?:\.\d+)?)"))
    run = Window.partitionBy("doc_id").orderBy("page")
    p = pages.withColumns({"_h": head, "_p": part, "_s": section})
    p = p.withColumns({"part": F.coalesce(F.last("_p", ignorenulls=True).over(run), F.lit("GEN")), "_section": F.coalesce(F.last("_s", ignorenulls=True).over(run), F.lit("GEN 0.1"))})
    own = F.when(F.col("part") == "AD", found(F.col("_h"), r"\b(DN[A-Z]{2})\b"))
    own = F.coalesce(own, F.when(F.col("_p") == "GEN", "NATIONAL").when(F.col("_p") == "ENR", "AIRSPACE"))
    route = (F.col("part") == "ENR") & ((F.col("_section") == "ENR 6") | F.upper("_h").rlike("EN-?ROUTE CHART"))
    p = p.withColumn("_r", F.when(route, "DNKK").otherwise(own))
    p = p.withColumn("reference", F.coalesce(F.last("_r", ignorenulls=True).over(run), F.lit("NATIONAL")))
    base = found(F.col("_section"), r"^AD ([23])")
    stable = (F.col("part") == "AD") & base.isNotNull() & F.col("reference").startswith("DN")
    p = p.withColumn("section", F.when(stable, F.concat(F.lit("AD "), base)).otherwise(F.col("_section")))
    return p.drop("_h", "_p", "_s", "_r", "_section")


def exclude_plates(pages: DataFrame, charts: DataFrame | None = None, least: int = 50) -> DataFrame:
    """Pages that are no chart plates: not catalogued, without markers, and not nearly empty."""
    kept = pages.where(~is_plate(F.col("text")) & (F.length(F.trim("text")) >= least))
    if charts is not None:
        kept = kept.join(charts.select("doc_id", F.col("source_page").alias("page")).distinct(), ["doc_id", "page"], "left_anti")
    return kept


def strip_header(text: Column, pattern: str = HEADER) -> Column:
    return squeeze(F.regexp_replace(text, pattern, ""))


def accumulate(pages: DataFrame) -> DataFrame:
    """Texts of page runs with equal part, section and reference; only AD 2/3 and tabular sections run on, other pages
    stand alone. doc_id, part, section, reference, first_page, n_pages, text."""
    run = Window.partitionBy("doc_id").orderBy("page")
    key = F.struct("part", "section", "reference")
    joins = F.col("section").isin("AD 2", "AD 3", *TABULAR)
    same = F.coalesce(F.lag(key).over(run) == key, F.lit(False)) & joins
    p = pages.withColumn("_b", F.sum((~same).cast("int")).over(run))
    one = F.array_sort(F.collect_list(F.struct("page", "text")))
    return (
        p.groupBy("doc_id", "_b", "part", "section", "reference")
        .agg(F.min("page").alias("first_page"), F.count("*").alias("n_pages"), F.array_join(F.transform(one, lambda x: x["text"]), " ").alias("text"))
        .drop("_b")
    )


def cut_text(text: str, size: int = 1500, overlap: int = 300, least: int = 50) -> list[str]:
    """Pieces of a text. A piece ends behind the last separator in its second half, by kind of separator; the next one
    begins `overlap` before that end."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            marks = (text.rfind(s, start, end) for s in (". ", "\n", "; ", ", "))
            end = next((m + 1 for m in marks if m - start > size // 2), end)
        piece = text[start:end].strip()
        if len(piece) > least:
            out.append(piece)
        if end - overlap <= start:
            break
        start = end - overlap
    return out


def chunk_text(df: DataFrame, text: str = "text", size: int = 1500, overlap: int = 300) -> DataFrame:
    """df's other columns with chunk_no and chunk."""

    rest = [c for c in df.columns if c != text]

    def cut(batches):
        for b in batches:
            pieces = [cut_text(t or "", size, overlap) for t in b.column(len(rest)).to_pylist()]
            at = pa.array([k for k, own in enumerate(pieces) for _ in own], pa.int64())
            made = [pa.array([n for own in pieces for n in range(len(own))], pa.int32()), pa.array([p for own in pieces for p in own], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(rest))), *made], names=[*rest, "chunk_no", "chunk"])

    bounded_batches(df.sparkSession)
    empty = df.select(*rest, F.lit(0).alias("chunk_no"), F.lit("").alias("chunk"))
    return df.select(*rest, text).mapInArrow(cut, empty.schema)


def split_subsections(df: DataFrame, text: str = "text", least: int = 30) -> DataFrame:
    """df's other columns with chunk_no, subsection and chunk: bodies that begin at a subsection header."""
    head = r"(?:DN[A-Z]{2}\s+)?AD\s+[23]\.\d{1,2}\b"
    rest = [c for c in df.columns if c != text]
    parts = df.select(*rest, F.posexplode(F.split(text, rf"(?={head})(?<!DN[A-Z]{{2}}\s{{1,9}})")).alias("chunk_no", "chunk"))
    number = found(F.trim("chunk"), r"^(?:DN[A-Z]{2}\s+)?AD\s+([23]\.\d{1,2})\b")
    return parts.withColumn("chunk", F.regexp_replace("chunk", r"^\s+|\s+$", "")).withColumn("subsection", number).where(F.col("subsection").isNotNull() & (F.length("chunk") > least))


def packed_starts(sizes: np.ndarray, limit: int) -> list[int]:
    """Where chunks begin if parts of these sizes are merged in order up to the limit; a longer part stands alone. A
    search in the running sums for each chunk, not a step for each part."""
    ends, starts, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        starts.append(at)
        before = ends[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
    return starts


def pack_sections(df: DataFrame, text: str = "text", limit: int = 7500, heading: str = r"(?m)^(?=\s*2\.22\.\d+\b)") -> DataFrame:
    """df's other columns with chunk_no (from 0, in order) and chunk: text split at headings, merged up to the limit. Only
    the lengths of the parts go through Python; time and memory are in proportion to the text."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def starts(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda x: packed_starts(np.asarray(x, np.int64), limit) if x is not None else None)

    rest = [c for c in df.columns if c != text]
    parts = df.select(*rest, F.filter(F.split(text, heading), lambda p: F.trim(p) != "").alias("_parts"))
    cut = parts.withColumn("_starts", starts(F.transform("_parts", F.length)))
    stop = F.coalesce(F.get("_starts", F.col("chunk_no") + 1), F.size("_parts"))
    cut = cut.select(*rest, "_parts", "_starts", F.posexplode("_starts").alias("chunk_no", "_from"))
    return cut.select(*rest, "chunk_no", F.array_join(F.slice("_parts", F.col("_from") + 1, stop - F.col("_from")), "").alias("chunk"))


def build_prefix(part: Column, section: Column, title: Column, name: Column, reference: Column, document: str) -> Column:
    """'[document | part | section — title | name (id)]'; unknown parts are left out."""
    who = F.when(name.isNotNull(), F.concat(name, F.lit(" ("), reference, F.lit(")"))).when(~reference.isin("NATIONAL", "AIRSPACE"), reference)
    head = F.concat_ws(" — ", F.nullif(section, F.lit("")), F.nullif(title, F.lit("")))
    return F.concat(F.lit("["), F.concat_ws(" | ", F.lit(document), part, F.nullif(head, F.lit("")), who), F.lit("]"))


def enrich(chunks: DataFrame, titles: DataFrame, names: DataFrame, terms: DataFrame, document: str, most_rows: int = 10_000) -> DataFrame:
    """chunks with content: prefix, term pack of the section, text. The three tables are broadcast while they have at
    most most_rows rows."""

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df

    c = chunks.join(side(titles.select("section", "title")), "section", "left").join(side(names.select("reference", "name")), "reference", "left").join(side(terms.select("section", "terms")), "section", "left")
    prefix = build_prefix(F.col("part"), F.col("section"), F.col("title"), F.col("name"), F.col("reference"), document)
    return c.withColumn("content", F.concat_ws(" ", prefix, F.nullif("terms", F.lit("")), "chunk")).drop("title", "name", "terms")


def embed_payload(steer: Column, content: Column, limit: int = 8000) -> Column:
    """Steering text, a blank line and the content, unless the content holds it; cut at the limit."""
    none = (F.coalesce(steer, F.lit("")) == "") | F.contains(content, steer)
    return F.substring(F.when(none, content).otherwise(F.concat(steer, F.lit("\n\n"), content)), 1, limit)
