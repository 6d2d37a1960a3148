"""Three jobs that put the operators together: ingest pages, answer questions, observe the log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profile import AIP, Profile
from ..operators import evaluate, extract, facts, log, retrieve, route, structure
from ..sources.stages import durable


@dataclass
class Ingested:
    pages: DataFrame
    segments: DataFrame
    records: dict[str, DataFrame]
    issues: DataFrame
    facts: DataFrame


def ingest(words: DataFrame, sections: DataFrame, names: DataFrame, labels: dict[str, list[tuple[str, str]]] | None = None, profile: Profile = AIP) -> Ingested:
    """Words of pages to facts. sections: boundaries; names(scope_id, scope_name); labels: the label patterns of each
    label/value section. A result with an error is not stored at all; its issues are. Pages, segments, placed words and
    records are read by several later steps, so each is written once and read again, and so are the facts."""
    text = structure.page_text(words)
    blob = structure.header_blob(words)
    pages = durable(structure.classify_pages(structure.assign_section(text.join(blob, ["doc_id", "page"], "left"), sections), profile), "pages")
    lines = structure.drop_chrome(structure.visual_lines(words), profile)
    segments = durable(structure.segment_sections(lines, pages, profile=profile), "segments")
    own = segments.where(~F.col("excluded")).withColumnRenamed("section_id", "scope_id")
    placed = words.withColumn("line", F.rint(F.col("top") / 3).cast("int")).join(own.select("doc_id", "scope_id", "subsection", "page", "line"), ["doc_id", "page", "line"])
    placed = durable(placed, "placed")
    section = lambda df, n: df.where(F.col("subsection") == n)
    records = {
        "runway": extract.runways(section(own, "2.12")),
        "distances": extract.columns_by_header_x(section(placed, "2.13")),
        "service": extract.services(section(own, "2.18")),
        "navaid": extract.navaid_fields(section(own, "2.19")),
    }
    shapes = {"runway": "runway", "distances": "distances", "service": "service"}
    for n, mapping in (labels or {}).items():
        rows = extract.canonicalize_labels(extract.label_value_rows(section(placed, n)), mapping)
        records[f"label {n}"] = rows.select(*extract.SECTION, "row_no", "field", F.col("label").alias("raw_label"), F.col("value").alias("detail"))
        shapes[f"label {n}"] = "label"
    records = {k: durable(df, k.replace(" ", "-")) for k, df in records.items()}
    issues = None
    for k, shape in shapes.items():
        found = extract.validate_records(records[k], extract.RULES[shape])
        issues = found if issues is None else issues.unionByName(found)
    issues = durable(issues, "issues")
    out = None
    for k, df in records.items():
        shape = "label" if k.startswith("label ") else k
        kept = extract.gate(df, issues).join(names, "scope_id", "left")
        kept = kept.withColumns({"scope_kind": F.lit("AD"), "scope_name": F.coalesce("scope_name", "scope_id"), "seq": _order(df, shape)})
        made = facts.facts_from_records({shape: kept}, profile)
        out = made if out is None else out.unionByName(made)
    texts = structure.section_text(segments.where(F.col("subsection").isin("2.10", "2.23"))).select(F.col("section_id").alias("scope_id"), "subsection", "text")
    texts = texts.join(names, "scope_id", "left").select(F.lit("AD").alias("scope_kind"), "scope_id", F.coalesce("scope_name", "scope_id").alias("scope_name"), "subsection", "text")
    store = durable(facts.dedupe_facts(out.unionByName(facts.facts_from_text(texts, profile))), "facts")
    return Ingested(pages, segments, records, issues, store)


def _order(records: DataFrame, shape: str) -> Column:
    """A sequence within a section for each shape."""
    column = {"label": "row_no", "distances": "row_no", "navaid": "instance"}.get(shape)
    return F.col(column).cast("long") if column else F.pmod(F.xxhash64({"runway": "designation", "service": "service"}[shape]), F.lit(1 << 20))


def answer(queries: DataFrame, store: DataFrame, hits: DataFrame, k: int = 8) -> DataFrame:
    """queries(query_id, question, subsection, scope_kind, scope_id, embedding) with route, outcome and the facts shown.
    store: facts with vectors. hits(query_id, section, similarity): what a search of chunks found."""
    best = retrieve.best_section(hits).withColumnRenamed("section", "best_section")
    seen = hits.groupBy("query_id").agg(F.array_sort(F.collect_set("section")).alias("sections"))
    empty = F.expr("cast(array() as array<string>)")
    q = queries.join(best, "query_id", "left").join(seen, "query_id", "left").withColumn("sections", F.coalesce("sections", empty))
    routed = route.route_query(q).withColumn("status", F.col("route"))
    near = retrieve.topk_facts(queries, store, k)
    gated = retrieve.facts_gate(routed, near)
    shown = near.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "fact_value"))), lambda x: F.concat_ws(": ", x["label"], x["fact_value"])).alias("shown"))
    out = gated.join(shown, "query_id", "left").withColumn("shown", F.when(F.col("use_facts"), F.col("shown")))
    return out.select("query_id", "route", "section", "outcome", "shown")


def observe(entries: DataFrame, feedback: DataFrame, now: Column, days: int = 30) -> dict[str, DataFrame]:
    """The log with its votes, kept for some days, and the reports over it."""
    kept = log.prune_log(log.apply_feedback(entries, feedback), now, days)
    return {"log": kept, "summary": log.summarize_log(kept), "clusters": log.failure_clusters(kept), "ids": log.top_ids(kept), "shares": log.outcome_shares(kept)}


def assess(rows: DataFrame) -> dict[str, DataFrame]:
    """Verdicts of replies, and where they fail."""
    judged = evaluate.verdicts(rows)
    return {"rows": judged, "levels": evaluate.verdict_levels(judged), "worst": evaluate.worst_sections(judged)}
