"""Evaluation: sampling, scoring of routing, values and clarification, verdicts and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import despace, found, quoted, squeeze
from .chunks import PLATE_MARKERS

ABSENT = r"(?i)\bnil\b|not\s+applicable|not\s+available|no[t]?\s+published|does\s+not\s+(?:state|publish)|couldn'?t\s+find|don'?t\s+have"
ASKING = r"(?i)which\s+(?:approach|runway|aerodrome)|tap one|please give a name or icao|matches more than one|which one"
REFUSAL = r"(?i)won'?t single out|read the exact figure|publishes several"
SECTIONLESS = ("mapping", "greeting", "structure", "facts")
KEYWORDS = ("NIL", "Not Available", "not specified", "Jet A1", "Jet A-1", "CAT 9", "CAT 1", "CAT II", "CAT III", "NCAA", "NAMA", "NOTAM", "Kano FIR")
VERDICTS = ("PASS", "PARTIAL", "FAIL", "REVIEW")


def stratified_sample(df: DataFrame, stratum: str, id_column: str, limit: int, seed: int = 0) -> DataFrame:
    """max(1, limit // strata) rows of each stratum by a seeded hash of the id, and of those `limit`; all rows if the
    limit is 0 or not below their number. (A sampling operator: the limit is its feature.)"""
    if not limit or df.limit(limit + 1).count() <= limit:
        return df
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary"))
    strata = df.select(stratum).distinct().count()
    per = max(1, limit // max(1, strata))
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", id_column))
    return df.withColumn("_h", h).withColumn("_n", nth).where(F.col("_n") <= per).orderBy("_h", id_column).limit(limit).drop("_h", "_n")


def section_name(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("AD "), found(c, r"(\d+\.\d+)")), F.trim(F.coalesce(c, F.lit(""))))


def score_routing(path: Column, subsection: Column, *cited: Column) -> Column:
    """A path without section is right; else the section, or its number on its own, stands in what was said."""
    want = section_name(subsection)
    hay = squeeze(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cited]))
    whole = F.call_function("rlike", hay, F.concat(F.lit(r"(?i)\b"), quoted(want), F.lit(r"\b")))
    number = F.call_function("rlike", hay, F.concat(F.lit(r"(?<!\d)"), quoted(F.element_at(F.split(want, " "), -1)), F.lit(r"(?!\d)")))
    return F.coalesce(F.substring_index(path, ":", 1).isin(*SECTIONLESS), F.lit(False)) | whole | number


def score_value(mode: Column, expected: Column, reply: Column, absent: str = ABSENT) -> Column:
    """absent: the reply says so; tokens: half of the tokens stand in it (a value without tokens is never found); exact: the value stands in it."""
    raw = F.coalesce(reply, F.lit(""))
    said, want = despace(raw), despace(F.coalesce(expected, F.lit("")))
    tokens = F.filter(F.split(F.coalesce(expected, F.lit("")), r"\s+"), lambda t: t != "")
    hits = F.size(F.filter(tokens, lambda t: F.contains(F.lower(raw), F.lower(t))))
    kind = F.lower(F.coalesce(mode, F.lit("exact")))
    return (
        F.when(kind == "absent", said.rlike(absent))
        .when(kind == "tokens", (F.size(tokens) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(tokens) / 2).cast("int"))))
        .otherwise(F.contains(F.lower(said), F.lower(want)))
    )


def enumerates(reply: Column) -> Column:
    """Two labelled entries or more."""
    n = lambda p: F.regexp_count(reply, F.lit(p))
    return F.greatest(n(r"(?:^|\n)\s*[•▸]"), n(r"(?:^|\n)\s*[A-Za-z][^:\n]{2,40}:"), n(r"\[\s*\d{2}[LRC]?\s*\]")) >= 2


def score_clarify(reply: Column) -> Column:
    r = F.coalesce(reply, F.lit(""))
    return r.rlike(ASKING) | enumerates(r) | r.rlike(ABSENT)


def verdicts(rows: DataFrame, absent: str = ABSENT, refusal: str | None = REFUSAL) -> DataFrame:
    """rows(path, subsection, match_mode, expected_value, expected_behaviour, reply, harness_error) with routing_ok,
    value_ok and verdict. absent: how a reply says that there is no value; refusal: how it declines, None if it never does."""
    clarify = F.coalesce(F.col("expected_behaviour") == "clarify", F.lit(False))
    failed = F.coalesce("harness_error", F.lit(False))
    refused = ~clarify & F.coalesce("reply", F.lit("")).rlike(refusal) if refusal else F.lit(False)
    r = rows.withColumns({"routing_ok": score_routing(F.col("path"), F.col("subsection"), F.col("reply"), F.col("path")), "_v": score_value(F.col("match_mode"), F.col("expected_value"), F.col("reply"), absent)})
    route, value = F.col("routing_ok"), F.col("_v")
    verdict = (
        F.when(failed, "HARNESS_ERROR")
        .when(refused, "GUARD_REFUSAL")
        .when(clarify & score_clarify(F.col("reply")), "CLARIFY_OK")
        .when(clarify, "CLARIFY_MISS")
        .when(route & value, "PASS")
        .when(route, "VALUE_MISS")
        .when(value, "ROUTE_MISS")
        .otherwise("FAIL")
    )
    return r.withColumns({"verdict": verdict, "value_ok": F.when(~clarify & ~refused & ~failed, value)}).drop("_v")


CASE_VERDICTS = ("PASS", "VALUE_MISS", "ROUTE_MISS", "FAIL", "GUARD_REFUSAL", "CLARIFY_OK", "CLARIFY_MISS", "HARNESS_ERROR")


def verdict_matrix(rows: DataFrame, by: str) -> DataFrame:
    """Counts of each verdict by a column."""
    return rows.groupBy(by).agg(*[F.count_if(F.col("verdict") == k).alias(k.lower()) for k in CASE_VERDICTS], F.count("*").alias("n"))


def worst_sections(rows: DataFrame, by: str = "subsection", k: int = 8, least: int = 3) -> DataFrame:
    """The k sections (of `least` cases or more) with the highest share of other verdicts than PASS."""
    m = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "PASS").alias("passed")).where(F.col("n") >= least)
    return m.withColumn("miss_rate", F.round(1 - F.col("passed") / F.col("n"), 6)).orderBy(F.desc("miss_rate"), by).limit(k)


def verdict_levels(rows: DataFrame, by: tuple[str, ...] = ("subsection", "corruption")) -> DataFrame:
    """level (a column's name, or 'total'), name, counts of each verdict, n, ok (passed, or asked back rightly) and ok_pct
    (whole per cent): every level of the report from one pass over the rows, by grouping sets. A null name is a name."""
    sets = [[F.col(c)] for c in by] + [[]]
    n = F.count("*")
    ok = F.count_if(F.col("verdict").isin("PASS", "CLARIFY_OK"))
    counts = [F.count_if(F.col("verdict") == k).alias(k.lower()) for k in CASE_VERDICTS]
    # grouping() is 0 for the column that a row is grouped by
    own = [F.grouping(c) == 0 for c in by]
    level, name = F.lit("total"), F.lit(None).cast("string")
    for c, mine in zip(by, own, strict=True):
        level, name = F.when(mine, F.lit(c)).otherwise(level), F.when(mine, F.col(c).cast("string")).otherwise(name)
    made = rows.groupingSets(sets, *[F.col(c) for c in by]).agg(level.alias("level"), name.alias("name"), *counts, n.alias("n"), ok.alias("ok"))
    return made.select("level", "name", *[k.lower() for k in CASE_VERDICTS], "n", "ok", F.floor(100 * F.col("ok") / F.greatest("n", F.lit(1))).cast("long").alias("ok_pct"))


def has_number(reply: Column, number: Column) -> Column:
    return F.call_function("rlike", despace(reply), F.concat(F.lit(r"(?<!\d)"), quoted(number), F.lit(r"(?!\d)")))


def score_ground_truth(rows: DataFrame) -> DataFrame:
    """rows(test_type, ground_truth, reply, path, charts, icao, sections) with verdict by the rules of each test type;
    recall is the share of expected numbers that the reply holds."""
    gt, reply, path, tt = F.coalesce("ground_truth", F.lit("")), F.coalesce("reply", F.lit("")), F.coalesce("path", F.lit("")), F.col("test_type")
    up = F.upper(reply)
    every = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    codes = every(gt, r"\b(DN[A-Z]{2})\b")
    wanted = F.get(codes, F.lit(0))
    got = (path == "chart") & (F.coalesce("charts", F.lit(0)) > 0)
    right = wanted.isNull() | F.coalesce(F.col("icao") == wanted, F.lit(False))
    stands = lambda arr: F.exists(arr, lambda t: F.contains(up, F.upper(t)))
    names = F.concat(codes, every(gt, r"([A-Z][a-z]{2,})"))
    sections = F.transform(every(gt, r"(?i)\b((?:AD|ENR|GEN)\s?\d+(?:\.\d+)?)\b"), F.upper)
    cited = F.upper(F.array_join(F.coalesce("sections", F.expr("cast(array() as array<string>)")), " "))
    structure = F.exists(sections, lambda s: F.contains(up, s) | F.contains(cited, s)) | stands(F.array(*[F.lit(k) for k in ("NCAA", "NAMA", "Kano FIR", "DNKK")]))
    words = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(F.upper(gt), F.upper(k)))
    numbers = every(despace(gt), r"(\d+(?:\.\d+)?)")
    matched = F.size(F.filter(numbers, lambda n: has_number(reply, n)))
    recall = F.when(F.size(numbers) > 0, matched / F.size(numbers))
    v = lambda c, yes="PASS", no="FAIL": F.when(c, yes).otherwise(no)
    unsure = v(path == "answer", "REVIEW")
    verdict = (
        F.when(tt == "out_of_scope", v(path.isin("out_of_scope", "abstain", "unresolved")))
        .when(tt == "multimodal", F.when(got & right, "PASS").when(got, "PARTIAL").otherwise("FAIL"))
        .when(tt == "mapping", v(stands(names)))
        .when(tt == "structure", F.when(structure, "PASS").otherwise(unsure))
        .when(tt == "currency", v(reply.rlike(r"03/2026|2026") | up.rlike("AMDT 03|NOTAM")))
        .when((tt == "no_hallucination") & path.isin("not_in_aip", "abstain"), "PASS")
        .when((tt == "no_hallucination") & F.lower(gt).rlike("invent|no padding|only what|must not"), "REVIEW")
        .when(tt == "no_hallucination", F.when(F.size(words) == 0, "REVIEW").otherwise(v(stands(words))))
        .when(path == "not_in_aip", "FAIL")
        .when(recall == 1, "PASS")
        .when(recall > 0, "PARTIAL")
        .when(recall == 0, "FAIL")
        .when(stands(words), "PASS")
        .otherwise(unsure)
    )
    return rows.withColumns({"verdict": verdict, "recall": recall})


def category_report(rows: DataFrame, by: str = "category") -> DataFrame:
    return rows.groupBy(by).agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS])


def invariant_checks(rows: DataFrame, disclaimer: str, cycle: str, citation: str = "% MATCH]", markers: tuple[str, ...] = (*PLATE_MARKERS, "INSTRUMENT APPROACH CHART")) -> DataFrame:
    """rows with fails and warns: expectations (exp_*; null where none) and what every answer must and must not hold."""
    up = F.upper(F.coalesce("reply", F.lit("")))
    answer = F.coalesce(F.col("path") == "answer", F.lit(False))
    shown = F.coalesce(F.col("path").isin("answer", "chart"), F.lit(False))
    differs = lambda c: F.col(f"exp_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"exp_{c}"))
    checks = [F.when(differs(c), F.concat(F.lit(f"{c} differs from "), F.col(f"exp_{c}"))) for c in ("path", "icao", "ref")]
    checks += [F.when(answer & ~F.contains(up, F.lit(m.upper())), F.lit(f"missing {n}")) for n, m in (("disclaimer", disclaimer), ("cycle", cycle), ("citation", citation))]
    checks += [F.when(shown & F.contains(up, F.lit(m)), F.lit(f"plate text: {m}")) for m in markers]
    lost = F.transform(F.filter(F.coalesce("exp_contains", F.expr("cast(array() as array<string>)")), lambda s: ~F.contains(up, F.upper(s))), lambda s: F.concat(F.lit("missing text: "), s))
    weak = answer & F.coalesce(F.col("similarity") < F.col("exp_min_similarity"), F.lit(False))
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    return rows.withColumns({"fails": F.concat(some(F.array(*checks)), lost), "warns": some(F.array(F.when(weak, F.lit("low similarity"))))})
