"""Column functions on text, numbers and coordinates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def found(c: Column, pattern: str | Column, group: int = 1) -> Column:
    """A regex group, null (not '') without a match. The pattern may be a column."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.nullif(F.call_function("regexp_extract", c, p, F.lit(group)), F.lit(""))


def quoted(c: Column) -> Column:
    """A literal for use inside a column-built pattern."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+\-?^$|])", r"\\$1")


def any_phrase(phrases: tuple[str, ...]) -> str:
    """A pattern for any of some phrases, whatever the white space between their words."""
    return "(?:" + "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in phrases) + ")"


def squeeze(c: Column) -> Column:
    """White space runs become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Private-use characters removed."""
    return F.regexp_replace(c, "[-]", "")


def strip_all(c: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), patterns, c)


def first_match(c: Column, choices: list[tuple[str, str]]) -> Column:
    """The value of the first pattern that is found, else null."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(v)) for p, v in choices])


def despace(c: Column) -> Column:
    """Thousands written apart are joined, blanks collapse."""
    return squeeze(F.regexp_replace(c, r"(?<=\d) (?=\d{3}\b)", ""))


def join_thousands(c: Column) -> Column:
    """'3 500' -> '3500' where both parts stand alone."""
    return F.regexp_replace(c, r"(?<!\S)(\d{1,2}) (\d{3})(?!\S)", "$1$2")


def number_set(c: Column) -> Column:
    """Distinct numbers of a text as strings; thousands joined, commas dropped."""
    joined = F.regexp_replace(c, r"(?<=\d) (?=\d{3}(?!\d))", "")
    tokens = F.regexp_extract_all(joined, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    return F.array_distinct(F.transform(tokens, lambda t: F.replace(t, F.lit(","), F.lit(""))))


def dms_to_decimal(c: Column, axis: str) -> Column:
    """DDMMSS(.f)[NS] or DDDMMSS(.f)[EW] in a text -> degrees, rounded to 6; S and W negative; null if absent."""
    n, hemis = (2, "NS") if axis == "lat" else (3, "EW")
    p = rf"(?<!\d)(\d{{{n}}})(\d{{2}})(\d{{2}}(?:\.\d+)?)\s*([{hemis}])"
    part = [F.nullif(F.regexp_extract(c, p, k), F.lit("")) for k in (1, 2, 3, 4)]
    size = part[0].cast("double") + part[1].cast("double") / 60 + part[2].cast("double") / 3600
    return F.round(F.when(part[3].isin("S", "W"), -size).otherwise(size), 6)


def measure(c: Column, unit: str) -> Column:
    """First number before a unit; blanks inside number and unit do not matter ('1 200 m', '65 f t')."""
    spaced = r"\s*".join(unit)
    return F.regexp_replace(F.nullif(F.regexp_extract(c, rf"(?i)(\d[\d\s]*(?:\.\d+)?)\s*{spaced}\b", 1), F.lit("")), r"\s", "").try_cast("double")


def rff_category(c: Column) -> Column:
    """The number after CAT, null if there is none."""
    return F.regexp_extract(c, r"(?i)\bCAT(?:EGORY)?\.?\s*(\d{1,2})", 1).try_cast("int")


def multi_facility(label: Column) -> Column:
    """True if a label names a surface or a strength more than once."""
    return (F.regexp_count(F.lower(label), F.lit("surface")) > 1) | (F.regexp_count(F.lower(label), F.lit("strength")) > 1)


def normalised(c: Column) -> Column:
    """Lower case, only letters, digits, apostrophes and single blanks."""
    return squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9' ]+", " "))


def scope_key(c: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def contains_words(text: Column, words: Column) -> Column:
    """Whole-word containment of one normalised text in another."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), words, F.lit(" ")))


def title_case(c: Column) -> Column:
    """Each run of letters starts upper and goes on lower ('RWY 18L' -> 'Rwy 18L')."""
    parts = F.regexp_extract_all(c, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def runway_serves(published: Column, asked: Column) -> Column:
    """A published list ('18L/36R') serves a request if number and side agree; a missing side matches any."""
    def parts(c: Column) -> Column:
        return F.transform(F.split(F.upper(F.coalesce(c, F.lit(""))), r"[/,]"), lambda p: F.struct(F.regexp_extract(p, r"(\d{1,2})", 1).try_cast("int").alias("n"), F.regexp_extract(p, r"\d{1,2}\s*([LRC])", 1).alias("s")))

    def serves(p: Column) -> Column:
        return F.exists(parts(asked), lambda a: (a["n"] == p["n"]) & ((a["s"] == p["s"]) | (a["s"] == "") | (p["s"] == "")))

    return (F.coalesce(F.trim(asked), F.lit("")) == "") | F.exists(parts(published), serves)


def focus_window(text: Column, needles: Column, width: int = 500) -> Column:
    """A window of a collapsed text around the first needles, with ellipses where it is cut; the head without any."""
    t = squeeze(text)
    at = F.filter(F.transform(needles, lambda n: F.instr(F.lower(t), F.lower(n))), lambda p: p > 0)
    start = F.greatest(F.array_min(at) - 1 - 90, F.lit(0))
    stop = F.least(F.greatest(F.array_max(at) - 1 + 210, start), start + width, F.length(t))
    cut = F.concat(F.when(start > 0, "… ").otherwise(""), F.trim(F.substring(t, start + 1, stop - start)), F.when(stop < F.length(t), " …").otherwise(""))
    head = F.concat(F.trim(F.substring(t, 1, width)), F.lit(" …"))
    return F.when(F.length(t) <= width, t).when(F.size(at) > 0, cut).otherwise(head)
