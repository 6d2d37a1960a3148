"""Facts: records and texts become atomic, self-describing rows with a unique key, kept by keyed upserts.

A fact: scope_kind, scope_id, subsection, entity ('' if none), label, fact_value, fact_text, seq (order of appearance).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import AIP, Profile
from ..functions.text import blank_to_null, squeeze, title_case
from ..sources.stages import bounded_batches, durable

KEY = ["scope_kind", "scope_id", "subsection", "entity", "label"]


def frame_text(profile: Profile = AIP) -> Column:
    """'NAME (ID) AD 2.13 declared distances.' from columns scope_name, scope_id, subsection."""
    names = F.create_map(*[F.lit(x) for kv in profile.section_names.items() for x in kv])
    return F.concat(F.col("scope_name"), F.lit(" ("), F.col("scope_id"), F.lit(") AD "), F.col("subsection"), F.lit(" "), F.coalesce(names[F.col("subsection")], F.lit("")), F.lit("."))


def _emit(records: DataFrame, items: Column) -> DataFrame:
    """records(scope_kind, scope_id, subsection, seq, ...) exploded to one row for each item with a value.
    items: array of (entity, label, value, text)."""
    base = ["scope_kind", "scope_id", "subsection"]
    return (
        records.select(*base, "seq", F.posexplode(F.filter(items, lambda i: i["value"].isNotNull())).alias("n", "i"))
        .select(*base, F.col("i.entity").alias("entity"), F.col("i.label").alias("label"), F.col("i.value").alias("fact_value"), F.col("i.text").alias("fact_text"), (F.col("seq") * 10_000 + F.col("n")).alias("seq"))
    )


def _item(entity: Column, label: Column | str, value: Column, text: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.struct(entity.alias("entity"), label.alias("label"), value.cast("string").alias("value"), text.alias("text"))


def _said(frame: Column, *parts: Column | str) -> Column:
    return F.concat(frame, F.lit(" "), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def label_value_facts(records: DataFrame, profile: Profile = AIP) -> DataFrame:
    """Records with field or raw_label: the first value there is among detail, hours, value, text, content, remarks."""
    has = set(records.columns)
    pick = lambda *names: F.coalesce(*[blank_to_null(F.col(n)) for n in names if n in has], F.lit(None).cast("string"))
    label = F.coalesce(pick("raw_label", "field"), F.lit(""))
    value = pick("detail", "hours", "value", "text", "content", "remarks")
    return _emit(records, F.array(_item(F.lit(""), label, value, _said(frame_text(profile), label, ": ", value))))


def distance_facts(records: DataFrame, profile: Profile = AIP) -> DataFrame:
    """Records with a runway and distances: one fact for each distance that is not null, and the remarks."""
    entity = F.concat(F.lit("RWY "), F.coalesce(blank_to_null(F.col("runway")), F.lit("?")))
    frame, items = frame_text(profile), []
    for column, name, long in profile.distances:
        value = F.concat(F.col(column).cast("string"), F.lit(" m"))
        items.append(_item(entity, name, value, _said(frame, entity, f". {name} ({long}): ", value)))
    notes = blank_to_null(F.col("remarks"))
    return _emit(records, F.array(*items, _item(entity, "Remarks", notes, _said(frame, entity, ". Remarks: ", notes))))


def runway_facts(records: DataFrame, profile: Profile = AIP) -> DataFrame:
    """Records with a designation: dimensions, and details of each end; without a designation, notes."""
    frame, name = frame_text(profile), blank_to_null(F.col("designation"))
    entity = F.concat(F.lit("RWY "), name)
    dims = F.concat(F.col("length_m").cast("string"), F.lit(" x "), F.col("width_m").cast("string"), F.lit(" m"))
    dims = F.when((F.col("length_m") > 0) & (F.col("width_m") > 0), dims)
    first = F.when(name.isNotNull(), F.array(_item(entity, "Dimensions", dims, _said(frame, entity, ". Dimensions (length x width): ", dims)))).otherwise(F.expr("array()").cast("array<struct<entity:string,label:string,value:string,text:string>>"))
    ends = F.array_sort(F.map_entries(F.coalesce("end_detail", F.create_map().cast("map<string,string>"))))

    def end(e: Column) -> Column:
        who = F.when(e["key"] == "general_notes", "general").otherwise(F.concat(F.lit("RWY "), e["key"]))
        value = blank_to_null(F.regexp_replace(e["value"], r"^\s+|\s+$", ""))
        named = name.isNotNull()
        return _item(F.when(named, who).otherwise(""), F.when(named, "Details").otherwise("Notes"), value, F.when(named, _said(frame, who, ". ", value)).otherwise(_said(frame, value)))

    return _emit(records, F.concat(first, F.transform(ends, end)))


def service_facts(records: DataFrame, profile: Profile = AIP) -> DataFrame:
    """Records with a service: its frequencies as one fact, and the full entry."""
    frame, entity = frame_text(profile), F.coalesce(blank_to_null(F.col("service")), F.lit("?"))
    joined = F.nullif(F.array_join(F.transform("frequencies", lambda f: F.concat(f["value"].cast("string"), F.coalesce(f["unit"], F.lit("")))), ", "), F.lit(""))
    whole = blank_to_null(F.col("raw_text"))
    return _emit(
        records,
        F.array(
            _item(entity, "Frequency", joined, _said(frame, entity, ". Frequency / channel to contact ", entity, ": ", joined)),
            _item(entity, "Full entry", whole, _said(frame, entity, ". ", whole)),
        ),
    )


def navaid_facts(records: DataFrame, profile: Profile = AIP) -> DataFrame:
    """Records with an aid_type: frequency, hours, position, elevation, remarks."""
    has, frame = set(records.columns), frame_text(profile)
    col = lambda c: blank_to_null(F.col(c)) if c in has else F.lit(None).cast("string")
    entity = F.concat_ws(" ", F.coalesce(col("aid_type"), F.lit("?")), col("ident"))
    freq = F.when(col("frequency").isNotNull(), F.concat_ws(" ", col("frequency"), col("freq_unit")))
    items = [_item(entity, "Frequency", freq, _said(frame, entity, ". Frequency: ", freq))]
    for c, label in (("hours", "Hours of operation"), ("lat", "Latitude"), ("lon", "Longitude"), ("elevation", "Elevation"), ("remarks", "Remarks")):
        items.append(_item(entity, label, col(c), _said(frame, entity, f". {label}: ", col(c))))
    return _emit(records, F.array(*items))


def unit_merge(entries: DataFrame, keys: list[str], profile: Profile = AIP) -> DataFrame:
    """keys, label, fact_value: entries (keys, name, value) with names <base>_<unit> merged for each base, in the order
    of units, shown with their signs; ids and blank values are left out."""
    suffix = "|".join(u for u, _ in profile.units)
    rank = F.create_map(*[x for i, (u, _) in enumerate(profile.units) for x in (F.lit(u), F.lit(i))])
    sign = F.create_map(*[F.lit(x) for u in profile.units for x in u])
    unit = F.nullif(F.lower(F.regexp_extract("name", rf"(?i)^.+_({suffix})$", 1)), F.lit(""))
    base = F.when(unit.isNotNull(), F.regexp_extract("name", rf"(?i)^(.+)_(?:{suffix})$", 1)).otherwise(F.col("name"))
    e = entries.where(~F.col("name").isin("icao", "icao_code")).withColumns({"value": blank_to_null(F.col("value")), "_u": unit, "_b": base}).where("value is not null")
    part = F.struct(F.coalesce(rank[F.col("_u")], F.lit(99)).alias("r"), F.concat_ws(" ", "value", sign[F.col("_u")]).alias("v"))
    return e.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(part)).alias("p")).select(*keys, F.replace("_b", F.lit("_"), F.lit(" ")).alias("label"), F.array_join(F.transform("p", lambda x: x["v"]), " / ").alias("fact_value"))


def scalar_facts(records: DataFrame, columns: list[str], profile: Profile = AIP) -> DataFrame:
    """What no other shape takes: each scalar column, units merged."""
    keys = ["scope_kind", "scope_id", "scope_name", "subsection", "seq"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))
    merged = unit_merge(records.select(*keys, pairs.alias("p")).select(*keys, "p.*"), keys, profile)
    return merged.select("scope_kind", "scope_id", "subsection", F.lit("").alias("entity"), "label", "fact_value", _said(frame_text(profile), F.col("label"), ": ", F.col("fact_value")).alias("fact_text"), (F.col("seq") * 10_000).alias("seq"))


def facts_from_records(shapes: dict[str, DataFrame], profile: Profile = AIP) -> DataFrame:
    """Facts of all shapes given (label, distances, runway, service, navaid), united."""
    makers = {"label": label_value_facts, "distances": distance_facts, "runway": runway_facts, "service": service_facts, "navaid": navaid_facts}
    parts = [makers[k](v, profile) for k, v in shapes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def heading_bodies(texts: DataFrame, keys: list[str], heading: str = AIP.heading) -> DataFrame:
    """keys, line_no, number, title, depth, body, parent of each numbered heading: the lines up to the next heading.
    A heading of depth 3 becomes the parent of deeper ones; a shallower one clears it."""
    lines = texts.select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    number = F.nullif(F.regexp_extract("line", heading, 1), F.lit(""))
    title = squeeze(F.regexp_extract("line", heading, 2))
    run = Window.partitionBy(*keys).orderBy("line_no")
    lines = lines.withColumns({"number": number, "title": title}).withColumn("block", F.sum(F.col("number").isNotNull().cast("int")).over(run)).where("block > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("number").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    heads = lines.groupBy(*keys, "block").agg(F.min("line_no").alias("line_no"), F.max("number").alias("number"), F.max(F.when(F.col("number").isNotNull(), F.col("title"))).alias("title"), body.alias("body"))
    tidy = F.regexp_replace(F.regexp_replace(F.col("body"), r"[ \t]{2,}", " "), r"\n{2,}", "\n")
    heads = heads.withColumns({"body": F.regexp_replace(F.regexp_replace(tidy, r"^\s+|\s+$", ""), r"\n{2,}", "\n"), "depth": F.regexp_count("number", F.lit(r"\."))})
    walk = Window.partitionBy(*keys).orderBy("block")
    heads = heads.withColumn("era", F.sum((F.col("depth") <= 2).cast("int")).over(walk))
    first_line = F.regexp_replace(F.substring(F.split("body", "\n")[0], 1, 70), r"^[ .:]+|[ .:]+$", "")
    parent = F.when(F.col("depth") == 3, F.trim(F.concat_ws(" ", "title", first_line)))
    heads = heads.withColumn("parent", F.coalesce(F.last(parent, ignorenulls=True).over(Window.partitionBy(*keys, "era").orderBy("block")), F.lit("")))
    return heads.select(*keys, "line_no", "number", "title", "depth", "body", "parent")


def facts_from_text(texts: DataFrame, profile: Profile = AIP, least: int = 12, most: int = 1200) -> DataFrame:
    """Facts of text sections (scope_kind, scope_id, scope_name, subsection, text): one for each heading with a body; a
    section without any is one coarse fact."""
    keys, frame = ["scope_kind", "scope_id", "scope_name", "subsection"], frame_text(profile)
    cut = F.concat(F.regexp_replace(F.substring("body", 1, most), r"(?s) [^ ]*$", ""), F.lit(" …"))
    h = heading_bodies(texts, keys, profile.heading).where(F.length("body") >= least).withColumn("body", F.when(F.length("body") > most, cut).otherwise(F.col("body")))
    context = F.when((F.col("parent") != "") & (F.col("depth") > 3), F.concat(F.lit(" "), F.col("parent"), F.lit("."))).otherwise("")
    one = h.select(
        "scope_kind", "scope_id", "subsection", F.col("number").alias("entity"), F.substring("title", 1, 120).alias("label"), F.col("body").alias("fact_value"),
        F.concat(frame, context, F.lit(" "), F.col("title"), F.lit(": "), F.col("body")).alias("fact_text"), F.col("line_no").cast("long").alias("seq"),
    )
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[ \t]{2,}", " "), r"^\s+|\s+$", ""), r"\n{2,}", "\n")
    names = F.create_map(*[F.lit(x) for kv in profile.section_names.items() for x in kv])
    rest = texts.join(one.select("scope_kind", "scope_id", "subsection").distinct(), ["scope_kind", "scope_id", "subsection"], "left_anti").withColumn("flat", flat).where(F.length("flat") >= least)
    value = F.substring("flat", 1, most)
    coarse = rest.select(
        "scope_kind", "scope_id", "subsection", F.lit("").alias("entity"), title_case(F.coalesce(names[F.col("subsection")], F.concat(F.lit("AD "), F.col("subsection")))).alias("label"),
        value.alias("fact_value"), F.concat(frame, F.lit(" "), value).alias("fact_text"), F.lit(0).cast("long").alias("seq"),
    )
    return one.unionByName(coarse)


def obstacle_facts(texts: DataFrame, profile: Profile = AIP) -> DataFrame:
    """One fact for each line with a coordinate; its name is the text before it, or the line's start."""
    lines = texts.select("scope_kind", "scope_id", "scope_name", "subsection", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"[ \t]{2,}", " "))).where(F.col("line").rlike(profile.obstacle_row) & (F.length("line") >= 20))
    name = F.regexp_replace(F.split("line", r"\s+\d{6}", 2)[0], r"^[ .;:]+|[ .;:]+$", "")
    lines = lines.withColumn("entity", F.when((name == "") | (F.length(name) > 60), F.substring("line", 1, 40)).otherwise(name))
    return lines.select(
        "scope_kind", "scope_id", "subsection", "entity", F.lit("Obstacle").alias("label"), F.col("line").alias("fact_value"),
        _said(frame_text(profile), "Obstacle ", F.col("entity"), ": ", F.col("line")).alias("fact_text"), F.col("seq").cast("long").alias("seq"),
    )


def facts_from_entities(records: DataFrame, profile: Profile = AIP) -> DataFrame:
    """One fact for each non-blank field of en-route records, in a fixed order; an array of coordinates is one fact."""
    has, frame = set(records.columns), F.concat(F.col("scope_id"), F.lit(" ENR "), F.col("subsection"))
    items = []
    for c, label in profile.entity_fields:
        if c in has:
            v = blank_to_null(F.col(c))
            items.append(_item(F.lit(""), label, v, _said(frame, f"{label}: ", v)))
    if "coordinates" in has:
        if dict(records.dtypes)["coordinates"].startswith("array"):
            v = F.nullif(F.array_join("coordinates", " "), F.lit(""))
            items.append(_item(F.lit(""), "Coordinates", v, _said(frame, "Coordinates (", F.size("coordinates").cast("string"), " points): ", v)))
        else:
            v = blank_to_null(F.col("coordinates"))
            items.append(_item(F.lit(""), "Position", v, _said(frame, "Position: ", v)))
    return _emit(records.where(blank_to_null(F.col("scope_id")).isNotNull()), F.array(*items))


def dedupe_facts(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Facts with a unique key. Equal values collapse to the first one; several values are numbered by appearance in
    the entity and, once, in the text."""
    keys = keys or KEY
    first = facts.groupBy(*keys, "fact_value").agg(F.min_by(F.struct("fact_text", "seq"), "seq").alias("f")).select(*keys, "fact_value", "f.fact_text", "f.seq")
    same = Window.partitionBy(*keys)
    d = first.withColumns({"n": F.row_number().over(same.orderBy("seq", "fact_value")), "many": F.count("*").over(same) > 1})
    base = F.when(F.col("entity") == "", "item").otherwise(F.col("entity"))
    mark = F.concat(F.lit(". "), F.col("label"), F.lit(":"))
    to = F.concat(F.lit(". "), title_case(base), F.lit(" "), F.col("n").cast("string"), mark)
    at = F.instr(F.col("fact_text"), mark)
    text = F.when(at > 0, F.overlay("fact_text", to, at, F.length(mark))).otherwise(F.col("fact_text"))
    numbered = {"fact_text": F.when(F.col("many"), text).otherwise(F.col("fact_text"))}
    out = d.withColumns(numbered).withColumn("entity", F.when(F.col("many"), F.concat_ws(" ", base, F.col("n").cast("string"))).otherwise(F.col("entity")))
    return out.drop("n", "many")


def facts_pending(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Facts still to be written: none of a scope that holds as many already, else those whose key is missing."""
    scope = ["scope_kind", "scope_id"]
    wanted = new.groupBy(*scope).agg(F.count("*").alias("w"))
    held = existing.groupBy(*scope).agg(F.count("*").alias("h"))
    todo = wanted.join(held, scope, "left").where("coalesce(h, 0) < w").select(*scope)
    return new.join(todo, scope, "left_semi").join(existing.select(*KEY), KEY, "left_anti")


def embedding_batches(facts: DataFrame, embed: Callable[[list[str]], list], size: int = 100, text: str = "fact_text") -> DataFrame:
    """facts with embedding from a function that is given; it gets `size` stripped one-line texts at once (a task's last
    call: what is left), however many rows an Arrow batch has. What it cannot embed is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        n = 0
        for b in batches:
            waiting.append(b)
            n += len(b)
            if n >= size:
                rows = pd.concat(waiting, ignore_index=True)
                full = n - n % size
                yield embedded(rows.iloc[:full])
                waiting, n = [rows.iloc[full:]], n % size
        if n:
            yield embedded(pd.concat(waiting, ignore_index=True))

    def embedded(rows: pd.DataFrame) -> pd.DataFrame:
        clean = [t.strip().replace("\n", " ") if t else "" for t in rows[text]]
        vectors: list = []
        for a in range(0, len(clean), size):
            part = clean[a : a + size]
            got = embed(part)
            vectors += list(got) + [None] * (len(part) - len(got))
        return rows.assign(embedding=pd.Series(vectors, index=rows.index, dtype=object))

    bounded_batches(facts.sparkSession)
    kind = ", ".join(f"`{c}` {t}" for c, t in facts.dtypes)
    return facts.mapInPandas(run, f"{kind}, embedding array<float>")


def numbered(rows: DataFrame, order: list[str], number: str = "row_no", label: str = "numbered") -> DataFrame:
    """Rows with numbers from 0 without gaps in the given order, as a stored table. Ranges are sorted and counted each by
    itself, and a range's rows are shifted by the rows before it, so no task sees all rows."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = durable(sorted_, label)
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(number, F.col("_first") + within).drop("_part", "_at", "_first")


def embed_into(facts: DataFrame, path: str, embed: Callable[[list[str]], list], size: int = 100, commit: int = 64, text: str = "fact_text") -> DataFrame:
    """Embed what the Parquet table in `path` does not hold yet, and return that table. The table is the ledger: facts
    that are pending are numbered in the order of their keys and cut into batches of exactly `size` (but the last), each
    a group of its own and one call of the function; `commit` batches are appended at once. A run that was stopped and is
    started again calls the function for what was not appended alone. A fact counts as held with its present text;
    a fact without a vector is never written, so it stays pending."""
    spark = facts.sparkSession
    schema = facts.withColumn("embedding", F.lit(None).cast("array<float>")).schema
    try:
        held = spark.read.schema(schema).parquet(path)
    except AnalysisException:  # not there yet
        spark.createDataFrame([], schema).write.parquet(path)
        held = spark.read.schema(schema).parquet(path)
    same = [facts[c].eqNullSafe(held[c]) for c in [*KEY, text]]
    todo = numbered(facts.join(held, same, "left_anti"), [*KEY, text], "_no", "pending").withColumn("_batch", F.floor(F.col("_no") / size))
    last = todo.agg(F.max("_batch")).first()[0]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_no")
        got = list(embed([t.strip().replace("\n", " ") if t else "" for t in rows[text]]))
        return rows.drop(columns=["_no", "_batch"]).assign(embedding=pd.Series(got + [None] * (len(rows) - len(got)), index=rows.index, dtype=object))

    for start in range(0, -1 if last is None else last + 1, commit):
        part = todo.where(F.col("_batch").between(start, start + commit - 1))
        made = part.groupBy("_batch").applyInPandas(one, schema)
        made.where("embedding is not null").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def embedded_and_failed(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A fact without a vector is never written."""
    return facts.where("embedding is not null"), facts.where("embedding is null").drop("embedding")


def write_report(intended: DataFrame, embedded: DataFrame, written: DataFrame) -> DataFrame:
    """attempted, embedded, failed, written, lost: lost counts embedded keys that the re-read target lacks."""
    lost = embedded.join(written.select(*KEY), KEY, "left_anti")
    sides = {"attempted": intended, "embedded": embedded, "written": written, "lost": lost}
    counts = [df.select(*[F.lit(int(c == name)).alias(c) for c in sides]) for name, df in sides.items()]
    every = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    one = every.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sides])
    return one.select("attempted", "embedded", (F.col("attempted") - F.col("embedded")).alias("failed"), "written", "lost", (F.col("lost") > 0).alias("error"))


def lost_keys(embedded: DataFrame, written: DataFrame) -> DataFrame:
    return embedded.select(*KEY).join(written.select(*KEY), KEY, "left_anti")


def scope_backfill(facts: DataFrame) -> DataFrame:
    """A missing scope becomes ('AD', code); code and scope id of such rows fill each other; other rows take their kind
    as code."""
    kind = F.coalesce("scope_kind", F.lit("AD"))
    ad = kind == "AD"
    return facts.withColumns(
        {
            "scope_kind": kind,
            "scope_id": F.when(ad, F.coalesce("scope_id", "icao_code")).otherwise(F.col("scope_id")),
            "icao_code": F.when(ad, F.coalesce("icao_code", "scope_id")).otherwise(kind),
        }
    )


def fact_quality(facts: DataFrame, profile: Profile = AIP) -> DataFrame:
    """check, scope_kind, n: rows without or with disagreeing scope, unknown kinds, repeated keys; scopes and facts of
    each kind."""
    kind = F.col("scope_kind")
    flags = facts.select(
        kind,
        F.explode(
            F.array(
                F.when(kind.isNull() | F.col("scope_id").isNull(), F.lit("unscoped")),
                F.when((kind == "AD") & ~F.col("icao_code").eqNullSafe(F.col("scope_id")), F.lit("disagreeing")),
                F.when(~kind.isin(*profile.scope_kinds), F.lit("unknown kind")),
                F.lit("facts"),
            )
        ).alias("check"),
    ).where("check is not null")
    repeated = facts.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").groupBy("scope_kind").agg(F.count("*").alias("n")).withColumn("check", F.lit("repeated keys"))
    scopes = facts.groupBy("scope_kind").agg(F.count_distinct("scope_id").alias("n")).withColumn("check", F.lit("scopes"))
    return flags.groupBy("check", "scope_kind").agg(F.count("*").alias("n")).unionByName(repeated).unionByName(scopes)
