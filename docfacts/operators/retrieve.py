"""Scoped retrieval: hard filters are join keys, so no candidate ever crosses a scope."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import scope_key
from ..sources.stages import durable


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors of length 1 as doubles; a zero vector stays."""
    v = F.col(column)
    once = F.array(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n")))  # the length is worked out once a vector
    unit = F.transform(once, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(F.lit(0.0))))
    return df.withColumn(column, unit[0])


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Rows of a scope, and queries to it, that one task multiplies.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def _blocks(df: DataFrame, keys: list[str], ids: list[str], size: int, name: str) -> DataFrame:
    """Blocks of about size rows of each group: the ids as arrays in their order, the vectors as one flat array, the
    block's number and how many the group has."""
    n = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    dealt = df.join(n, keys).withColumn("_b", F.pmod(F.xxhash64(*ids), F.col("_n")).cast("int"))
    one = F.array_sort(F.collect_list(F.struct(*ids, "embedding")))
    packed = dealt.groupBy(*keys, F.col("_b").alias(f"{name}_no"), F.col("_n").alias(f"{name}_count")).agg(one.alias("_a"))

    def column(c: str) -> Column:
        return F.transform("_a", lambda x: x[c]).alias(f"{name}_{c}")

    cols = [column(c) for c in ids]
    return packed.select(*keys, f"{name}_no", f"{name}_count", *cols, F.flatten(F.transform("_a", lambda x: x["embedding"])).alias(f"{name}_v"))


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays."""
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def nearest(
    queries: DataFrame, rows: DataFrame, keys: list[str], query_key: list[str], ties: list[str], k: int, same: str | None = None,
    tier: tuple[list[str], Callable[[tuple, dict[str, np.ndarray]], np.ndarray]] | None = None,
) -> DataFrame:
    """The k nearest rows of the same keys for each query, by exact blocked products: keys, query_key, ties, similarity,
    rank. With `same`, a query that has a value in that column only meets rows that have it too (a tie column). With
    `tier` (query columns, and a function of a query's values and the rows' tie columns that numbers the rows), rows of a
    smaller number come first, whatever their similarity.

    A group's rows are cut into blocks of bounded size, as are its queries; every two blocks are sent to one group of
    their own, which returns the k best of each query, so a hot group spreads over many tasks and nothing returns all
    pairs. Ties in
    similarity go by the tie columns, which tell rows apart. All vectors of a group have one width."""
    asked = [*query_key, *([same] if same else []), *(tier[0] if tier else [])]
    q = _blocks(queries.select(*keys, *asked, "embedding"), keys, asked, BLOCK_QUERIES, "q")
    r = _blocks(rows.select(*keys, *ties, "embedding"), keys, ties, BLOCK_ROWS, "r")
    kinds = dict(queries.dtypes) | dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, *query_key, *ties]) + ", tier int, similarity double"

    def meet(x) -> pd.DataFrame:
        out = []
        a = _unit(np.asarray(x["q_v"], float).reshape(len(x[f"q_{query_key[0]}"]), -1))
        b = _unit(np.asarray(x["r_v"], float).reshape(len(x[f"r_{ties[0]}"]), -1))
        held = {c: np.asarray(x[f"r_{c}"], object) for c in ties}
        for at in range(0, len(a), 256):
            s = np.round(a[at : at + 256] @ b.T, 12)
            if same:
                for row, wanted in enumerate(x[f"q_{same}"][at : at + 256]):
                    if wanted is not None:
                        s[row, held[same] != wanted] = -np.inf
            level = np.zeros(s.shape, np.int32)
            if tier:
                for row in range(len(s)):
                    level[row] = tier[1](tuple(x[f"q_{c}"][at + row] for c in tier[0]), held)
            # similarities lie within 1 of 0, so a level outweighs them
            best = np.argsort(4.0 * level - s, axis=1, kind="stable")[:, :k]
            i, j = np.repeat(np.arange(len(s)), best.shape[1]), best.ravel()
            i, j = i[s[i, j] > -np.inf], j[s[i, j] > -np.inf]
            got = {c: x[c] for c in keys} | {c: np.asarray(x[f"q_{c}"])[at + i] for c in query_key} | {c: held[c][j] for c in ties}
            out.append(pd.DataFrame(got | {"tier": level[i, j], "similarity": s[i, j]}))
        return pd.concat(out)

    def run(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if ours.empty or theirs.empty:
            return pd.DataFrame(columns=[*keys, *query_key, *ties, "tier", "similarity"])
        return meet({**ours.iloc[0], **theirs.iloc[0]})

    def dealt(own: DataFrame, name: str, other: DataFrame, other_name: str) -> DataFrame:
        counts = other.select(*keys, f"{other_name}_count").distinct()
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other_name}_count") - 1)).alias(f"{other_name}_no")
        return own.join(counts, keys).select("*", every).drop(f"{other_name}_count")

    pair = [*keys, "q_no", "r_no"]
    hits = dealt(q, "q", r, "r").groupBy(*pair).cogroup(dealt(r, "r", q, "q").groupBy(*pair)).applyInPandas(run, schema)
    order = Window.partitionBy(*query_key).orderBy("tier", F.desc("similarity"), *ties)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("tier")


#: Pivots, and rows that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 32, 2048


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0))


@dataclass
class Ranges:
    """Pivots, and the range of the distances of each (columns) to the rows of every cell (rows)."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def alive(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which cells may hold a row with at least the given similarity to each unit vector: by the triangle inequality a
        row of the cell is as far from the vector as the pivot's distances to the two differ, or farther."""
        d = _apart(x, self.pivots)[:, None, :]
        gap = np.maximum(d - self.high, self.low - d).max(2, initial=0)
        return gap <= np.sqrt(np.maximum(2 - 2 * least, 0))[:, None] + 1e-6


class Cells:
    """Rows by their nearest pivot, and for each pivot the range of its distances to the rows of every cell. Pivots come
    from a bounded sample, as far from each other as can be; the ranges cover all rows. The driver holds PIVOTS vectors and
    PIVOTS x PIVOTS ranges."""

    def __init__(self, rows: DataFrame) -> None:
        known = rows.where("embedding is not null")
        n = known.count()
        h = F.xxhash64("embedding")
        thin = known.where(F.pmod(h, F.lit(1_000_000)) < int(1.1e6 * PIVOT_SAMPLE / n) + 1) if n > PIVOT_SAMPLE else known
        sample = durable(thin.orderBy(h).limit(PIVOT_SAMPLE).select("embedding"), "sample").collect()
        x = _unit(np.array([r[0] for r in sample], float)) if sample else np.zeros((0, 1))
        chosen, away = [0] if len(x) else [], np.full(len(x), np.inf)
        while chosen and len(chosen) < PIVOTS:
            away = np.minimum(away, _apart(x, x[chosen[-1:]])[:, 0])
            if away.max() <= 1e-9:
                break
            chosen.append(int(away.argmax()))
        self.pivots = x[chosen]
        self.rows = durable(self.placed(known), "cells")
        self.ranges = Ranges(self.pivots, *self._ranges())

    def placed(self, df: DataFrame) -> DataFrame:
        """df with the cell of each vector."""
        pivots = self.pivots

        def run(frames):
            for f in frames:
                if len(f):
                    yield f.assign(cell=_apart(_unit(np.array(f["embedding"].tolist(), float)), pivots).argmin(1).astype("int32"))

        kind = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        return df.mapInPandas(run, f"{kind}, cell int")

    def _ranges(self) -> tuple[np.ndarray, np.ndarray]:
        pivots, count = self.pivots, len(self.pivots)

        def run(frames):
            low, high = np.full((count, count), np.inf), np.full((count, count), -np.inf)
            for f in frames:
                d, cell = _apart(_unit(np.array(f["embedding"].tolist(), float)), pivots) if len(f) else None, f["cell"].to_numpy()
                for j in np.unique(cell):
                    own = d[cell == j]
                    low[j], high[j] = np.minimum(low[j], own.min(0)), np.maximum(high[j], own.max(0))
            i, j = np.nonzero(high > -np.inf)
            yield pd.DataFrame({"cell": i.astype("int32"), "pivot": j.astype("int32"), "low": low[i, j], "high": high[i, j]})

        parts = self.rows.select("embedding", "cell").mapInPandas(run, "cell int, pivot int, low double, high double")
        low, high = np.full((count, count), np.inf), np.full((count, count), -np.inf)
        for r in parts.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # PIVOTS x PIVOTS
            low[r["cell"], r["pivot"]], high[r["cell"], r["pivot"]] = r["low"], r["high"]
        return low, high

    def visits(self, queries: DataFrame) -> DataFrame:
        """A row for each query and cell that may hold a hit: queries with `least`, the similarity of a k-th best hit."""
        ranges = self.ranges

        def run(frames):
            for f in frames:
                if len(f):
                    i, cell = np.nonzero(ranges.alive(_unit(np.array(f["embedding"].tolist(), float)), f["least"].to_numpy()))
                    yield f.iloc[i].assign(cell=cell.astype("int32"))

        kind = ", ".join(f"`{c}` {t}" for c, t in queries.dtypes)
        return queries.mapInPandas(run, f"{kind}, cell int")


def nearest_by_cells(queries: DataFrame, rows: DataFrame, keys: list[str], query_key: list[str], ties: list[str], k: int, same: str | None = None) -> DataFrame:
    """What `nearest` returns, for scopes of very many rows: a query first looks into its own cell, and then into those
    alone that can hold a better hit than its k-th best there."""
    cells = Cells(rows)
    asked = queries.select(*keys, *query_key, *([same] if same else []), "embedding").where("embedding is not null")
    inner = [*keys, "cell"]
    first = nearest(cells.placed(asked), cells.rows, inner, query_key, ties, k, same)
    least = F.when(F.count("*") >= k, F.min("similarity")).otherwise(-1.0).alias("_least")
    bound = first.groupBy(*[F.col(c).alias(f"_{c}") for c in query_key]).agg(least)
    both = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in query_key]
    visits = cells.visits(asked.join(bound, both, "left").select(*asked.columns, F.coalesce("_least", F.lit(-1.0)).alias("least")))
    visits = durable(visits, "visits")
    return nearest(visits.drop("least"), cells.rows, inner, query_key, ties, k, same).drop("cell")


def search_attempts(queries: DataFrame) -> DataFrame:
    """query_id, attempt, part, reference: distinct pairs in order. A query with an id tries AD, ENR, GEN for it; others
    try the tags, the preferred one first, by the parts, the preferred one first."""
    parts = F.array_distinct(F.filter(F.concat(F.array("preferred_part"), F.array(F.lit("GEN"), F.lit("ENR"), F.lit("AD"))), lambda x: x.isNotNull()))
    tags = F.array_distinct(F.filter(F.array(F.col("preferred_reference"), F.lit("NATIONAL"), F.lit("AIRSPACE")), lambda x: x.isNotNull()))
    national = F.flatten(F.transform(tags, lambda t: F.transform(parts, lambda p: F.struct(p.alias("part"), t.alias("reference")))))
    own = F.transform(F.array(F.lit("AD"), F.lit("ENR"), F.lit("GEN")), lambda p: F.struct(p.alias("part"), F.col("scope_id").alias("reference")))
    return queries.select("query_id", F.posexplode(F.when(F.col("scope_id").isNotNull(), own).otherwise(national)).alias("attempt", "a")).select("query_id", "attempt", "a.part", "a.reference")


def topk_chunks(queries: DataFrame, chunks: DataFrame, k: int = 15) -> DataFrame:
    """query_id, attempt, chunk_id, similarity, rank. queries(query_id, attempt, part, reference, procedure_type, runway,
    embedding) meet chunks of the same part and reference; chunks of the procedure and runway asked for come first.
    Chunks without a vector never match."""

    def level(asked: tuple, rows: dict[str, np.ndarray]) -> np.ndarray:
        procedure, runway = ((x or "") for x in asked)
        other = np.array([procedure.lower() not in (p or "").lower() for p in rows["procedure_type"]]) if procedure else 0
        away = np.array([r != runway for r in rows["runway"]]) if runway else 0
        return 2 * other + away

    q = queries.withColumnsRenamed({"procedure_type": "asked_procedure", "runway": "asked_runway"})
    held = chunks.where("embedding is not null")
    hits = nearest(q, held, ["part", "reference"], ["query_id", "attempt"], ["chunk_id", "procedure_type", "runway"], k, tier=(["asked_procedure", "asked_runway"], level))
    return hits.select("query_id", "attempt", "chunk_id", "similarity", "rank")


def gated_search(hits: DataFrame, queries: DataFrame, threshold: float = 0.40) -> DataFrame:
    """status (ok, low_confidence, no_match) and the hits of the attempt that counts, best first: the first attempt whose
    best hit reaches the threshold, else the one with the best hit of all."""
    h = hits.withColumn("top", F.max("similarity").over(Window.partitionBy("query_id", "attempt")))
    passes = (F.col("top") >= threshold).cast("int")
    best = F.min(F.struct(-passes, F.when(passes == 1, F.col("attempt").cast("double")).otherwise(-F.col("top")), "attempt")).over(Window.partitionBy("query_id"))
    h = h.withColumn("b", best).where(F.col("attempt") == F.col("b.attempt"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    kept = h.select("query_id", "attempt", "chunk_id", "similarity", F.when(passes == 1, "ok").otherwise("low_confidence").alias("status")).withColumn("rank", F.row_number().over(order))
    return queries.select("query_id").join(kept, "query_id", "left").withColumn("status", F.coalesce("status", F.lit("no_match")))


def topk_facts(queries: DataFrame, facts: DataFrame, k: int = 8, hot_rows: int = 50 * BLOCK_ROWS) -> DataFrame:
    """The k nearest facts of a query's scope (and subsection, if it names one) with similarity and rank; facts are told
    apart by their key. k is kept in 1..50; facts without a vector never match. Where a scope has more than hot_rows facts,
    cells that can't hold a hit are skipped, with the same result."""
    k = max(1, min(50, k))
    scope = ["scope_kind", "scope_id"]
    held, ties = facts.where("embedding is not null"), ["subsection", "entity", "label"]
    largest = held.groupBy(*scope).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    find = nearest_by_cells if largest > hot_rows else nearest
    hits = find(queries, held, scope, ["query_id"], ties, k, "subsection")
    return hits.join(held.drop("embedding"), [*scope, *ties])


def list_scope_ids(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("scope_kind") == kind).select("scope_id").distinct().orderBy("scope_id")


def find_scope(names: DataFrame, facts: DataFrame) -> DataFrame:
    """name, scope_kind, scope_id, n: scopes whose id equals the name without white space and case."""
    scopes = facts.groupBy("scope_kind", "scope_id").agg(F.count("*").alias("n")).withColumn("_k", scope_key(F.col("scope_id")))
    return names.select("name", scope_key(F.col("name")).alias("_k")).join(scopes, "_k").drop("_k")


def section_texts(chunks: DataFrame, section: str, mode: str = "prefix") -> DataFrame:
    """reference and text of a section's chunks in page and chunk order. mode: prefix, exact, or family ('AD 2.2' and
    its parts, not 'AD 2.21')."""
    c = F.col("section")
    if mode == "prefix":
        keep = c.startswith(section)
    elif mode == "exact":
        keep = c == section
    else:
        keep = c.startswith(section) & ~c.rlike("^" + section.replace(".", r"\.") + r"\d")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    one = F.array_sort(F.collect_list(F.struct(zero("source_page"), zero("source_chunk"), "content")))
    return chunks.where(keep).groupBy("reference").agg(F.array_join(F.transform(one, lambda x: x["content"]), "\n").alias("text"))


def records_for(records: DataFrame, subsection: str, schema: str) -> DataFrame:
    """Typed records of a section in order; distances lose their unit suffix."""
    r = records.where(F.col("subsection") == subsection).select("scope_id", "record_index", F.from_json("record", schema).alias("r")).select("scope_id", "record_index", "r.*")
    short = {c: c[:-2] for c in r.columns if c in ("tora_m", "toda_m", "asda_m", "lda_m")}
    return r.withColumnsRenamed(short).orderBy("scope_id", "record_index")


def best_section(hits: DataFrame, floor: float = 0.35, margin: float = 0.03) -> DataFrame:
    """query_id, section: the section with the best hit, null if that is weak or too close to the next section's."""
    s = hits.where(F.col("section").rlike(r"(?i)^AD\s*2\.\d{1,2}$")).groupBy("query_id", "section").agg(F.max("similarity").alias("s"))
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "section")
    s = s.withColumns({"n": F.row_number().over(order), "next": F.lead("s").over(order)}).where("n = 1")
    sure = (F.col("s") >= floor) & (F.col("next").isNull() | (F.col("s") - F.col("next") >= margin))
    return hits.select("query_id").distinct().join(s.select("query_id", F.when(sure, F.col("section")).alias("section")), "query_id", "left")


def facts_gate(queries: DataFrame, hits: DataFrame, allowed: tuple[str, ...] = ("subsection", "fallback", "rwy_data", "comms", "navaid", "lighting_data", "declared_distance"), floor: float = 0.42) -> DataFrame:
    """queries with use_facts and outcome: facts answer if the route allows it and the best one is near enough; scopes
    other than AD have nothing else."""
    top = hits.groupBy("query_id").agg(F.max("similarity").alias("top"))
    q = queries.join(top, "query_id", "left")
    near = F.coalesce(F.col("top") >= floor, F.lit(False))
    other = F.col("scope_kind") != "AD"
    use = near & (other | F.col("status").isin(*allowed))
    return q.withColumn("use_facts", use).withColumn("outcome", F.when(use, "facts").when(other, "not_found").otherwise(F.col("status")))


def facts_by_entity(facts: DataFrame) -> DataFrame:
    """scope, entity, lines ('label: value' in order), cite (part and section, if there is one section only)."""
    one = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(": ", "label", "fact_value").alias("t"))))
    part = F.when(F.col("scope_kind") == "AD", "AD").otherwise("ENR")
    return facts.groupBy("scope_kind", "scope_id", "entity").agg(
        F.transform(one, lambda x: x["t"]).alias("lines"),
        F.when(F.count_distinct("subsection") == 1, F.concat_ws(" ", F.first(part), F.first("subsection"))).otherwise(F.first(part)).alias("cite"),
    )


def distances_reply(requests: DataFrame, distances: DataFrame) -> DataFrame:
    """request_id, runway, metric, shown: asked metrics (or all four) of the runways that serve the request."""
    from ..functions.text import runway_serves

    four = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m.lower()).alias("v")) for m in ("TORA", "TODA", "ASDA", "LDA")])
    j = requests.select("request_id", "scope_id", F.col("runway").alias("_r"), "metrics").join(distances, "scope_id").where(runway_serves(F.col("runway"), F.col("_r")))
    j = j.select("request_id", "runway", "metrics", F.explode(four).alias("m")).where((F.coalesce(F.size("metrics"), F.lit(-1)) <= 0) | F.array_contains("metrics", F.col("m.metric")))
    return j.select("request_id", "runway", F.col("m.metric").alias("metric"), F.coalesce(F.concat(F.col("m.v").cast("string"), F.lit(" m")), F.lit("not published")).alias("shown"))
