"""SimHash near-duplicates with pigeonhole blocks.

A fingerprint of 64 bits is cut into BLOCKS blocks. Two fingerprints that differ in at most DISTANCE bits agree on at
least BLOCKS - DISTANCE whole blocks, so each fingerprint is filed under every choice of that many blocks; those filed
together are compared, and the Hamming distance decides. Equal fingerprints are one node, so a group of copies costs one
row. A crowded file is cut into tiles of bounded size, each pair of which is compared in some task, and a task returns
the links of a spanning forest, not all pairs: same components, rows in proportion to the fingerprints.

Null and empty texts have fingerprint 0 and link like others; null doc_ids take part in links but never name a
component, unless it has no other id (then null). Repeated rows are returned as often as they come. Further columns are
left alone, an empty table gives an empty one. A very long text is fingerprinted whole in one task, which holds a hash for
each of its shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow
from .components import components

SHINGLE, SEED, DISTANCE, BLOCKS = 3, 42, 3, 6
#: Fingerprints that one tile of a crowded file takes from each of its two parts.
TILE = 4096


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(text: str) -> int:
    """Signed, as Spark holds it: a bit is 1 if more than half of the hashes set it."""
    h = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        part = h[a : a + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(documents: DataFrame, text: str = "text", into: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id) and the fingerprint of each row."""
    keep = keep or ["doc_id"]
    rows = documents.select(*keep, *([] if text in keep else [text]))

    def run(batches):
        for b in batches:
            fp = [fingerprint(t or "") for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp, pa.int64())], names=[*keep, into])

    return map_arrow(rows, run, rows.select(*keep).withColumn(into, F.lit(0).cast("long")).schema)


def _masks() -> list[int]:
    edges = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(BLOCKS)]
    signed = []
    for chosen in combinations(block, BLOCKS - DISTANCE):
        m = sum(chosen)
        signed.append(m - (1 << 64) if m >> 63 else m)
    return signed


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of a spanning forest over all pairs within the distance; each fingerprint is looked at once."""
    left, a, b = np.unique(fps).view(np.uint64), [], []  # unsigned: numpy counts the bits of absolute values
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            front = queue.pop()
            for x in front:
                near = np.bitwise_count(left ^ x) <= distance
                if near.any():
                    hit = left[near]
                    a.append(np.full(len(hit), x))
                    b.append(hit)
                    queue.append(hit)
                    left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)) if a else (none, none)


def links(nodes: DataFrame, fp: str = "fp", tile: int = TILE) -> DataFrame:
    """a, b: links within DISTANCE whose components are those of all such pairs. nodes: distinct fingerprints."""
    one = F.col(fp)
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), one.bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(_masks())])
    filed = nodes.select(one.alias("fp"), F.explode(keys).alias("k")).select("fp", "k.choice", "k.part")
    # counted and joined back, so that a crowded file can be split over tasks
    crowd = filed.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1")
    filed = filed.join(crowd, ["choice", "part"])
    # A file of n fingerprints has c parts by hash; every two parts meet in one tile, with c = 1 all in tile (0, 0).
    c = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), c).cast("int")
    others = F.when(c == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), c - 1), lambda x: x != own))
    tiles = (
        filed.withColumn("own", own)
        .withColumn("other", F.explode(others))
        .select("choice", "part", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .groupBy("choice", "part", "i", "j")
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps")
    )

    def run(batches):
        for batch in batches:
            found = [forest(x) for x in (batch.column("fps")[k].values.to_numpy(zero_copy_only=False) for k in range(batch.num_rows))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x[side] for x in found]) if found else [], pa.int64()) for side in (0, 1)],
                names=["a", "b"],
            )

    return map_arrow(tiles, run, "a long, b long").distinct()


def assign(prints: DataFrame, ids: list[str] | None = None, link=links) -> DataFrame:
    """fp and its component's smallest id struct over `ids` (doc_id), as columns fp and least, one row a fingerprint.
    link: from the distinct fp to links a, b between them.

    prints: a stored table with the ids and fp of each row, equal fingerprints as often as they come."""
    least = F.min(F.struct(*(ids or ["doc_id"])))
    first = (ids or ["doc_id"])[0]
    nodes = durable(
        prints.groupBy("fp").agg(F.min(F.when(F.col(first).isNotNull(), F.struct(*(ids or ["doc_id"])))).alias("least"), least.alias("any")),
        "nodes",
    )
    roots = components(link(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", "any", F.coalesce("root", "fp").alias("root")
    )
    rooted = durable(rooted, "rooted")
    top = rooted.groupBy("root").agg(F.coalesce(F.min("least"), F.min("any")).alias("least"))
    return rooted.select("fp", "root").join(top, "root").select("fp", "least")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = durable(fingerprints(documents), "prints")
    return prints.join(assign(prints), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id (of rows that repeat it,
    the first stored; rows without an id come last)."""
    names = documents.columns
    numbered = documents.toDF(*[f"c{i}" for i in range(len(names))])
    where = {n.lower(): f"c{i}" for i, n in enumerate(names)}
    held = fingerprints(numbered, where["text"], "fp", numbered.columns)
    held = durable(held.withColumn("row_no", F.monotonically_increasing_id()), "held")
    prints = held.select(F.col(where["doc_id"]).alias("doc_id"), "row_no", "fp")
    kept = assign(prints, ["doc_id", "row_no"]).select(F.col("least.row_no").alias("row_no")).distinct()
    return held.join(kept, "row_no", "left_semi").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
