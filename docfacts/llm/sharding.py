"""Sharding: minimax contiguous partition of groups of equal texts, with DataFrame functions only.

Groups (equal texts; a null text counts as the empty one) stand in the order of a hash of their text. The smallest
capacity at which a greedy walk needs no more than `shards` shards is found by binary search, and the order is cut where
that walk cuts. The walk runs over a bounded summary of the order: sums by hash prefix. Prefixes in which a cut may fall
are split further, round by round, until every cut is exact; a round sends a bounded number of sums to the driver,
whatever the number of groups.

Ties cannot arise (hashes differ), repeated rows stay together and are numbered one by one, rows with null ids are
numbered like others, an empty table gives an empty result, a very long text is read once, for its hash, in the task that scans it, and further
columns are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

KEY_DIGITS, FIRST_DIGITS, MORE_DIGITS = 32, 3, 2
#: Rows are numbered within cells of each shard, so that no task numbers a whole shard.
CELLS = 1024


class Order:
    """Runs of groups in order: prefix of the hash, bytes, and whether the run is one group."""

    def __init__(self, rows: list[tuple[str, int, bool]]) -> None:
        self.rows = sorted(rows)
        self.cum = np.concatenate(([0], np.cumsum([r[1] for r in self.rows], dtype=np.int64)))
        self.total = int(self.cum[-1])

    def walk(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Bytes before each cut of the greedy walk. A run of several groups is taken whole or not at all, or, if
        hopeful, as far as the capacity goes: the true walk lies between the two."""
        at, out = 0, []
        for _ in range(shards):
            goal = at + capacity
            if goal >= self.total:
                at = self.total
            else:
                i = int(np.searchsorted(self.cum, goal, "right")) - 1
                at = goal if hopeful and not self.rows[i][2] else int(self.cum[i])
            out.append(at)
        return out

    def least(self, shards: int, hopeful: bool) -> int:
        """Binary search for the smallest capacity with which the walk reaches the end."""
        low = max([-(-self.total // shards), *(r[1] for r in self.rows if r[2])], default=0)
        high = self.total
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, hopeful)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def open_runs(self, shards: int) -> tuple[int, list[str]]:
        """The least capacity that surely does, and the runs that must be split before it and its cuts are exact."""
        low, high = self.least(shards, True), self.least(shards, False)
        first, last = self.walk(low, shards, False)[:-1], self.walk(high, shards, True)[:-1]
        found = set()
        for a, b in zip(first, last, strict=True):
            i = max(0, int(np.searchsorted(self.cum, a, "right")) - 1)
            while i < len(self.rows) and self.cum[i] <= b:
                if not self.rows[i][2] and self.cum[i + 1] > a:
                    found.add(self.rows[i][0])
                i += 1
        return high, sorted(found)

    def cuts(self, capacity: int, shards: int) -> list[str]:
        """The prefix with which each shard but the first begins."""
        at = self.walk(capacity, shards, False)[:-1]
        return [self.rows[int(np.searchsorted(self.cum, x))][0] if x < self.total else "g" for x in at]


def _summary(groups: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
    rows = groups.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    return [(r["p"], r["b"], r["n"] == 1) for r in rows.collect()]


def plan(groups: DataFrame, shards: int) -> list[str]:
    """Hash prefixes at which shards 1.. begin. groups: key (hex) and bytes, one row a group."""
    digits = FIRST_DIGITS
    order = Order(_summary(groups, digits))
    while True:
        capacity, split = order.open_runs(shards)
        if not split:
            return order.cuts(capacity, shards)
        finer = []
        for n in sorted({len(p) for p in split}):
            own = [p for p in split if len(p) == n]
            finer += _summary(groups.where(F.substring("key", 1, n).isin(own)), min(KEY_DIGITS, n + MORE_DIGITS))
        gone = set(split)
        order = Order([r for r in order.rows if r[0] not in gone] + finer)


def shard(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, key (hash of the text), shard, slot (gapless from 0 in each shard)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = durable(
        documents.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.substring(F.sha2(text, 256), 1, KEY_DIGITS).alias("key"),
        ),
        "sizes",
    )
    groups = durable(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    number = F.lit(0)
    for cut in plan(groups, shards):
        number = number + (F.col("key") >= cut).cast("int")
    placed = rows.withColumn("shard", number).withColumn("cell", F.pmod(F.xxhash64("doc_id", "key"), F.lit(CELLS)).cast("int"))
    # shards x CELLS counts at most, so this side is small whatever the number of rows
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "cell")
        .agg(F.count("*").alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "key"))
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(starts), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "key", "shard", (F.col("first") + F.col("within") - 1).cast("long").alias("slot"))
    )
