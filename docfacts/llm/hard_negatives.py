"""Hard-negative mining with a multiway hyperplane tree (GNAT style) over whole-number vectors.

For each anchor and each of its nearest rows of the same label (positives), the nearest rows of another label are wanted
whose score lies in a window below the positive's score. Scores are inner products. One more coordinate makes them
distances: with M the largest length, a row x gets sqrt(M^2 - |x|^2) and an anchor a gets 0, so that
d(a, x)^2 = |a|^2 + M^2 - 2 a.x, and a window of scores is an annulus around the anchor.

The root has up to SPLITS split points, chosen farthest-first from a bounded sample; each row belongs to the nearest. For
every split point the root keeps the range of its distances to the rows of every subtree, its own and its siblings'. A
subtree is stored as blocks of bounded size, each with split points, leaves and ranges of its own. An anchor skips each
subtree and each leaf whose ranges, seen from any split point, cannot meet its annuli; the leaves left are compared
exactly. Ranges are real numbers with a slack for rounding; scores and their order are exact.

Anchors travel to the subtrees they must visit and rows stay in their blocks; a block and a chunk of anchors meet in a
group of their own, so a large subtree or many copies of a vector spread over many tasks. What a group returns is bounded
by its anchors. The sample and the root's ranges (SPLITS x SPLITS) are all that the driver holds.

Rows take part if label and vector are not null and no component is null, NaN or infinite. Components become
floor(256 * x); a vector's squared length must stay below 2**53, where doubles hold every score (else OverflowError). A
vector that is shorter than the longest counts as filled up with zeros. Higher scores come first, ties by smaller vec_id; a
null vec_id counts as the largest long there, is returned as null, and is never an anchor. Rows are told apart by place,
so repeated rows are anchors, positives and negatives of their own. Empty tables give empty results, and further columns
are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .centroids import matrix, sampled, usable, whole
from .common import durable, map_arrow

#: Split points of the root, rows they are chosen from, most split points of a block, rows for each of them.
SPLITS, SAMPLE, LEAVES, LEAF_ROWS = 64, 4096, 32, 128
#: Rows of a block at least and at most, and anchors of a chunk.
LEAST_BLOCK, MOST_BLOCK, CHUNK = 256, 4096, 512
EXACT, NONE, NO_ID = 2**53, -(2**62), 2**63 - 1


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Positions of up to `count` different points, each as far as can be from those before it."""
    if not len(points):
        return np.zeros(0, np.int64)
    chosen, away = [0], np.full(len(points), np.inf)
    while len(chosen) < count:
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(1))
        far = int(away.argmax())
        if away[far] <= 0:
            break
        chosen.append(far)
    return np.array(chosen)


@dataclass
class Node:
    """Split points (rows with their additional coordinate) and ranges of their distances to each subtree."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    most: float

    def apart(self, v: np.ndarray) -> np.ndarray:
        """Distances of rows from the split points."""
        x = lifted(v, self.most)
        square = (x * x).sum(1)[:, None] + (self.points**2).sum(1) - 2 * (x @ self.points.T)
        return np.sqrt(np.maximum(square, 0))

    def alive(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which subtrees (columns) each anchor must visit for scores in any of its windows low..high (columns)."""
        size = (anchors * anchors).sum(1)[:, None] + self.most
        slack = 1e-6 * (np.sqrt(size) + 1)
        d = np.sqrt(np.maximum(size - 2 * (anchors @ self.points[:, :-1].T), 0))
        inner, outer = (np.sqrt(np.maximum(size - 2 * x.astype(float), 0)) for x in (high, low))
        out = np.zeros((len(anchors), self.low.shape[1]), bool)
        for a in range(0, len(anchors), 128):
            to = d[a : a + 128, :, None]
            least = np.maximum(to - self.high, self.low - to).max(1, initial=0)
            most = (to + self.high).min(1, initial=np.inf)
            for w in range(low.shape[1]):
                full = (low[a : a + 128, w] <= high[a : a + 128, w])[:, None]
                s = slice(a, a + 128)
                out[s] |= full & (least <= outer[s, w : w + 1] + slack[s]) & (most >= inner[s, w : w + 1] - slack[s])
        return out


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Rows with the coordinate that gives all the same length."""
    v = v.astype(float)
    return np.concatenate((v, np.sqrt(np.maximum(most - (v * v).sum(1, keepdims=True), 0))), 1)


def ranges(apart: np.ndarray, part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance of each split point (rows) to each part (columns); none: an empty range."""
    low, high = np.full((apart.shape[1], parts), np.inf), np.full((apart.shape[1], parts), -np.inf)
    for j in np.unique(part):
        own = apart[part == j]
        low[:, j], high[:, j] = own.min(0), own.max(0)
    return low, high


def prepared(embeddings: DataFrame, anchors: Column) -> DataFrame:
    """row_no, vec_id, label, anchor, v: rows that take part, as a stored table."""
    id_ = F.coalesce(F.col("vec_id"), F.lit(NO_ID)).cast("long")
    part = embeddings.where(F.col("label").isNotNull() & usable(F.col("embedding")))
    kept = part.select(
        F.monotonically_increasing_id().alias("row_no"), id_.alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), whole(F.col("embedding")).alias("v"),
    )
    return durable(kept, "vectors")


class Tree:
    """The root, and the blocks of its subtrees as stored tables."""

    def __init__(self, rows: DataFrame, k: int) -> None:
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        n, width, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
        self.n, self.width, self.most = n, width or 0, float(most or 0)
        if self.most >= EXACT:
            raise OverflowError("vectors too long for exact scores")
        fill = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(self.width) - F.size("v")))
        rows = rows.withColumn("v", fill)
        sample = sampled(rows, n, SAMPLE, "row_no")
        points = lifted(np.array([r["v"] for r in sample], float).reshape(len(sample), self.width), self.most)
        points = points[farthest_first(points, SPLITS)]
        none = np.zeros((len(points), len(points)))
        self.root = Node(points, none, none, self.most)
        self.rows = durable(self._placed(rows), "placed")
        self.root.low, self.root.high = self._ranges()
        self.limit = int(np.clip(n // (2 * SPLITS), LEAST_BLOCK, MOST_BLOCK))
        self.blocks = durable(self._built(k), "blocks")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with the number of the nearest split point (ties: the first)."""
        root, width = self.root, self.width

        def run(batches):
            for b in (b for b in batches if b.num_rows):
                cell = root.apart(matrix(b.column("v"), width)).argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

        return map_arrow(rows, run, rows.withColumn("cell", F.lit(0)).schema)

    def _ranges(self) -> tuple[np.ndarray, np.ndarray]:
        root, width, count = self.root, self.width, len(self.root.points)

        def run(batches):
            low, high = np.full((count, count), np.inf), np.full((count, count), -np.inf)
            for b in (b for b in batches if b.num_rows):
                one = ranges(root.apart(matrix(b.column("v"), width)), b.column("cell").to_numpy(), count)
                low, high = np.minimum(low, one[0]), np.maximum(high, one[1])
            full = np.flatnonzero(high.max(0, initial=-np.inf) > -np.inf)
            cols = [pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * count, pa.array(x[:, full].T.ravel())) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *cols], names=["cell", "low", "high"])

        parts = map_arrow(self.rows.select("cell", "v"), run, "cell int, low array<double>, high array<double>")
        ends = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(count)]
        low, high = np.full((count, count), np.inf), np.full((count, count), -np.inf)
        for r in parts.groupBy("cell").agg(*ends).collect() if count else []:  # SPLITS rows at most
            low[:, r["cell"]] = [r[f"low{i}"] for i in range(count)]
            high[:, r["cell"]] = [r[f"high{i}"] for i in range(count)]
        return low, high

    def _built(self, k: int) -> DataFrame:
        """A row for each block: its rows in the order of vec_id, its node, and for each of its anchors the k-th best
        score of its label in the block (a bound for what is to come)."""
        most, width = self.most, self.width
        parts = self.rows.groupBy("cell").agg(F.ceil(F.count("*") / self.limit).cast("int").alias("blocks"))
        dealt = self.rows.join(F.broadcast(parts), "cell")  # SPLITS rows at most
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row_no"), F.col("blocks")).cast("int"))

        def build(x: pd.DataFrame) -> pd.DataFrame:
            x = x.sort_values(["vec_id", "row_no"])
            v = np.array(x["v"].tolist(), np.int64).reshape(len(x), width)
            up = lifted(v, most)
            points = up[farthest_first(up, int(np.clip(len(x) // LEAF_ROWS, 1, LEAVES)))]
            apart = Node(points, points, points, most).apart(v)
            leaf = apart.argmin(1)
            low, high = ranges(apart, leaf, len(points))
            label, at = x["label"].to_numpy(), np.flatnonzero(x["anchor"].to_numpy())
            bound = np.full(len(at), NONE)
            for m, a in enumerate(at):
                s = v[label == label[a]] @ v[a]
                if len(s) > k:  # the anchor itself is among them
                    s = np.sort(np.delete(s, np.flatnonzero(np.flatnonzero(label == label[a]) == a)))
                    bound[m] = s[-k]
            one = {
                "cell": x["cell"].iloc[0], "block": x["block"].iloc[0], "blocks": x["blocks"].iloc[0], "row_no": x["row_no"].to_numpy(), "vec_id": x["vec_id"].to_numpy(),
                "label": label, "v": v.tobytes(), "points": points.tobytes(), "leaf": leaf.astype(np.int32), "low": low.ravel(), "high": high.ravel(),
                "anchor_row": x["row_no"].to_numpy()[at], "bound": bound,
            }
            return pd.DataFrame([one])

        schema = "cell int, block int, blocks int, row_no array<long>, vec_id array<long>, label array<long>, v binary, points binary, leaf array<int>, low array<double>, high array<double>, anchor_row array<long>, bound array<long>"
        return dealt.groupBy("cell", "block").applyInPandas(build, schema)

    def anchors(self) -> DataFrame:
        """row_no, vec_id, label, v and the window low..high in which the positives lie."""
        bounds = self.blocks.select(F.explode(F.arrays_zip("anchor_row", "bound")).alias("a")).select(F.col("a.anchor_row").alias("row_no"), F.array("a.bound").alias("low"))
        return self.rows.where("anchor").select("row_no", "vec_id", "label", "v").join(bounds, "row_no").withColumn("high", F.array(F.lit(-NONE)))

    def visits(self, anchors: DataFrame) -> DataFrame:
        """A row for each anchor and subtree that it can't skip. anchors: row_no, label, v, low, high (as many windows each)."""
        root, width = self.root, self.width

        def run(batches):
            for b in (b for b in batches if b.num_rows):
                windows = [matrix(b.column(c), len(b.column(c)[0])) for c in ("low", "high")]
                i, cell = np.nonzero(root.alive(matrix(b.column("v"), width).astype(float), *windows))
                rows = b.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

        own = anchors.select("row_no", "label", "v", "low", "high")
        return map_arrow(own, run, own.withColumn("cell", F.lit(0)).schema)

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor_row, window, rank, vec_id, score: for each window the k best rows of the anchor's label (other than the
        anchor), or of other labels."""
        width, most = self.width, self.most
        asked = durable(self.visits(anchors), "visits")
        chunks = asked.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        dealt = asked.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("row_no"), F.col("chunks")).cast("int"))
        packed = dealt.groupBy("cell", "chunk").agg(F.collect_list(F.struct("row_no", "label", "v", "low", "high")).alias("a"))

        def column(c: str) -> Column:
            return F.transform("a", lambda x: x[c])

        packed = packed.select("cell", "chunk", column("row_no").alias("q_row"), column("label").alias("q_label"), *[F.flatten(column(c)).alias(f"q_{c}") for c in ("v", "low", "high")])
        numbers = self.blocks.groupBy("cell").agg(F.first("blocks").alias("blocks"))
        left = packed.join(F.broadcast(numbers), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = self.blocks.drop("anchor_row", "bound", "blocks").join(F.broadcast(chunks), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        key = ["cell", "block", "chunk"]

        def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if q.empty or r.empty:  # a block may be without rows
                return pd.DataFrame(columns=["anchor_row", "window", "vec_id", "row_no", "score"])
            q, r = q.iloc[0], r.iloc[0]
            own, ids = np.asarray(q["q_row"]), np.asarray(r["vec_id"])
            x = np.asarray(q["q_v"], float).reshape(len(own), width)
            low, high = (np.asarray(q[f"q_{c}"], np.int64).reshape(len(own), -1) for c in ("low", "high"))
            v = np.frombuffer(r["v"], np.int64).reshape(len(ids), width).astype(float)
            points = np.frombuffer(r["points"]).reshape(-1, width + 1)
            node = Node(points, *(np.asarray(r[c], float).reshape(len(points), -1) for c in ("low", "high")), most)
            alive, leaf = node.alive(x, low, high), np.asarray(r["leaf"])
            score = np.full((len(own), len(ids)), -np.inf)
            for j in range(len(points)):
                rows, cols = np.flatnonzero(alive[:, j]), np.flatnonzero(leaf == j)
                if len(rows):
                    score[np.ix_(rows, cols)] = x[rows] @ v[cols].T
            mine = np.asarray(q["q_label"])[:, None] == np.asarray(r["label"])
            score[mine != same] = -np.inf
            if same:
                score[own[:, None] == np.asarray(r["row_no"])] = -np.inf
            out = []
            for w in range(low.shape[1]):
                left = np.where((score >= low[:, w, None]) & (score <= high[:, w, None]), score, -np.inf)
                for _ in range(min(k, len(ids))):  # the first of equal scores has the smallest vec_id
                    at = left.argmax(1)
                    best = left[np.arange(len(own)), at]
                    full = np.flatnonzero(best > -np.inf)
                    if not len(full):
                        break
                    out.append((own[full], np.full(len(full), w), ids[at[full]], np.asarray(r["row_no"])[at[full]], best[full].astype(np.int64)))
                    left[full, at[full]] = -np.inf
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
            return pd.DataFrame(dict(zip(["anchor_row", "window", "vec_id", "row_no", "score"], cols, strict=True)))

        schema = "anchor_row long, window int, vec_id long, row_no long, score long"
        hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, schema)
        order = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), "vec_id", "row_no")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("row_no")


def floor_percent(score: Column, percent: int) -> Column:
    """percent / 100 of a whole score, rounded down. Products of whole numbers, since a quotient of doubles may be off."""
    whole_hundreds = F.floor(score / 100)
    rest = score - whole_hundreds * 100
    return whole_hundreds * percent + F.floor(rest * percent / 100)


def mine(embeddings: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every row for which `anchors` holds,
    its first `positives` other rows of the same label, and for each of these the first `negatives` rows of other labels
    with low % to high % of the positive's score."""
    rows = prepared(embeddings, anchors)
    tree = Tree(rows, positives)
    asked = tree.anchors()
    found = durable(tree.search(asked, positives, True), "positives")
    pairs = F.array_sort(F.collect_list(F.struct("rank", "score")))
    named = asked.select("row_no", "label", "v").join(found.groupBy(F.col("anchor_row").alias("row_no")).agg(pairs.alias("p")), "row_no")
    # windows that are not there are empty (1..0)
    at = F.sequence(F.lit(0), F.lit(positives - 1))
    have = lambda i: i < F.size("p")
    score = lambda i: F.get("p", i)["score"]
    windows = named.select(
        "row_no", "label", "v",
        F.transform(at, lambda i: F.when(have(i), -floor_percent(-score(i), low)).otherwise(F.lit(1))).cast("array<long>").alias("low"),
        F.transform(at, lambda i: F.when(have(i), floor_percent(score(i), high)).otherwise(F.lit(0))).cast("array<long>").alias("high"),
    )
    worse = tree.search(windows, negatives, False)
    known = found.select("anchor_row", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = tree.rows.where("anchor").select(F.col("row_no").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    out = worse.join(known, ["anchor_row", "window"]).join(names, "anchor_row")

    def real(c: str) -> Column:
        return F.when(F.col(c) != NO_ID, F.col(c)).alias(c)

    return out.select(real("anchor_id"), real("positive_id"), "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
