"""Centroid clustering (k-means over whole numbers) with PCA-rotated filtering.

Every vector is stored with its leading coordinates in a rotated frame (principal axes) and the length of what remains.
For a centroid treated alike, the squared distance of the leading coordinates plus the squared difference of the two
remainders is a lower bound of the true squared distance. So a vector first measures itself against the centroid with
the smallest bound, and only centroids whose bound does not exceed that distance survive and are verified, in integers.
The bound is real arithmetic with a slack for rounding; which centroid is nearest, sums and means are exact integers.

Vectors are never gathered: a round is one pass in which a task returns a sum for each centroid. The driver holds the
centroids, those sums, and the sample to which the axes are fitted (SAMPLE vectors at most, which affects the work only).

A vector is kept if it has exactly `width` components, none null, NaN or infinite; others are in no cluster and not in
the result. Components become floor(256 * x) and must then lie below 2**27 in size, so that a squared distance fits a
long (else OverflowError). Ties go to the smaller centroid number. Repeated rows are clustered one by one, null ids too
(they come last among the first centroids). With fewer vectors than k each is a centroid; an empty table gives an empty
result; further columns are left alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow

#: Vectors to which the axes are fitted, leading axes, and vectors worked on at once.
SAMPLE, LEADING, SLICE = 4096, 16, 1024
#: Sizes of components below which squared distances of 64 components fit a long.
MOST = 1 << 27


def usable(vector: Column) -> Column:
    """No vector that is null or has a null, NaN or infinite component."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def sampled(rows: DataFrame, n: int, most: int, *by: str) -> list:
    """At most `most` of n rows, chosen by a hash of the columns `by`. A threshold thins a large table first, and the
    rows meet in a task, not in the driver, before it sees them."""
    h = F.xxhash64(*by)
    if n > most:
        rows = rows.where(F.pmod(h, F.lit(1_000_000)) < int(1.1e6 * most / n) + 1)
    return durable(rows.orderBy(h, *by).limit(most), "sample").collect()


@dataclass
class Frame:
    """Leading principal axes, as columns."""

    axes: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, leading: int) -> Frame:
        x = sample - sample.mean(0) if len(sample) else sample
        return cls(np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :leading])

    def split(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and length of the remainder."""
        v = v.astype(float)
        lead = v @ self.axes
        return lead, np.sqrt(np.maximum((v * v).sum(1) - (lead * lead).sum(1), 0))


class Centroids:
    """Whole-number centroids as seen in a frame."""

    def __init__(self, at: np.ndarray, frame: Frame) -> None:
        self.at = at
        self.lead, self.rest = frame.split(at)
        self.size = (self.lead * self.lead).sum(1)
        self.most = float((at.astype(float) ** 2).sum(1).max(initial=0))

    def nearest(self, v: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest centroid, squared distance, and how many centroids were verified, of each row."""
        size = (lead * lead).sum(1)
        bound = size[:, None] + self.size - 2 * (lead @ self.lead.T) + (rest[:, None] - self.rest) ** 2
        first = ((v - self.at[bound.argmin(1)]) ** 2).sum(1)
        slack = 1e-9 * (size + rest * rest + self.most) + 1e-6
        i, j = np.nonzero(bound <= (first + slack)[:, None])
        d = ((v[i] - self.at[j]) ** 2).sum(1)
        order = np.lexsort((j, d, i))
        best = order[np.concatenate(([True], np.diff(i[order]) > 0))] if len(order) else order
        return j[best], d[best], np.bincount(i, minlength=len(v))


def _each_slice(batch: pa.RecordBatch, width: int, centroids: Centroids):
    v, lead, rest = matrix(batch.column("v"), width), matrix(batch.column("lead"), centroids.lead.shape[1]), batch.column("rest").to_numpy()
    for a in range(0, len(v), SLICE):
        yield a, v[a : a + SLICE], *centroids.nearest(v[a : a + SLICE], lead[a : a + SLICE], rest[a : a + SLICE])


def rotated(vectors: DataFrame, frame: Frame, width: int) -> DataFrame:
    """vec_id, v, lead, rest. vectors: vec_id and v."""

    def run(batches):
        for b in batches:
            lead, rest = frame.split(matrix(b.column("v"), width))
            rows = pa.ListArray.from_arrays(np.arange(len(lead) + 1, dtype=np.int32) * lead.shape[1], pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), rows, pa.array(rest)], names=["vec_id", "v", "lead", "rest"])

    kind = dict(vectors.dtypes)["vec_id"]
    return map_arrow(vectors, run, f"vec_id {kind}, v array<long>, lead array<double>, rest double")


def moved(rows: DataFrame, centroids: Centroids, width: int) -> np.ndarray:
    """The centroids after one round: floored means, empty ones where they were."""
    k = len(centroids.at)

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            for _, v, nearest, _, _ in _each_slice(b, width, centroids):
                count += np.bincount(nearest, minlength=k)
                np.add.at(total, nearest, v)
        full = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * width, pa.array(total[full].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(count[full]), sums], names=["cluster", "n", "s"])

    parts = map_arrow(rows.select("v", "lead", "rest"), run, "cluster int, n long, s array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    out = centroids.at.copy()
    for r in total.collect():  # k rows at most
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def assigned(rows: DataFrame, centroids: Centroids, width: int) -> DataFrame:
    """vec_id, cluster, distance, n_verified."""

    def run(batches):
        for b in batches:
            for a, v, *found in _each_slice(b, width, centroids):
                j, d, n = (pa.array(x.astype(t)) for x, t in zip(found, (np.int32, np.int64, np.int32), strict=True))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").slice(a, len(v)), j, d, n], names=["vec_id", "cluster", "distance", "n_verified"])

    kind = dict(rows.dtypes)["vec_id"]
    return map_arrow(rows, run, f"vec_id {kind}, cluster int, distance long, n_verified int")


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, seed: str = "2:", leading: int = LEADING) -> DataFrame:
    """vec_id, cluster, distance, n_verified (centroids measured in integers), cluster_inertia, inertia, centroid_sha256.

    Centroids start as the k vectors with the smallest SHA-256 of seed and id."""
    spark = embeddings.sparkSession
    kept = embeddings.where((F.size("embedding") == width) & usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding")).alias("v"))
    kept = durable(kept, "vectors")
    n, most = kept.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, -x - 1))))).first()
    if most is not None and most >= MOST:
        raise OverflowError(f"components of {most / 256:.3g} and more give squared distances beyond a long")
    frame = Frame.fit(np.array([r["v"] for r in sampled(kept, n, SAMPLE, "vec_id")], float).reshape(-1, width), min(leading, width))
    rows = durable(rotated(kept, frame, width), "rotated")
    order = F.asc_nulls_last(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    first = durable(kept.orderBy(order, "v").limit(k), "seeds").orderBy(order, "v").collect()
    now = Centroids(np.array([r["v"] for r in first], np.int64).reshape(-1, width), frame)
    for _ in range(rounds if first else 0):
        now = Centroids(moved(rows, now, width), frame)
    found = durable(assigned(rows, now, width), "assigned")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    facts = [(j, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, now.at[j])).encode()).hexdigest()) for j, s in inertia.items()]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "n_verified", "cluster_inertia", "inertia", "centroid_sha256")
