"""Clustering against plain k-means over whole numbers."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from docfacts.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label string, v string, lead string, rest string, cluster string, inertia string"


def brute(rows, k, rounds, width):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for j, vs in own.items():
            at[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    sha = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(at)}
    return Counter((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found)


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, v, *"abcdef") for i, v in rows], SCHEMA).repartition(5)
    out = centroids.cluster(df, **how)
    return Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in out.collect())


@pytest.mark.parametrize(("k", "rounds", "spread"), [(7, 3, 1.0), (7, 0, 0.02), (40, 2, 0.004)])
def test_clusters(spark, k, rounds, spread):
    rng = np.random.default_rng(k + rounds)
    middle = rng.normal(size=(5, 6))
    rows = [(n, (middle[n % 5] + spread * rng.normal(size=6)).tolist()) for n in range(160)]
    rows += [(200 + n, [0.5] * 6) for n in range(60)] + [(3, rows[3][1]), (3, rows[3][1]), (None, [1.0] * 6), (None, [1.0] * 6)]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [None] + [1.0] * 5), (905, [math.nan] + [1.0] * 5), (906, [-math.inf] + [1.0] * 5)]
    assert got(spark, rows, k=k, rounds=rounds, width=6) == brute(rows, k, rounds, 6)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.1, -0.1]), (2, [0.1, -0.1]), (None, [5.0, 5.0])]
    assert got(spark, rows, k=40, rounds=2, width=2) == brute(rows, 40, 2, 2)
    assert not got(spark, [(1, None)], width=2)
    assert not got(spark, [], width=2)


def test_components_too_large(spark):
    with pytest.raises(OverflowError):
        got(spark, [(1, [1e9, 0.0]), (2, [0.0, 0.0])], width=2)
    near = [(n, [(centroids.MOST - 1 - n) / 256 * (-1) ** n] * 2) for n in range(9)]
    assert got(spark, near, k=3, rounds=2, width=2) == brute(near, 3, 2, 2)


def test_bounds_spare_most_centroids():
    rng = np.random.default_rng(1)
    middle = rng.normal(scale=200, size=(40, 64))
    v = (middle[rng.integers(0, 40, 3000)] + rng.normal(scale=20, size=(3000, 64))).astype(np.int64)
    frame = centroids.Frame.fit(v.astype(float), 16)
    c = centroids.Centroids(middle.astype(np.int64), frame)
    j, d, n = c.nearest(v, *frame.split(v))
    every = ((v[:, None] - c.at) ** 2).sum(2)
    assert (j == every.argmin(1)).all() and (d == every.min(1)).all()
    assert n.mean() < 2
