"""Hard negatives against brute force; elimination by ranges against plain distances."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfacts.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, row_no string, anchor string, v string, cell string, block string, score string"


def brute(rows, positives, negatives, low, high):
    part = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = Counter()
    for n, (i, lab, v) in enumerate(part):
        if i is None or i % 4:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, same == lab) for m, (j, same, w) in enumerate(part) if m != n]
        for s, p, _ in sorted((x for x in scored if x[2]), key=order)[:positives]:
            fit = [x for x in scored if not x[2] and low * s <= 100 * x[0] <= high * s]
            for rank, (t, j, _) in enumerate(sorted(fit, key=order)[:negatives], 1):
                out[(i, p, rank, j, s, t)] += 1
    return out


def got(spark, rows, *how):
    df = spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA).repartition(5)
    out = hn.mine(df, F.col("vec_id") % 4 == 0, *how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, out.collect()))


@pytest.mark.parametrize(("spread", "how"), [(0.05, (5, 3, 50, 95)), (1.0, (5, 3, 50, 95)), (0.3, (2, 4, -20, 100))])
def test_against_brute_force(spark, monkeypatch, spread, how):
    monkeypatch.setattr(hn, "SPLITS", 6)
    monkeypatch.setattr(hn, "LEAST_BLOCK", 20)
    monkeypatch.setattr(hn, "MOST_BLOCK", 30)
    monkeypatch.setattr(hn, "LEAF_ROWS", 5)
    monkeypatch.setattr(hn, "CHUNK", 8)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 5))
    rows = [(n, (middle[n % 6] + spread * rng.normal(size=5)).tolist(), int(rng.integers(0, 4))) for n in range(240)]
    rows += [(300 + n, [0.25] * 5, n % 2) for n in range(90)]  # copies: ties, a crowded cell
    rows += [(8, rows[8][1], rows[8][2]), (None, rows[9][1], 1), (None, rows[9][1], 1), (996, [0.0] * 5, 1), (997, [0.0] * 5, 2)]
    rows += [(400, None, 1), (404, [1.0] * 5, None), (408, [None] + [1.0] * 4, 1), (412, [math.nan] * 5, 1), (416, [math.inf] * 5, 1), (420, [], 3), (424, [1.0, 2.0], 3)]
    assert got(spark, rows, *how) == brute(rows, *how)


def test_small_tables(spark):
    assert not got(spark, [])
    assert not got(spark, [(0, None, 1)])
    assert not got(spark, [(0, [1.0], 1), (1, [1.0], 2)])
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (4, [0.5], 3)]
    assert got(spark, rows) == brute(rows, 5, 3, 50, 95)
    with pytest.raises(OverflowError):
        got(spark, [(0, [1e9], 1)])


def test_percentages(spark):
    scores = [0, 1, 99, 100, 101, -1, -99, -101, 2**53 - 1, -(2**53) + 1, 37 * 10**13 + 7]
    df = spark.createDataFrame([(s,) for s in scores], "s long")
    for p in (50, 95, 33, -20):
        assert [r[0] for r in df.select(hn.floor_percent(F.col("s"), p)).collect()] == [p * s // 100 for s in scores]


def test_subtrees_are_skipped_only_without_hits():
    rng = np.random.default_rng(5)
    middle = rng.normal(scale=300, size=(12, 16))
    v = (middle[rng.integers(0, 12, 3000)] + rng.normal(scale=10, size=(3000, 16))).astype(np.int64)
    most = float((v * v).sum(1).max())
    up = hn.lifted(v, most)
    points = up[hn.farthest_first(up, 12)]
    node = hn.Node(points, points, points, most)
    part = node.apart(v).argmin(1)
    node.low, node.high = hn.ranges(node.apart(v), part, 12)
    anchors = v[:200].astype(float)
    score = anchors @ v.T
    top = np.sort(score, 1)[:, -6].astype(np.int64)
    low, high = np.stack((top, top // 2, np.ones_like(top)), 1), np.stack((np.full_like(top, 2**62), top * 95 // 100, np.zeros_like(top)), 1)
    for w in ([0], [1], [2], [0, 1, 2]):
        alive = node.alive(anchors, low[:, w], high[:, w])
        hit = np.zeros_like(alive)
        for x in w:
            inside = (score >= low[:, x, None]) & (score <= high[:, x, None])
            for j in range(12):
                hit[:, j] |= inside[:, part == j].any(1)
        assert not (hit & ~alive).any()
        if w == [0]:
            assert alive.mean() < 0.2
        if w == [2]:
            assert not alive.any()
