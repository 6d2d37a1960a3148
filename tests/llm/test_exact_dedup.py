"""Exact deduplication against brute force, with hashes that collide."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docfacts.llm import exact_dedup

SCHEMA = "doc_id long, text string, h string, content string, class string, row_no string, keep_id string, group_size string"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def brute(rows, largest):
    by = defaultdict(list)
    for i, t in rows:
        by[low(t)].append(i)
    out = Counter()
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        sha = hashlib.sha256(t.encode()).hexdigest()
        for k, i in enumerate(sorted(ids, key=lambda x: x != keep)):
            out[(i, keep, len(ids), k == 0, sha)] += 1
    return out


@pytest.fixture(scope="module")
def docs(spark):
    long = "Word " * 400_000
    texts = ["a", "A", "b", None, "", " ", "É", "é", "abc", "ABC", "aBc", long, long.lower(), long + "x", "ſ", "K", "k", "cab", "\n", "b"]
    rows = list(enumerate(texts)) + [(3, "a"), (3, "a"), (None, "a"), (None, "only"), (None, "ONLY"), (None, None)] + [(100 + i, "Hot Text") for i in range(500)]
    return rows, spark.createDataFrame([(*r, *"uvwxyz") for r in rows], SCHEMA).repartition(7)


@pytest.mark.parametrize("largest", [False, True])
def test_groups(docs, largest):
    rows, df = docs
    got = exact_dedup.groups(df, largest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows, largest)


@pytest.mark.parametrize("digest", [lambda c: F.length(c), lambda c: F.lit("same")])
def test_colliding_hashes_make_no_group(docs, digest):
    rows, df = docs
    assert Counter(map(tuple, exact_dedup.groups(df, True, digest).collect())) == brute(rows, True)


def test_empty_table(docs):
    assert exact_dedup.groups(docs[1].limit(0)).count() == 0
