"""Loads of a partitioned table: what they touch, what they leave alone, and what is left when they are interrupted."""

import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfacts.operators import facts, structure
from docfacts.sources import stages, store, tables
from docfacts.sources.store import Store

SCHEMA = T.StructType().add("part", "string").add("section", "string").add("id", "long").add("v", "string").add("at", "integer")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path):
    return {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet") for f in [os.path.join(d, n)]}


@pytest.fixture(params=[["part"], ["part", "section"]])
def filled(request, spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), SCHEMA, request.param)
    assert s.read().count() == 0
    data = [(p, f"{p} {k}", i, f"{p}{k}{i}", 0) for p in ("AD", "ENR", "GEN", None) for k in (1, 2) for i in range(k * 10, k * 10 + 5)]
    s.upsert(spark.createDataFrame(data, SCHEMA), ["part", "id"])
    assert rows(s.read()) == sorted(data, key=str)
    return s, data


def test_upsert_touches_only_its_partitions(filled, spark):
    s, data = filled
    before = files(s.path)
    up = [("AD", "AD 1", 10, "first", 1), ("AD", "AD 1", 10, "last", 2), ("AD", "AD 1", 99, "new", 1)]
    s.upsert(spark.createDataFrame(up, SCHEMA), ["part", "id"], "at")
    want = [r for r in data if (r[0], r[2]) != ("AD", 10)] + up[1:]
    assert rows(s.read()) == sorted(want, key=str)
    after = files(s.path)
    kept = {f: t for f, t in before.items() if "part=AD" not in f or ("section" in s.partition and "AD 2" not in f.replace("%20", " ") and "AD 1" not in f)}
    assert kept and all(after.get(f) == t for f, t in kept.items())
    assert not [f for f in os.listdir(s.path) if f.startswith("_pending")]


def test_a_row_moves_with_its_partition(filled, spark):
    s, data = filled
    moved = [("ENR", "ENR 9", i, "moved", 1) for i in [*range(10, 15), *range(20, 25)]]
    s.upsert(spark.createDataFrame(moved, SCHEMA), ["id"])  # every id, wherever it was
    assert rows(s.read()) == sorted(moved, key=str)
    assert all("part=ENR" in f for f in files(s.path))


def test_delete(filled):
    s, data = filled
    before = files(s.path)
    s.delete("part = 'AD' and section like 'AD 2%'")
    s.delete("part is null")
    s.delete("id > 1000")
    assert rows(s.read()) == sorted((r for r in data if r[0] and r[1] != "AD 2"), key=str)
    after = files(s.path)
    assert all(after[f] == t for f, t in before.items() if "part=ENR" in f or "part=GEN" in f)


ONE = pytest.mark.parametrize("filled", [["part"]], indirect=True)


@ONE
@pytest.mark.parametrize("step", ["data", "ready", "overwritten"])
def test_interrupted_loads(filled, spark, monkeypatch, step):
    s, data = filled
    up = spark.createDataFrame([("AD", "AD 1", 10, "x", 1)] + [("GEN", "GEN 1", i, "y", 1) for i in range(10, 15)], SCHEMA)
    moved = [("AD", "AD 1", 10, "x", 1)] + [("GEN", "GEN 1", i, "y", 1) for i in range(10, 15)]
    want = [r for r in data if (r[0], r[2]) != ("AD", 10) and not (r[0] == "GEN" and r[2] < 15)] + moved

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(*{"data": (Store, "_mark"), "ready": (Store, "_apply"), "overwritten": (Store, "_delete")}[step], stop)
        with pytest.raises(KeyboardInterrupt):
            s.upsert(up, ["part", "id"])
    again = Store(s.spark, s.path, s.schema, s.partition)
    if step != "overwritten":
        assert rows(again.read()) == sorted(data, key=str)
    again.recover()
    assert rows(again.read()) == sorted(data if step == "data" else want, key=str)
    again.upsert(up, ["part", "id"])
    assert rows(again.read()) == sorted(want, key=str)
    assert not [f for f in os.listdir(s.path) if f.startswith("_pending")]


@pytest.mark.parametrize("filled", [["part", "section"]], indirect=True)
def test_many_partitions_and_keys(filled, spark, monkeypatch):
    s, data = filled
    monkeypatch.setattr(store, "MOST_LISTED", 1)
    monkeypatch.setattr(store, "MOST_BROADCAST", 1)
    moved = [("ENR", "ENR 1", 10, "a", 1), ("GEN", "GEN 1", 11, "b", 1)]
    s.upsert(spark.createDataFrame(moved, SCHEMA), ["id"])
    assert rows(s.read()) == sorted([r for r in data if r[2] not in (10, 11)] + moved, key=str)


@ONE
def test_nothing_to_load(filled, spark):
    s, data = filled
    s.upsert(spark.createDataFrame([], SCHEMA), ["id"])
    assert rows(s.read()) == sorted(data, key=str)


FACT = "scope_kind string, scope_id string, subsection string, entity string, label string, fact_text string"


def texts(n, word="text"):
    return [("AD", f"D{i % 3}", "2.1", "", f"label {i:03}", f"{word} {i}") for i in range(n)]


def asked(folder):
    """The texts of each call of the function."""
    return [f.read_text().split("\n") for f in folder.iterdir()]


def embedder(folder, broken=None):
    def embed(batch):
        if broken and any(t == broken for t in batch):
            raise RuntimeError("the service is gone")
        (folder / uuid.uuid4().hex).write_text("\n".join(batch))
        return [[float(len(t))] if not t.endswith("9") else None for t in batch]

    return embed


def test_embedding_goes_on_where_it_stopped(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "vectors")
    calls.mkdir()
    f = spark.createDataFrame(texts(95), FACT).repartition(5)
    in_order = [r["fact_text"] for r in f.orderBy(*facts.KEY).collect()]
    with pytest.raises(Exception, match="the service is gone"):
        facts.embed_into(f, path, embedder(calls, in_order[47]), size=10, commit=1)
    assert sorted(map(len, asked(calls))) == [10] * 4
    got = facts.embed_into(f, path, embedder(calls), size=10, commit=3)
    every = asked(calls)
    once = [t for b in every for t in b]
    failed = [t for t in in_order if t.endswith("9")]
    assert {t for t in once if once.count(t) > 1} <= set(failed)  # what has no vector is asked for again
    assert sorted(map(len, every))[1:] == [10] * (len(every) - 1)
    assert sorted(r["fact_text"] for r in got.collect()) == sorted(set(in_order) - set(failed))
    assert all(r["embedding"] == [float(len(r["fact_text"]))] for r in got.collect())
    before = len(every)
    facts.embed_into(f, path, embedder(calls), size=10)
    assert sorted(t for b in asked(calls) for t in b) == sorted(once + failed) and len(asked(calls)) == before + 1
    changed = spark.createDataFrame(texts(1, "new"), FACT)
    assert facts.embed_into(changed, path, embedder(calls)).where("fact_text = 'new 0'").count() == 1


def test_batches_do_not_hang_on_arrow(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = facts.embedding_batches(spark.createDataFrame(texts(64), FACT).coalesce(1), embedder(calls), 10).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(map(len, asked(calls))) == [4] + [10] * 6
    assert all((r["embedding"] is None) == r["fact_text"].endswith("9") for r in got) and len(got) == 64


def test_numbers_without_gaps(spark):
    rows = [(i * 7919 % 1000, f"x{i % 3}") for i in range(500)] + [(None, "y"), (5, None)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(9)
    got = sorted((r["n"], r["a"], r["b"]) for r in facts.numbered(df, ["a", "b"], "n").collect())
    assert [n for n, _, _ in got] == list(range(502))
    nulls_first = lambda v: (v is not None, v or 0)
    assert [r[1] for r in got] == sorted((r[0] for r in rows), key=nulls_first)


def test_lines_of_bucketed_words_need_no_shuffle(spark, tmp_path):
    placed = tables.words_from_text(spark.createDataFrame([(i, f"a b {i}\nc d\n\n e") for i in range(50)], "doc_id int, text string"))
    name = f"words_{uuid.uuid4().hex}"
    tables.save_words(placed, name, str(tmp_path / "words"), buckets=4)
    lines = structure.visual_lines(spark.table(name))
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in lines.collect()) == sorted(tuple(r) for r in structure.visual_lines(placed).collect())
    by_page = f"words_{uuid.uuid4().hex}"
    tables.save_words(placed, by_page, str(tmp_path / "pages"), ("doc_id", "page"), 4)
    assert "Exchange" not in structure.visual_lines(spark.table(by_page))._jdf.queryExecution().executedPlan().toString()


def test_long_texts_are_batches_of_their_own(spark):
    long = "word " * 6_000_000  # 30 MB
    df = spark.createDataFrame([(1, "x"), (2, long), (3, "y z")], "doc_id int, text string").coalesce(1)
    placed = tables.words_from_text(df)
    assert {r["doc_id"]: r["n"] for r in placed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 6_000_000, 3: 2}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(stages.BATCH_BYTES)


def test_scans_are_spread_only_when_they_are_few_pieces(spark):
    assert stages.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, 1, 40)
    assert stages.spread(wide) is wide


def test_stages_are_cleared_at_the_end_of_a_run(spark):
    stages.clear(spark)
    held = stages.durable(spark.range(5), "some")
    path = held.inputFiles()[0].removeprefix("file://").removeprefix("file:").rpartition("/")[0]
    assert held.count() == 5 and os.path.exists(path)
    assert stages.clear(spark) == 1 and not os.path.exists(path) and stages.clear(spark) == 0


def test_words_are_kept_in_reading_order_without_a_shuffle_of_words(spark, tmp_path):
    texts = spark.createDataFrame([(i, "\n".join(f"a{n} b c" for n in range(90))) for i in range(30)] + [(None, "x y"), (7, "again")], "doc_id int, text string").repartition(5)
    placed = tables.words_from_text(texts)
    held = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    for n, save in enumerate((lambda *a, **k: tables.save_words(placed, *a, **k), lambda *a, **k: tables.save_text_words(texts, *a, **k))):
        name, path = f"words_{uuid.uuid4().hex}", str(tmp_path / f"words{n}")
        save(name, path, buckets=4)
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == held
        kept = spark.table(name)
        assert rows(kept) == rows(placed) and len(files(path)) == 4
        assert kept.select("doc_id", F.input_file_name().alias("f")).distinct().groupBy("doc_id").count().where("count > 1").isEmpty()
        for f in files(path):
            own = [(r["doc_id"], r["page"], r["top"], r["x0"]) for r in spark.read.parquet(f).coalesce(1).collect() if r["doc_id"] not in (7, None)]
            assert own and own == sorted(own)
        assert rows(structure.visual_lines(kept)) == rows(structure.visual_lines(placed))
