"""Streams against their batch twins, driven from files to the end."""

import datetime as dt

import numpy as np
import pytest

from docfacts.operators import log
from docfacts.streaming import stateful, updates

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def run(spark, df, tmp_path, make, name, files=3, order=None):
    """Write df as files in time order (or in the given order of its rows), stream them one by one, and collect what
    comes out."""
    path = str(tmp_path / name)
    rows = df.orderBy("ts" if "ts" in df.columns else "created_at").collect()
    rows = rows if order is None else [rows[k] for k in order]
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name).collect()


def late(n, reach, seed):
    """An order of n rows in which each is at most `reach` places late."""
    rng = np.random.default_rng(seed)
    return np.argsort(np.arange(n) + rng.uniform(0, reach, n), kind="stable").tolist()


def carried(spark, tmp_path, name, var="walked"):
    """Keys of what the stream's state holds."""
    state = spark.read.format("statestore").option("stateVarName", var).load(str(tmp_path / f"{name}-ck"))
    return {r["key"][0] for r in state.select("key").collect()}


def test_accepted_is_greedy():
    rng = np.random.default_rng(1)
    for _ in range(50):
        ts = np.sort(rng.integers(0, 50, 20)).astype(float)
        want, last = [], None
        for t in ts:
            ok = last is None or t - last >= 5
            want.append(ok)
            last = t if ok else last
        got, end = stateful.accepted(ts, 5, None)
        assert got.tolist() == want and end == last
        half, mid = stateful.accepted(ts[:9], 5, None)
        rest, _ = stateful.accepted(ts[9:], 5, mid)
        assert [*half, *rest] == want


def test_alert_rules():
    times, ok = np.array([0, 100, 901, 950, 960, 970]), np.array([False, False, False, True, True, False])
    said, prev, last, seen = stateful.alerts(times, ok, 900)
    assert said == ["degraded", None, "degraded", "recovered", None, "degraded"] and prev is False and last == seen == 970
    said, *_ = stateful.alerts(times[:3], ok[:3], 900, idle=99)
    assert said == ["degraded", "degraded", "degraded"]  # after 100 and 801 silent seconds the key counts as new


CUTS = [1, 3, 20]
#: A row of a key of its own, so late that the watermark passes all others and what they leave behind.
END = 10**8


@pytest.mark.parametrize("files", CUTS)
def test_throttle_stream_equals_batch(spark, tmp_path, files):
    rows = [(f"c{i % 3}", at(i * 0.3), i, float(i) if i % 5 else None, dt.date(2024, 1, 1 + i % 9)) for i in range(200)]
    rows += [(f"c{i % 3}", at(i * 0.3), -i, None, None) for i in range(0, 200, 7)]  # ties in time
    df = spark.createDataFrame([*rows, ("end", at(END), 10**6, None, None)], "chat string, ts timestamp, n int, x double, day date")
    batch = {tuple(r) for r in log.throttle(df, 1.5).collect() if r["chat"] != "end"}
    name = f"throttle{files}"
    order = [*late(len(rows), 30, files), len(rows)]
    got = [tuple(r) for r in run(spark, df, tmp_path, lambda s: updates.throttle_stream(s, 1.5, "20 seconds"), name, files, order)]
    assert set(got) == batch and len(got) == len(batch) < 150
    assert not carried(spark, tmp_path, name)


@pytest.mark.parametrize("files", CUTS[:2])
def test_dedup_stream(spark, tmp_path, files):
    rows = [(str(i % 20), at(i * 100), i) for i in range(120)] + [(None, at(61), 961), (None, at(62), 962)]
    df = spark.createDataFrame([*rows, ("end", at(END), 0)], "update_id string, ts timestamp, n long")
    batch = {r["n"] for r in log.dedup_updates(df).collect() if r["update_id"] != "end"}
    assert batch == {*range(20), *range(40, 60), *range(80, 100), 961, 962}
    name = f"dedup{files}"
    got = [r["n"] for r in run(spark, df, tmp_path, lambda s: updates.dedup_stream(s, 3600, "3000 seconds"), name, files, [*late(len(rows), 15, 1), len(rows)])]
    assert set(got) == batch and len(got) == len(batch)
    assert not carried(spark, tmp_path, name)


@pytest.mark.parametrize("files", [1, 20])
def test_context_stream_equals_batch(spark, tmp_path, files):
    rows = [
        ("a", at(0), "save", "DNMM", None, "q1"), ("a", at(10), "read", None, None, None), ("a", at(20), "ask", None, "p1", None), ("a", at(30), "read", None, None, None), ("b", at(31), "read", None, None, None),
        ("a", at(40), "reset", None, None, None), ("a", at(50), "read", None, None, None), ("b", at(60), "save", "DNKN", None, "q2"), ("b", at(659), "read", None, None, None), ("b", at(660), "read", None, None, None),
    ]
    kinds = ("save", "ask", "read", "read", "reset", "read", "save", "read")
    rows += [(f"k{i % 4}", at(700 + 40 * i), kinds[i * 5 % 8], f"D{i % 3}" if i % 4 else None, f"p{i}", f"q{i}") for i in range(80)]
    df = spark.createDataFrame([*rows, ("end", at(END), "read", None, None, None)], "chat string, ts timestamp, kind string, last_icao string, pending string, last_query string")
    batch = sorted(str(r) for r in updates.context_batch(df).collect() if r["chat"] != "end")
    name = f"context{files}"
    got = run(spark, df, tmp_path, lambda s: updates.context_stream(s, watermark="400 seconds"), name, files, [*late(len(rows), 6, 2), len(rows)])
    assert sorted(map(str, got)) == batch
    assert not carried(spark, tmp_path, name)
    met = {(r["chat"], r["ts"]): (r["ctx_last_icao"], r["ctx_pending"]) for r in updates.context_batch(df).collect()}
    assert met[("a", at(10))] == ("DNMM", None) and met[("a", at(30))] == ("DNMM", "p1") and met[("a", at(50))] == (None, None)
    assert met[("b", at(659))] == ("DNKN", None) and met[("b", at(660))] == (None, None)


@pytest.mark.parametrize("files", [1, 20])
def test_alert_stream_equals_batch(spark, tmp_path, files):
    rows = [(f"k{i % 2}", at(i * 120 + (50_000 if i > 70 else 0)), i % 7 in (3, 4)) for i in range(120)] + [("k0", at(5), None)]
    df = spark.createDataFrame([*rows, ("end", at(END), True)], "key string, ts timestamp, ok boolean")
    batch = sorted(map(str, stateful.health_alerts(df, idle=40_000).collect()))
    assert len(batch) > len(stateful.health_alerts(df.where("key = 'k0'")).collect()) > 0
    name = f"alerts{files}"
    got = run(spark, df, tmp_path, lambda s: updates.alert_stream(s, watermark="1200 seconds", idle=40_000), name, files, [*late(len(rows), 8, 3), len(rows)])
    assert sorted(map(str, got)) == batch
    assert not carried(spark, tmp_path, name)


def test_state_is_kept_until_it_is_void(spark, tmp_path):
    df = spark.createDataFrame([("a", at(0), False), ("b", at(1), True), ("end", at(500), True)], "key string, ts timestamp, ok boolean")
    run(spark, df, tmp_path, lambda s: updates.alert_stream(s, idle=1000), "kept", 3)
    assert carried(spark, tmp_path, "kept") == {"a"}  # a key in order needs no state


def test_windows_stream(spark, tmp_path):
    df = spark.createDataFrame([(at(i * 3600), i % 3 == 0, float(i)) for i in range(60)], "created_at timestamp, needs_review boolean, similarity double")
    got = {r["window_start"]: tuple(r)[2:] for r in run(spark, df, tmp_path, updates.log_windows, "windows")}
    want = {r["window_start"]: tuple(r)[2:] for r in updates.log_windows(df).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert updates.log_windows(df, "2 days", "1 day").count() >= 4
