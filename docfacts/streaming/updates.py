"""Structured Streaming jobs over updates, chats and health reports. Time is event time and rows wait for their turn (see
ordered.py), so a stream gives what its batch twin gives over the whole table, however it is cut into micro-batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import in_order
from .stateful import accepted, alerts, seconds, walk

#: Seconds after which a silent key is forgotten by the alert stream.
IDLE = 30 * 86400.0


def _spaced(stream: DataFrame, key: str, gap: float, watermark: str) -> DataFrame:
    """Rows at least `gap` seconds after the last of their key that passed; the state is the time of that one."""

    def step(frame: pd.DataFrame, carried: tuple | None) -> tuple[pd.DataFrame, tuple | None, float | None]:
        ok, last = accepted(frame["_at"].to_numpy(), gap, carried[0] if carried else None)
        return frame[ok], (last,), last + gap

    return in_order(stream, key, "ts", step, "last double", watermark)


def dedup_stream(updates: DataFrame, ttl_seconds: float = 3600, watermark: str = "10 seconds") -> DataFrame:
    """An update id passes once within the ttl, which begins at an update that passes; null ids all pass, without state.
    Stream of log.dedup_updates."""
    known = _spaced(updates.where("update_id is not null"), "update_id", ttl_seconds, watermark)
    return known.unionByName(updates.where("update_id is null"))


def throttle_stream(events: DataFrame, gap: float = 1.5, watermark: str = "10 seconds") -> DataFrame:
    """A chat's events that pass. Stream of log.throttle."""
    return _spaced(events, "chat", gap, watermark)


def context_stream(messages: DataFrame, ttl_seconds: int = 600, watermark: str = "10 seconds") -> DataFrame:
    """messages(chat, ts, kind, last_icao, pending, last_query, ...) with the context each one meets. kind 'save' writes
    the place and query and clears what is pending, 'ask' writes what is pending, 'reset' deletes, 'read' only looks.
    Output: chat, ts, kind, ctx_last_icao, ctx_pending, ctx_last_query. Stream of context_batch."""

    def step(frame: pd.DataFrame, carried: tuple | None) -> tuple[pd.DataFrame, tuple | None, float | None]:
        rows, last = context_walk(frame, frame["_at"].to_numpy(), carried, ttl_seconds)
        return rows, last, None if last is None else last[3] + ttl_seconds

    out = "chat string, ts long, kind string, ctx_last_icao string, ctx_pending string, ctx_last_query string"
    made = in_order(messages.select(*_MESSAGE), "chat", "ts", step, "last_icao string, pending string, last_query string, at double", watermark, out)
    return made.withColumn("ts", F.timestamp_micros("ts"))


_MESSAGE = ["chat", "ts", "kind", "last_icao", "pending", "last_query"]


def context_walk(frame: pd.DataFrame, seconds: np.ndarray, ctx: tuple | None, ttl: float) -> tuple[pd.DataFrame, tuple | None]:
    """What each message of a chat meets, and the context after the last one."""
    none = lambda v: None if pd.isna(v) else v
    met = []
    for t, kind, icao, pending, query in zip(seconds, frame["kind"], frame["last_icao"], frame["pending"], frame["last_query"], strict=True):
        live = ctx if ctx is not None and t < ctx[3] + ttl else None
        met.append(live[:3] if live else (None, None, None))
        if kind == "reset":
            ctx = None
        elif kind == "save":
            ctx = (none(icao), None, none(query), float(t))
        elif kind == "ask":
            ctx = ((live[0] if live else None), none(pending), (live[2] if live else None), float(t))
    rows = frame[["chat", "ts", "kind"]].copy()
    for i, c in enumerate(("ctx_last_icao", "ctx_pending", "ctx_last_query")):
        rows[c] = pd.Series([m[i] for m in met], dtype=object)
    return rows, ctx


def context_batch(messages: DataFrame, ttl_seconds: int = 600) -> DataFrame:
    """Batch twin of context_stream."""

    def step(frame: pd.DataFrame, ctx: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        return context_walk(frame, seconds(frame["ts"]), ctx, ttl_seconds)

    return walk(messages.select(*_MESSAGE), "chat", _MESSAGE[1:], step, "chat string, ts timestamp, kind string, ctx_last_icao string, ctx_pending string, ctx_last_query string")


def alert_stream(reports: DataFrame, gap: float = 900.0, watermark: str = "10 seconds", idle: float = IDLE) -> DataFrame:
    """key, ts, alert of reports(key, ts, ok). A key that is in order has no state; one that is not is forgotten after
    `idle` seconds without a report. Stream of stateful.health_alerts with the same idle."""

    def step(frame: pd.DataFrame, carried: tuple | None) -> tuple[pd.DataFrame, tuple | None, float | None]:
        at = frame["_at"].to_numpy()
        said, *after = alerts(at, frame["ok"].to_numpy(bool), gap, *(carried or (None, None, None)), idle=idle)
        out = frame.assign(alert=pd.Series(said, dtype=object))
        return out[out["alert"].notna()], *((None, None) if after[0] else (tuple(after), float(at[-1]) + idle))

    kind = dict(reports.dtypes)["key"]
    made = in_order(reports.select("key", "ts", "ok").where("ok is not null"), "key", "ts", step, "prev boolean, last double, seen double", watermark, f"key {kind}, ts long, alert string")
    return made.withColumn("ts", F.timestamp_micros("ts"))


def log_windows(log: DataFrame, width: str = "1 day", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """window_start, window_end, queries, review, avg_similarity by event time; late rows count until the watermark
    passes their window. Works on a stream and on a table."""
    span = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    rows = log.withWatermark("created_at", watermark) if log.isStreaming else log
    return rows.groupBy(span.alias("w")).agg(F.count("*").alias("queries"), F.count_if("needs_review").alias("review"), F.round(F.avg("similarity"), 6).alias("avg_similarity")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "queries", "review", "avg_similarity")
