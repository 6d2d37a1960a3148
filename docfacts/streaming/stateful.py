"""Small sequential walks, shared by streams and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def accepted(ts: np.ndarray, gap: float, last: float | None) -> tuple[np.ndarray, float | None]:
    """Which of the sorted times (seconds) pass, each at least `gap` after the last that passed; and the last."""
    out, start = np.zeros(len(ts), bool), 0
    if last is not None:
        start = int(np.searchsorted(ts, last + gap, "left"))
    while start < len(ts):
        out[start] = True
        last = float(ts[start])
        start = max(start + 1, int(np.searchsorted(ts, last + gap, "left")))
    return out, last


def walk(df: DataFrame, key: str, order: list[str], step: Callable[[pd.DataFrame, object], tuple[pd.DataFrame, object]], schema) -> DataFrame:
    """Rows of each key in order through `step`, which gets the next rows of a key and what it returned for those before
    (None at first). A task holds one batch at a time, however many rows a key has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for frame in frames:
            if frame.empty:
                continue
            code = pd.factorize(frame[key], use_na_sentinel=False)[0]
            edges = np.flatnonzero(np.diff(code)) + 1
            for a, z in zip([0, *edges], [*edges, len(frame)], strict=True):
                own = frame.iloc[a:z].reset_index(drop=True)
                k = own[key].iloc[0]
                if not begun or not (k == now or (pd.isna(k) and pd.isna(now))):
                    now, state, begun = k, None, True
                out, state = step(own, state)
                yield out

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def seconds(ts: pd.Series) -> np.ndarray:
    return ts.astype("int64").to_numpy() / unit(ts)


def accept_after(df: DataFrame, key: str, ts: str, gap: float) -> DataFrame:
    """Rows that pass, by key, in the order of time and then of the other columns."""

    def step(frame: pd.DataFrame, last: float | None) -> tuple[pd.DataFrame, float | None]:
        ok, last = accepted(seconds(frame[ts]), gap, last)
        return frame[ok], last

    return walk(df, key, [ts, *[c for c in df.columns if c not in (key, ts)]], step, df.schema)


def unit(ts: pd.Series) -> float:
    """Ticks of a time column in a second."""
    return {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}[np.datetime_data(ts.dt.tz_localize(None).dtype if ts.dt.tz is not None else ts.dtype)[0]]


def alerts(
    ts: np.ndarray, ok: np.ndarray, gap: float, prev: bool | None = None, last: float | None = None, seen: float | None = None, idle: float | None = None
) -> tuple[list, bool | None, float | None, float | None]:
    """'degraded', 'recovered' or None for each report; a degraded alert at most once in `gap` seconds, and recovery
    clears that timer. Then the last report's verdict, the time of the last degraded alert, and of the last report.
    After more than `idle` seconds without a report a key counts as new."""
    out = []
    for t, good in zip(ts, ok, strict=True):
        said = None
        if idle is not None and seen is not None and t - seen > idle:
            prev, last = None, None
        if not good:
            if last is None or t - last >= gap:
                said, last = "degraded", float(t)
        elif prev is False:
            said, last = "recovered", None
        prev, seen = bool(good), float(t)
        out.append(said)
    return out, prev, last, seen


def health_alerts(reports: DataFrame, gap: float = 900.0, idle: float | None = None) -> DataFrame:
    """Batch twin of the alert stream: key, ts, alert of reports(key, ts, ok); null verdicts don't count."""

    def step(frame: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        said, *after = alerts(seconds(frame["ts"]), frame["ok"].to_numpy(bool), gap, *(state or (None, None, None)), idle=idle)
        out = frame[["key", "ts"]].assign(alert=pd.Series(said, dtype=object))
        return out[out["alert"].notna()], tuple(after)

    kinds = dict(reports.dtypes)
    return walk(reports.select("key", "ts", "ok").where("ok is not null"), "key", ["ts", "ok"], step, f"key {kinds['key']}, ts {kinds['ts']}, alert string")
