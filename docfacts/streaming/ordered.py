"""Sequential rules over a stream in the order of event time, however its rows are cut into micro-batches.

Rows of a key wait in state, by slots of event time. When the watermark has passed the end of a slot no row of it can
come any more, so its rows go through the rule in their order: first by time, then by the other columns. What comes out
is what the rule gives over the sorted table; rows later than the watermark are dropped by Spark before they get here.
A key holds the slots not yet passed and what the rule carries on. The latter goes when the watermark has passed the
time after which the rule would no longer look at it. A task holds one slot of a key at a time.

The state needs Spark's RocksDB store; where the session has the default store, it is set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Columns of these types are held as they are, others as JSON.
_HELD = (T.StringType, T.BooleanType, T.LongType, T.DoubleType)

#: From the next rows of a key (with a column `_at` in seconds, sorted) and what was carried (None at first): the rows that
#: come out, what is carried on, and the second after which that is void (None: nothing is carried).
Step = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple | None, float | None]]


def _held(df: DataFrame, ts: str) -> tuple[list[Column], dict[str, T.DataType]]:
    """The columns as the state holds them: ts in microseconds first, then the others, whole numbers as longs."""
    cols, kinds = [F.unix_micros(ts).alias(ts)], {ts: T.LongType()}
    for f in df.schema.fields:
        if f.name == ts:
            continue
        c, kind = F.col(f.name), f.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c, kind = c.cast("long"), T.LongType()
        elif isinstance(kind, T.FloatType):
            c, kind = c.cast("double"), T.DoubleType()
        elif isinstance(kind, T.TimestampType):
            c, kind = F.unix_micros(c), T.LongType()
        elif not isinstance(kind, _HELD):
            c, kind = F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")))), T.StringType()
        cols.append(c.alias(f.name))
        kinds[f.name] = kind
    return cols, kinds


def _given(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns as they were before _held."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = F.timestamp_micros(c)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType)):
            c = c.cast(f.dataType)
        elif not isinstance(f.dataType, _HELD):
            c = F.from_json(c, T.StructType([T.StructField("v", f.dataType)]))["v"]
        cols.append(c.alias(f.name))
    return df.select(*cols)


_PLAIN = {T.LongType: int, T.DoubleType: float, T.BooleanType: bool, T.StringType: str}


class Ordered(StatefulProcessor):
    def __init__(self, ts: str, kinds: dict[str, T.DataType], out: list[str], step: Step, carried: str, slot_us: int) -> None:
        self.ts, self.out, self.step, self.carried, self.slot_us = ts, out, step, carried, slot_us
        self.names = list(kinds)
        self.plain = [_PLAIN[type(k)] for k in kinds.values()]
        self.rows = T.StructType([T.StructField(n, k) for n, k in kinds.items()])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", T.StructType([T.StructField("rows", T.ArrayType(self.rows))]))
        self.walked = handle.getValueState("walked", f"{self.carried}, void_us long")
        self.timer = handle.getValueState("timer", "ms long")

    def close(self) -> None:
        pass

    def _tuples(self, frame: pd.DataFrame) -> list[tuple]:
        columns = [[None if x is None or x != x else kind(x) for x in frame[n]] for n, kind in zip(self.names, self.plain, strict=True)]
        return list(zip(*columns, strict=True))

    def _wake(self, ms: int | None) -> None:
        """Have one timer, at ms."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old == ms:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def _end_ms(self, slot: int) -> int:
        return -(-(slot + 1) * self.slot_us // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            number = frame[self.ts] // self.slot_us
            for slot, own in frame.groupby(number, sort=False):
                slot = int(slot)
                held = [tuple(r) for r in self.slots.getValue((slot,))[0]] if self.slots.containsKey((slot,)) else []
                self.slots.updateValue((slot,), (held + self._tuples(own),))
                first = slot if first is None else min(first, slot)
        if first is not None:
            due = self._end_ms(first)
            old = self.timer.get()[0] if self.timer.exists() else None
            self._wake(due if old is None else min(old, due))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()  # Spark has deleted the one that fired
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(int(k[0]) for k in self.slots.keys())
        due = [s for s in waiting if self._end_ms(s) <= now]
        carried = self.walked.get() if self.walked.exists() else None
        carried, void = (tuple(carried[:-1]), carried[-1]) if carried is not None else (None, None)
        for slot in due:
            frame = pd.DataFrame([tuple(r) for r in self.slots.getValue((slot,))[0]], columns=self.names, dtype=object)
            frame = frame.sort_values(self.names, na_position="first", kind="stable", ignore_index=True)
            made, carried, until = self.step(frame.assign(_at=frame[self.ts].astype("int64") / 1e6), carried)
            void = None if until is None else int(until * 1e6) + 1
            self.slots.removeKey((slot,))
            if len(made):
                yield made[self.out]
        if carried is None or void <= now * 1000:
            self.walked.clear()
            void = None
        elif due:
            self.walked.update((*carried, void))
        later = [self._end_ms(s) for s in waiting[len(due) :][:1]] + ([-(-void // 1000)] if void is not None else [])
        self._wake(min(later) if later else None)


def in_order(stream: DataFrame, key: str, ts: str, step: Step, carried: str, watermark: str, out: str | None = None, slot: float = 1.0) -> DataFrame:
    """The stream's rows through `step`, key by key in the order of time. carried: the DDL of what the step carries on;
    out: the DDL of what comes out (the stream's own columns if not given; ts then stays a timestamp); slot: seconds."""
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, ROCKSDB)
    marked = stream.withWatermark(ts, watermark)
    cols, kinds = _held(marked, ts)
    # the watermark belongs to the time column itself, so that comes along beside its microseconds
    held = marked.where(F.col(ts).isNotNull()).select(F.col(ts).alias("_event_time"), *cols)
    schema = T.StructType([T.StructField(n, k) for n, k in kinds.items()]) if out is None else T._parse_datatype_string(out)
    processor = Ordered(ts, kinds, [f.name for f in schema.fields], step, carried, int(slot * 1e6))
    made = held.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")
    return made if out is not None else _given(made, stream.schema)
