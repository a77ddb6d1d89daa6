"""Folds of a stream in the order of its events, however its rows arrive.

Rows wait in a keyed state until the watermark says that nothing older comes any more; then they are folded in the order of time and sequence, and the fold's value goes on to the next ones. So the result is that of
a fold over the whole ordered table, whichever way the stream was shuffled and cut into batches. Rows that come later than the watermark allows are left out; the query's progress counts them (``late_rows``).

Keys are dealt to buckets by a hash. A bucket holds its rows that are still open as tables, one for what a batch brings, so that a row costs no call to the state; a timer for the first open time wakes the bucket, which then folds all
that is due. The fold's value is held by key. What is held is bounded by what arrives within the delay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StructField, StructType, TimestampType

#: Keyed state with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets that keys are dealt to; the open rows of one are folded by one task at a time. Rows of a table that is held or given back.
BUCKETS, ROWS = 1024, 10_000

#: (state, row) to (state, result); each a tuple.
Step = Callable[[tuple, tuple], tuple[tuple, tuple]]


class _Fold(StatefulProcessor):
    def __init__(self, step: Step, start: tuple, state: StructType, rows: StructType, out: list[str]):
        """rows: the key, its time in milliseconds, and what the step gets."""
        self.step, self.start, self.state_type, self.row_type, self.out = step, start, state, rows, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", StructType([self.row_type["key"]]), self.state_type)
        self.open = handle.getListState("open", StructType([StructField("rows", BinaryType())]))
        self.timer = handle.getValueState("timer", StructType([StructField("at", LongType())]))
        # (times without a zone, as pandas has them)
        self.schema = pa.schema([(f.name, pa.timestamp("us") if isinstance(f.dataType, TimestampType) else to_arrow_type(f.dataType)) for f in self.row_type])

    def _wake(self, at: int) -> None:
        """At this time, if no earlier one is set."""
        had = self.timer.get()[0] if self.timer.exists() else None
        if had is None or at < had:
            if had is not None:
                self.handle.deleteTimer(had)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            table = pa.table([pa.Array.from_pandas(frame[f.name], type=f.type) for f in self.schema], schema=self.schema)
            self.open.appendValue((_packed(table),))
            least = pc.min(table["ms"]).as_py()
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        if not self.timer.exists() or self.timer.get()[0] > upto:
            return
        self.timer.clear()
        due: dict[object, list[tuple]] = {}
        rest = []
        for (packed,) in self.open.get():
            table = pa.ipc.open_stream(packed).read_all()
            now = pc.less_equal(table["ms"], upto)
            of = table.filter(now)
            for one, *row in zip(*(c.to_pylist() for c in of.columns), strict=True):
                due.setdefault(one, []).append(row)
            if of.num_rows < table.num_rows:
                rest.append(table.filter(pc.invert(now)))
        self.open.clear()
        if rest:
            left = pa.concat_tables(rest).combine_chunks()
            for lo in range(0, left.num_rows, ROWS):
                self.open.appendValue((_packed(left.slice(lo, ROWS)),))
            self._wake(pc.min(left["ms"]).as_py())
        out = []
        for one, rows in due.items():
            had = self.values.getValue((one,))
            state = self.start if had is None else tuple(had)
            for _, *row in sorted(rows, key=lambda r: (r[0], r[1])):
                state, result = self.step(state, tuple(row))
                out.append((one, *result))
            self.values.updateValue((one,), state)
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=self.out)
                out = []
        yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def _packed(table: pa.Table) -> bytes:
    """A table as bytes that don't carry more than its own rows."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def fold(stream: DataFrame, key: str, at: str, order: str, fields: list[str], step: Step, start: tuple, state: str, out: str, delay: str) -> DataFrame:
    """key and ``out`` for each row of a stream, folded for each key by ``at`` (to the millisecond) and then ``order``.

    ``step`` gets the state, at first ``start``, and a row's (order, *fields), and gives the next state and the row's result. Rows whose key, time or order is NULL are left out; times must lie between the years 1678 and 2261. A row that is repeated is folded again. Keys are of a simple type. ``delay`` is how far
    a row may lag behind the latest one that has arrived.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # (the processor gets its rows under names of its own, as not all names reach it unchanged)
    given = [order, *fields]
    rows = StructType([StructField("key", stream.schema[key].dataType), StructField("ms", LongType()), *(StructField(f"f{i}", stream.schema[f].dataType) for i, f in enumerate(given))])
    shape = f"`{key}` {stream.schema[key].dataType.simpleString()}, {out}"
    names = StructType.fromDDL(shape).names
    known = stream.filter(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(order).isNotNull())
    timed = known.withWatermark(at, delay).select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col(key).alias("key"), F.col(at).alias("at"), F.unix_millis(at).alias("ms"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(given)))
    processor = _Fold(step, start, StructType.fromDDL(state), rows, names)
    return timed.groupBy("bucket").transformWithStateInPandas(processor, StructType.fromDDL(shape), "Append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """How many rows came too late, in the batches whose progress the query still has."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
