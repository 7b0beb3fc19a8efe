"""Streams whose keys are judged in event-time order and by silence, with ``transformWithStateInPandas``.

Rows of a key wait in its state until the watermark has passed them and are then taken in order, so the result does not depend on
how rows fall into batches. A key has deadlines too: timers at which it is told of, or forgotten, if nothing came. State therefore is what waits
within the watermark's delay and one row for each key that was seen within the time to live (first sightings pack those of many keys). Rows that come later than the watermark are dropped, as
Spark does for all state. Sessions need the RocksDB state store (``rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

HOUR = 3_600_000


def rocksdb(spark: SparkSession) -> None:
    """The state store that timers and lists in state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Rows of a key in order, and deadlines between them. Subclasses say what a row and a deadline do to the key's state.

    ``take(key, state, ms, row)`` and ``silent(key, state)`` return the new state (a tuple; None: forgotten) and rows; ``deadline(state)`` gives
    milliseconds or None. State has ``kept``'s fields, rows ``waiting``'s, of which the first is the event time.
    """

    kept: str

    def __init__(self, waiting: T.StructType, out: T.StructType):
        self.waiting, self.out = waiting, out

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", self.kept)
        self.rows = handle.getListState("rows", self.waiting)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for f in rows for r in f[self.waiting.names].astype(object).where(f[self.waiting.names].notna(), None).itertuples(index=False)]
        new = [r for r in new if r[0] is not None]
        if new:
            self.rows.appendList([(r[0].to_pydatetime(), *r[1:]) for r in new])
        yield self._advance(key, timerValues, min((_ms(r[0]) for r in new), default=None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues, None)

    def close(self) -> None:
        pass

    def _advance(self, key, timer_values, first: int | None) -> pd.DataFrame:
        """Take what the watermark has passed, and set the next timer. Nothing is read while the first row that came has to wait."""
        upto = timer_values.getCurrentWatermarkInMs()
        out: list[tuple] = []
        if first is not None and first >= upto and not self._due(upto):
            self.handle.registerTimer(first + 1)
            return self._frame(out)
        waiting = sorted(((pd.Timestamp(r[0]), r) for r in self.rows.get()), key=lambda x: (x[0], str(x[1])))
        ready = [(t, r) for t, r in waiting if _ms(t) < upto]
        rest = [r for t, r in waiting if _ms(t) >= upto]
        state = self.state.get() if self.state.exists() else None
        for t, r in [*ready, (None, None)]:
            at = upto if t is None else _ms(t)
            while state is not None and (due := self.deadline(state)) is not None and due < at:
                state, rows = self.silent(key, state)
                out += rows
            if r is not None:
                state, rows = self.take(key, state, at, r)
                out += rows
        if ready:
            self.rows.put(rest) if rest else self.rows.clear()
        if state is not None:
            self.state.update(state)
        elif self.state.exists():
            self.state.clear()
        due = None if state is None else self.deadline(state)
        times = ([_ms(pd.Timestamp(r[0])) for r in rest] if rest else []) + ([due] if due is not None else [])
        if times:
            self.handle.registerTimer(max(min(times), upto) + 1)
        return self._frame(out)

    def _due(self, upto: int) -> bool:
        due = self.deadline(self.state.get()) if self.state.exists() else None
        return due is not None and due < upto

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=self.out.names)
        for f in self.out:
            if isinstance(f.dataType, T.TimestampType):
                frame[f.name] = pd.to_datetime(frame[f.name])
            elif isinstance(f.dataType, T.LongType):
                frame[f.name] = frame[f.name].astype("Int64")
            elif isinstance(f.dataType, T.DoubleType):
                frame[f.name] = frame[f.name].astype("float64")
        return frame


def _ms(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


def judge_run(counts: list[float], bad_before: int, runs_before: int, status: str | None, count: float | None, allow_empty: bool, drop: float, spike: float) -> str:
    """The verdict on a run as ``health.verdicts`` gives it, but for silence."""
    bad = status is not None and status != "ok"
    middle = median(counts) if counts else 0
    if bad or bad_before + bad >= 3:
        return "failing"
    if count is None:
        return "no_count" if runs_before else "no_baseline"
    if count == 0 and not allow_empty:
        return "empty_suspicious"
    if middle > 0 and count < drop * middle and count != 0:
        return "volume_drop"
    if middle > 0 and count > spike * middle:
        return "volume_spike"
    return "ok" if counts else "no_baseline"


class Health(InOrder):
    """A verdict for each run of a source; ``stale`` when it falls silent, ``no_record`` if it was registered and never ran."""

    kept = "last long, told boolean, runs long, bad array<boolean>, counts array<double>, verdict string, history long, middle double, count double"

    def __init__(self, waiting, out, expect_hours, allow_empty, window, drop, spike, keep_hours):
        super().__init__(waiting, out)
        self.expect, self.allow_empty, self.window, self.drop, self.spike, self.keep = expect_hours, allow_empty, window, drop, spike, keep_hours

    def take(self, key, state, ms, row):
        at, count, status = row
        if status == "registered":
            if state is None:
                state = (ms, False, 0, [], [], "no_baseline", 0, None, None)
                return state, [(key[0], at, "no_baseline", 0, None, None)]
            return state, []
        _, _, runs, bad, counts, *_ = state or (ms, False, 0, [], [], None, 0, None, None)
        bad, counts = list(bad), [float(c) for c in counts]
        verdict = judge_run(counts, sum(bad[-2:]), runs, status, count, self.allow_empty, self.drop, self.spike)
        history, middle = len(counts), float(median(counts)) if counts else None
        if status == "ok" and count is not None:
            counts = [*counts, float(count)][-self.window :]
        bad = [*bad, status is not None and status != "ok"][-2:]
        state = (ms, False, runs + 1, bad, counts, verdict, history, middle, None if count is None else float(count))
        return state, [(key[0], at, verdict, history, middle, state[-1])]

    def deadline(self, state):
        last, told = state[:2]
        return last + int((self.keep if told else 2 * self.expect) * HOUR)

    def silent(self, key, state):
        last, told, runs, bad, counts, verdict, history, middle, count = state
        if told:
            return None, []
        state = (last, True, *state[2:])
        if verdict == "failing":
            return state, []
        return state, [(key[0], pd.Timestamp(last + int(2 * self.expect * HOUR), unit="ms"), "stale" if runs else "no_record", history, middle, count)]


def health_stream(
    ledger: DataFrame, expect_hours: float, allow_empty: bool = False, window: int = 20, drop: float = 0.5, spike: float = 2.0, keep_hours: float = 24 * 366, delay: str = "1 hour"
) -> DataFrame:
    """Verdicts (source, at, verdict, history, median, count) from a stream of runs (source, at, count, status), as they become final.

    A row with status ``registered`` announces a source. A source is stale two intervals after its last run and forgotten ``keep_hours`` after it
    (more than two intervals); it then begins anew. Rows without a source only move the watermark.
    """
    rocksdb(ledger.sparkSession)
    if keep_hours <= 2 * expect_hours:
        raise ValueError("keep_hours has to be more than two intervals")
    runs = ledger.select(F.col("source").cast("string"), F.col("at").cast("timestamp"), F.col("count").cast("double"), F.col("status").cast("string")).withWatermark("at", delay)
    out = T.StructType.fromDDL("source string, at timestamp, verdict string, history long, median double, count double")
    waiting = T.StructType.fromDDL("at timestamp, count double, status string")
    told = runs.groupBy("source").transformWithStateInPandas(Health(waiting, out, expect_hours, allow_empty, window, drop, spike, keep_hours), out, "Append", "EventTime")
    return told.where("source is not null")


class FirstSeen(StatefulProcessor):
    """Sightings of a bucket of keys at a time: one state a bucket, its keys' last sightings and the rows that wait as packed columns.

    A call to the state costs a round trip to the JVM, so it is paid for each bucket and not for each key; what a batch brings is sorted as a whole.
    """

    SCHEMA = pa.schema([("key", pa.string()), ("us", pa.int64())])

    def __init__(self, keep_ms: int):
        self.keep = keep_ms * 1000

    def init(self, handle):
        self.handle = handle
        self.known = handle.getValueState("known", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self._advance(timerValues, pd.concat([f[self.SCHEMA.names] for f in rows]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(timerValues, self._rows(None))

    def close(self) -> None:
        pass

    def _advance(self, timer_values, new: pd.DataFrame) -> pd.DataFrame:
        """Take what the watermark has passed, forget whose time is over, and set the next timer."""
        upto_ms = timer_values.getCurrentWatermarkInMs()
        upto = upto_ms * 1000
        chunks = [r[0] for r in self.waiting.get()]
        if len(new):
            rows = pd.concat([*map(self._rows, chunks), new])
        else:
            rows = pd.concat([self._rows(None), *map(self._rows, chunks)])
        known = self._rows(self.known.get()[0] if self.known.exists() else None)
        rest = rows[rows["us"] >= upto]
        told, left = self._told(known, rows[rows["us"] < upto])
        left = left[left["us"] + self.keep >= upto]
        if len(rest) == len(chunks) == 0:
            pass
        elif len(rest) == len(rows) and len(new):
            self.waiting.appendList([(self._packed(new),)])
        elif len(rest):
            self.waiting.put([(self._packed(rest),)])
        else:
            self.waiting.clear()
        if len(left):
            self.known.update((self._packed(left),))
        elif len(known):
            self.known.clear()
        times = [*([rest["us"].min()] if len(rest) else []), *([left["us"].min() + self.keep] if len(left) else [])]
        if times:
            self.handle.registerTimer(max(int(min(times)) // 1000, upto_ms) + 1)
        return told

    def _told(self, known: pd.DataFrame, ready: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The rows that are first sightings, and the last sighting of each key."""
        if not len(ready):
            return ready, known
        rows = pd.concat([known, ready], ignore_index=True)
        old = np.arange(len(rows)) < len(known)
        group, us = pd.factorize(rows["key"])[0], rows["us"].to_numpy()
        order = np.lexsort((~old, us, group))
        old, group, us = old[order], group[order], us[order]
        change = np.r_[True, group[1:] != group[:-1], True]
        first = change[:-1] | (np.diff(us, prepend=us[0]) > self.keep)
        return rows.iloc[order[first & ~old]], rows.iloc[order[change[1:]]]

    def _packed(self, rows: pd.DataFrame) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.SCHEMA) as out:
            out.write_table(pa.Table.from_pandas(rows[self.SCHEMA.names], self.SCHEMA, preserve_index=False))
        return sink.getvalue().to_pybytes()

    def _rows(self, packed) -> pd.DataFrame:
        return (self.SCHEMA.empty_table() if packed is None else pa.ipc.open_stream(bytes(packed)).read_all()).to_pandas()


def _as_text(df: DataFrame, key: str) -> Column:
    """A key as text that casts back to it; keys that are equal to Spark have the same."""
    kind = df.schema[key].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (F.col(key) + F.lit(0).cast(kind)).cast("string")
    return F.base64(key) if isinstance(kind, T.BinaryType) else F.col(key).cast("string")


def first_seen_stream(df: DataFrame, keys: list[str], ts: str = "ts", keep_hours: float = 24, delay: str = "1 hour", buckets: int = 64) -> DataFrame:
    """(keys, ts): rows whose key was not seen in the ``keep_hours`` before them; every sighting counts, also one that is left out.

    A repeat that comes late, but before the watermark, is taken in its place; one behind it is dropped. A key is kept for ``keep_hours`` after its last sighting.
    Keys are of plain types. They lie in ``buckets`` by their hash; what a bucket holds (its keys of the last ``keep_hours``, and waiting rows) must fit into a task.
    """
    rocksdb(df.sparkSession)
    if any(isinstance(df.schema[k].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for k in keys):
        raise ValueError("keys have to be of plain types")
    rows = df.select(F.to_json(F.array(*[_as_text(df, k) for k in keys])).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    rows = rows.where("ts is not null").withColumn("us", F.unix_micros("ts")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).withWatermark("ts", delay)
    out = T.StructType.fromDDL("key string, us long")
    told = rows.groupBy("bucket").transformWithStateInPandas(FirstSeen(int(keep_hours * HOUR)), out, "Append", "EventTime")
    parts = F.from_json("key", "array<string>")
    texts = [F.unbase64(F.get(parts, i)) if isinstance(df.schema[k].dataType, T.BinaryType) else F.get(parts, i).cast(df.schema[k].dataType) for i, k in enumerate(keys)]
    return told.select(*[t.alias(k) for t, k in zip(texts, keys)], F.timestamp_micros("us").alias(ts))
