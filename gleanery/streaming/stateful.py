"""Streams: deduplication, windows, admission control and adaptive intervals with Structured Streaming state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanery.session import shared_folder


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event times as TIMESTAMP, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def dedup_stream(df: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row of each key; state older than the watermark goes."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(df: DataFrame, keys: list[str], ts: str = "ts", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts by window and keys; windows behind the watermark are final."""
    w = event_time(df, ts).withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(df: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    w = event_time(df, ts).withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def admit(times: list[float], costs: list[int], held: list[tuple[float, int]], limit: int, window: int) -> tuple[list[bool], list[tuple[float, int]]]:
    """Admission in order: an event passes if what passed in the last ``window`` seconds and its cost stay within the limit."""
    out, used, start = [], sum(c for _, c in held), 0
    for t, cost in zip(times, costs):
        while start < len(held) and held[start][0] <= t - window:
            used -= held[start][1]
            start += 1
        ok = used + cost <= limit
        if ok:
            held.append((t, cost))
            used += cost
        out.append(ok)
    return out, held[start:]


def admission(df: DataFrame, key: str, order: list[str], seconds: str, limit: int, window: int) -> DataFrame:
    """Batch form: each key's events in order, with ``admitted``. Denied events use nothing, so this is a fold, not a window.

    The events of one key run through one task in order, batch by batch; only what a window admits is held.
    """
    schema = df.schema.add("admitted", "boolean")
    names = schema.names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        last = None
        for f in frames:
            out = []
            for k, g in f.groupby(key, sort=False, dropna=False):
                if k != last:
                    held = {k: []}  # rows are sorted by key: an earlier key is done
                    last = k
                ok, held[k] = admit(g[seconds].tolist(), [1] * len(g), held[k], limit, window)
                out.append(g.assign(admitted=ok))
            if out:
                yield pd.concat(out)[names]

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def admission_stream(df: DataFrame, key: str, seconds: str, limit: int, window: int) -> DataFrame:
    """Streaming form over (key, seconds): counts of admitted and denied events by key and batch."""

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        times = sorted(t for f in frames for t in f[seconds].tolist())
        ok, held = admit(times, [1] * len(times), held, limit, window)
        state.update(([t for t, _ in held], [c for _, c in held]))
        yield pd.DataFrame({key: [k[0]], "admitted": [sum(ok)], "denied": [len(ok) - sum(ok)]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, admitted bigint, denied bigint", "times array<double>, costs array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def next_interval(state: tuple[float, int, int], kind: str, base: float, cap: float) -> tuple[float, int, int]:
    """Doubled on a block, halved toward the base after three ok, half as much again after three slow."""
    interval, ok, slow = state
    if kind == "blocked":
        return min(interval * 2, base * cap), 0, 0
    if kind == "slow":
        return (min(interval * 1.5, base * cap), 0, 0) if slow + 1 >= 3 else (interval, 0, slow + 1)
    return (max(interval / 2, base), 0, 0) if ok + 1 >= 3 else (interval, ok + 1, 0)


def adaptive_interval_stream(df: DataFrame, key: str, order: str, kind: str, base: float = 1.0, cap: float = 8.0) -> DataFrame:
    """The interval of each key after each batch."""

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (base, 0, 0)
        rows = sorted((o, x) for f in frames for o, x in zip(f[order], f[kind]))
        for _, x in rows:
            now = next_interval(now, x, base, cap)
        state.update(now)
        yield pd.DataFrame({key: [k[0]], "interval": [now[0]]})

    t = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(run, f"{key} {t}, interval double", "interval double, ok bigint, slow bigint", "append", GroupStateTimeout.NoTimeout)


def file_stream(spark, path: str, schema, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """An append log of files; which were read is in the query's checkpoint."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_trigger).load(path)


def replayed(df: DataFrame, at: str, files: int) -> DataFrame:
    """A table as a stream: written by ranges of ``at`` into files of the shared folder, which come one a batch in that order."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    df.repartitionByRange(files, at).write.parquet(place)
    files_at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    store = files_at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in store.listStatus(files_at):
        name = f.getPath().getName()
        if name.startswith("part-"):  # files come in the order of their time stamps
            store.setTimes(f.getPath(), 1_700_000_000_000 + 1000 * int(name.split("-")[1]), -1)
    return file_stream(spark, place, df.schema, files_per_trigger=1)


def write_many(df: DataFrame, sinks: list, checkpoint: str, **options):
    """Each batch into every sink (functions of (frame, batch id)); a sink that fails does not keep the others from theirs, then the batch fails."""

    def each(frame, number):
        frame.persist()
        wrong = []
        for sink in sinks:
            try:
                sink(frame, number)
            except Exception as e:  # noqa: BLE001  told below
                wrong.append(f"{getattr(sink, '__name__', sink)}: {e}")
        frame.unpersist()
        if wrong:
            raise RuntimeError("; ".join(wrong))

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_now(stream: DataFrame, mode: str = "append", name: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and return its result as a table in the shared folder.

    Each batch is written under its own number, so a batch that runs again replaces itself; in complete mode
    the last one holds the whole result.
    """
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(frame, number):
        frame.write.mode("overwrite").parquet(f"{place}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    writer = stream.writeStream.queryName(name) if name else stream.writeStream
    query = writer.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out/*").select(*stream.columns)
