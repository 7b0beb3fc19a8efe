"""Events of streaming queries as a table: starts, the progress of each batch, ends.

A ``Log`` is a query listener. Events are held and appended as Parquet, ``every`` of them at a time and when a query ends, so they outlive
the queries and can be counted, joined and watched like any table. A batch that runs again after a failure is told of again, under a new run.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = (
    "kind string, query string, run string, name string, at string, batch long, rows_in long, rows_out long, state_rows long, late_rows long, millis long, watermark string, error string"
)


class Log(StreamingQueryListener):
    def __init__(self, spark: SparkSession, path: str, every: int = 50):
        self.spark, self.path, self.every = spark, path, every
        self.held: list[tuple] = []
        self.lock = threading.Lock()

    def _take(self, row: tuple, now: bool = False) -> None:
        with self.lock:
            self.held.append(row)
            if now or len(self.held) >= self.every:
                rows, self.held = self.held, []
                self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        self._take(("started", str(event.id), str(event.runId), event.name, event.timestamp, *[None] * 8))

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        state = p.get("stateOperators") or []
        rows_out = (p.get("sink") or {}).get("numOutputRows", -1)
        self._take((
            "progress", p["id"], p["runId"], p.get("name"), p["timestamp"], p["batchId"], sum(s.get("numInputRows", 0) for s in p["sources"]), None if rows_out < 0 else rows_out,
            sum(s.get("numRowsTotal", 0) for s in state), sum(s.get("numRowsDroppedByWatermark", 0) for s in state), p.get("batchDuration"), (p.get("eventTime") or {}).get("watermark"), None,
        ))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._take(("ended", str(event.id), str(event.runId), None, None, *[None] * 7, event.exception), now=True)

    def __enter__(self) -> Log:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)
        with self.lock:
            rows, self.held = self.held, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)
