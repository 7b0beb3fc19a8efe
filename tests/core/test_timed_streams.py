"""Streams with timers: any division into batches gives the batch result, silence is told, state stays bounded."""

import random
import uuid

import pytest
from gleanery.operators import health
from gleanery.streaming import stateful, timed
from pyspark.sql import functions as F


def run_in_batches(spark, tmp_path, frames, build):
    """Rows of all batches, and the state's rows after each."""
    place = tmp_path / uuid.uuid4().hex
    out, held = [], []
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = build(stateful.file_stream(spark, f"{place}/in", f.schema))
        q = stream.writeStream.outputMode("append").foreachBatch(lambda frame, n: out.extend(frame.collect())).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        held.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))
    return out, held


LEDGER = "source string, at timestamp, count long, status string"


def ledger(spark, seed):
    """Runs at hours; a source that stops, one with gaps, one that fails, one that is empty at times."""
    rng = random.Random(seed)
    rows = []
    for source, end, odds in (("steady", 200, 1), ("stops", 90, 1), ("gaps", 200, 0.3), ("fails", 200, 0.9), ("empty", 200, 1)):
        for hour in range(0, end, 10):
            if rng.random() < odds:
                count = {"empty": rng.choice([0, 5]), "gaps": rng.choice([None, 3, 50])}.get(source, rng.randrange(4, 30))
                rows.append((source, hour, count, "error" if source == "fails" and hour % 30 == 0 else "ok"))
    return [(s, f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", c, x) for s, h, c, x in rows]


@pytest.mark.parametrize("batches", [1, 4])
def test_last_verdicts_equal_the_batch_ones(spark, tmp_path, batches):
    rows = ledger(spark, 5)
    random.Random(1).shuffle(rows)  # inside a batch in any order; batches go by time
    rows.sort(key=lambda r: r[1] > "2024-01-05") if batches > 1 else None
    cut = [r for r in rows if r[1] <= "2024-01-05"], [r for r in rows if r[1] > "2024-01-05"]
    parts = [rows] if batches == 1 else [*cut, [], []]
    clock = (None, "2024-01-09 12:00:00", None, "ok")
    parts[-1] = [*parts[-1], clock]
    frames = [spark.createDataFrame(p or [clock], "source string, at string, count long, status string").withColumn("at", F.col("at").cast("timestamp")).select("source", "at", "count", "status") for p in parts]
    told, _ = run_in_batches(spark, tmp_path, frames, lambda s: timed.health_stream(s, expect_hours=20, delay="0 seconds"))
    last = {}
    for r in sorted(told, key=lambda r: r["at"]):
        last[r["source"]] = (r["verdict"], r["history"], r["median"], r["count"])
    batch = spark.createDataFrame(rows, "source string, at string, count long, status string").withColumn("at", F.col("at").cast("timestamp"))
    registry = batch.select("source").distinct().select("source", F.lit(20.0).alias("expect_interval_h"), F.lit(False).alias("allow_empty"), F.lit("2024-01-01").cast("timestamp").alias("registered_at"))
    want = {r["source"]: (r["verdict"], r["history"], r["median"], r["count"]) for r in health.verdicts(batch, registry, F.lit(clock[1]).cast("timestamp")).collect()}
    assert last == want and last["stops"][0] == "stale"


def test_silence_return_and_registration(spark, tmp_path):
    def frame(*rows):
        return spark.createDataFrame(rows, "source string, at string, count long, status string").withColumn("at", F.col("at").cast("timestamp")).select("source", "at", "count", "status")

    frames = [
        frame(("new", "2024-01-01 00:00:00", None, "registered"), ("a", "2024-01-01 00:00:00", 5, "ok"), ("b", "2024-01-01 01:00:00", 5, "error")),
        frame((None, "2024-01-01 06:00:00", None, "ok")),
        frame(("a", "2024-01-01 07:00:00", 5, "ok"), ("old", "2023-12-31 00:00:00", 5, "ok")),
        frame((None, "2024-01-03 00:00:00", None, "ok")),
        frame(("a", "2024-01-04 00:00:00", 5, "ok"), (None, "2024-01-05 00:00:00", None, "ok")),
    ]
    told, held = run_in_batches(spark, tmp_path, frames, lambda s: timed.health_stream(s, expect_hours=2, keep_hours=24, delay="0 seconds"))
    got = [(r["source"], str(r["at"])[5:13], r["verdict"]) for r in sorted(told, key=lambda r: (r["source"], r["at"]))]
    assert got == [
        ("a", "01-01 00", "no_baseline"), ("a", "01-01 04", "stale"), ("a", "01-01 07", "ok"), ("a", "01-01 11", "stale"), ("a", "01-04 00", "no_baseline"), ("a", "01-04 04", "stale"),
        ("b", "01-01 01", "failing"), ("new", "01-01 00", "no_baseline"), ("new", "01-01 04", "no_record"),
    ]
    with pytest.raises(ValueError):
        timed.health_stream(spark.readStream.schema(LEDGER).parquet(str(tmp_path)), expect_hours=2, keep_hours=4)


def test_first_seen_is_bounded_over_many_batches(spark, tmp_path):
    """A fresh hundred keys an hour, each again 30 minutes later and three hours later; keys are kept for an hour."""
    def frame(hour):
        t = F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour))
        fresh = spark.range(100).select((F.col("id") + 1000 * hour).alias("k"), t.alias("ts"))
        soon = spark.range(100).select((F.col("id") + 1000 * hour).alias("k"), (t + F.expr("interval 30 minutes")).alias("ts"))
        back = spark.range(100).select((F.col("id") + 1000 * (hour - 3)).alias("k"), (t + F.expr("interval 40 minutes")).alias("ts"))
        return fresh.unionByName(soon).unionByName(back) if hour >= 3 else fresh.unionByName(soon)

    frames = [frame(h) for h in range(8)]
    frames.append(spark.createDataFrame([(-1, 1_700_000_000 + 3600 * 20)], "k long, s long").select("k", F.timestamp_seconds("s").alias("ts")))
    got, held = run_in_batches(spark, tmp_path, frames, lambda s: timed.first_seen_stream(s, ["k"], keep_hours=1, delay="0 seconds"))
    seen = sorted((r["k"], r["ts"]) for r in got if r["k"] >= 0)
    assert len(seen) == len(set(seen)) == 800 + 500  # each key once, and the 500 that came back after a silence
    assert max(held[4:8]) <= 2 * max(held[1:3]) + 300 and held[-1] < 10  # timers and waiting rows count as state too


def test_repeats_that_come_late(spark, tmp_path):
    def frame(*rows):
        return spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))

    frames = [frame(("a", 10_000), ("b", 10_500)), frame(("a", 9_000), ("c", 12_000)), frame(("a", 100), ("b", 30_000)), frame(("z", 90_000))]
    got, _ = run_in_batches(spark, tmp_path, frames, lambda s: timed.first_seen_stream(s, ["k"], keep_hours=1, delay="30 minutes"))
    # a's earlier row comes before the watermark and is the first; the one at 100 is behind it; b comes back after more than an hour
    assert sorted((r["k"], int(r["ts"].timestamp())) for r in got if r["k"] != "z") == [("a", 9_000), ("b", 10_500), ("b", 30_000), ("c", 12_000)]


def test_first_seen_asks_the_state_by_bucket(spark, tmp_path):
    """Keys that are null or hold signs, to the microsecond; the state's rows do not grow with the keys."""
    t, keep = 1_700_000_000_000_000, 3_600_000_000
    rows = [("a,\"b", None, t), ("a,\"b", None, t + keep), (None, None, t), (None, 2**62 + 1, t), (None, 2**62 + 1, t + keep + 1), (None, 2**62 + 3, t), ("", 0, t), (None, None, t + keep)]
    many = spark.range(3000).select(F.lit("many").alias("k"), F.col("id").alias("n"), F.timestamp_micros(F.lit(t)).alias("ts"))
    frames = [spark.createDataFrame(rows, "k string, n long, us long").select("k", "n", F.timestamp_micros("us").alias("ts")).unionByName(many)]
    frames.append(spark.createDataFrame([("clock", 0, t + keep + 10**6)], "k string, n long, us long").select("k", "n", F.timestamp_micros("us").alias("ts")))
    got, held = run_in_batches(spark, tmp_path, frames, lambda s: timed.first_seen_stream(s, ["k", "n"], keep_hours=1, delay="0 seconds"))
    seen = sorted((str(r["k"]), str(r["n"]), int(r["ts"].timestamp()) - t // 10**6, r["ts"].microsecond) for r in got if r["k"] not in ("many", "clock"))
    assert seen == [("", "0", 0, 0), ("None", str(2**62 + 1), 0, 0), ("None", str(2**62 + 1), 3600, 1), ("None", str(2**62 + 3), 0, 0), ("None", "None", 0, 0), ('a,"b', "None", 0, 0)]
    assert sum(r["k"] == "many" for r in got) == 3000 and max(held) < 1000
