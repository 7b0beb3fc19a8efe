"""Run ledgers and queues: rolling baselines, verdicts, budgets, natural orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import columns as C
from gleanery.session import cut_lineage, salted_join


def recent(ledger: DataFrame, source: str, at: str, n: int) -> DataFrame:
    """The last n rows of each source as one sorted array column ``last`` of (at, *), newest last.

    Each task keeps a bounded array by merging, so a source with most of the rows is no hot spot: rows are
    ranked within salted parts first, and only n of each part meet.
    """
    salted = ledger.withColumn("__salt", F.pmod(F.xxhash64(*ledger.columns), F.lit(64)))
    w = W.partitionBy(source, "__salt").orderBy(F.desc(at))
    few = salted.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    w = W.partitionBy(source).orderBy(F.desc(at))
    return few.drop("__salt").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)


def baseline(ledger: DataFrame, source: str = "source", at: str = "at", count: str = "count", status: str = "status", window: int = 20) -> DataFrame:
    """Median, p10, p90 (picked by index, not interpolated), last and n of the last ``window`` ok counts of each source."""
    ok = ledger.where((F.col(status) == "ok") & F.col(count).isNotNull()).select(source, F.col(at).alias("__at"), F.col(count).cast("double").alias("__c"))
    rows = recent(ok, source, "__at", window).groupBy(source).agg(F.array_sort(F.collect_list("__c")).alias("a"), F.max_by("__c", "__at").alias("last_count"))
    n = F.size("a")
    mid = (F.element_at("a", F.floor((n + 1) / 2).cast("int")) + F.element_at("a", F.ceil((n + 1) / 2).cast("int"))) / 2
    low = F.greatest(F.lit(0), F.floor(n * F.lit(0.1)).cast("int") - 1)
    high = F.least(n - 1, F.floor(n * F.lit(0.9)).cast("int"))
    return rows.select(source, n.cast("bigint").alias("n"), mid.alias("median"), F.element_at("a", low + 1).alias("p10"), F.element_at("a", high + 1).alias("p90"), "last_count")


def verdicts(
    ledger: DataFrame, registry: DataFrame, now: Column, window: int = 20, drop: float = 0.5, spike: float = 2.0
) -> DataFrame:
    """One verdict for each source, its last ledger row being the run to judge and the rows before it the history.

    ``ledger``: source, at, count, status. ``registry``: source, expect_interval_h, allow_empty, registered_at.
    """
    last = ledger.groupBy("source").agg(F.max_by(F.struct("at", "count", "status"), "at").alias("last"), F.count("*").alias("rows"))
    history = salted_join(ledger, last.select("source", F.col("last.at").alias("__last")), "source").where(F.col("at") < F.col("__last"))
    three = recent(ledger.select("source", "at", "status"), "source", "at", 3).groupBy("source").agg(F.sum((F.col("status") != "ok").cast("int")).alias("bad3"))
    base = baseline(history, window=window).select("source", "n", "median")
    out = registry.join(last, "source", "full_outer").join(three, "source", "left").join(base, "source", "left")
    c, empty_ok, median = F.col("last.count"), F.coalesce("allow_empty", F.lit(False)), F.col("median")
    hours = (F.unix_timestamp(now) - F.unix_timestamp(F.col("last.at"))) / 3600
    age = (F.unix_timestamp(now) - F.unix_timestamp("registered_at")) / 3600
    never = F.col("last").isNull()
    verdict = (
        F.when(never & (age > 2 * F.col("expect_interval_h")), "no_record")
        .when(never, "no_baseline")
        .when((F.col("last.status") != "ok") | (F.coalesce("bad3", F.lit(0)) >= 3), "failing")
        .when(hours > 2 * F.col("expect_interval_h"), "stale")
        .when(c.isNull(), F.when(F.col("rows") > 1, "no_count").otherwise("no_baseline"))
        .when((c == 0) & ~empty_ok, "empty_suspicious")
        .when((median > 0) & (c < drop * median) & ~((c == 0) & empty_ok), "volume_drop")
        .when((median > 0) & (c > spike * median), "volume_spike")
        .when(F.coalesce("n", F.lit(0)) == 0, "no_baseline")
        .otherwise("ok")
    )
    return out.select("source", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).cast("bigint").alias("history"), "median", c.alias("count"))


def fail_streaks(ledger: DataFrame, source: str, at: list, status: str, length: int = 3) -> DataFrame:
    """Rows that end a run of ``length`` rows that are not ok."""
    w = W.partitionBy(source).orderBy(*at).rowsBetween(1 - length, 0)
    bad = F.sum((F.col(status) != "ok").cast("int")).over(w)
    return ledger.withColumn("streak", bad == length)


def staleness(ledger: DataFrame, source: str, at: str, now: Column, expect_hours: float) -> DataFrame:
    last = ledger.groupBy(source).agg(F.max(at).alias("last_at"))
    return last.select(source, "last_at", (F.unix_timestamp(now) - F.unix_timestamp("last_at") > 2 * expect_hours * 3600).alias("stale"))


def window_usage(events: DataFrame, key: str, seconds: Column, window: int) -> DataFrame:
    """Events of the key in the last ``window`` seconds up to each row, and seconds until the oldest leaves."""
    w = W.partitionBy(key).orderBy("__s").rangeBetween(1 - window, 0)
    e = events.withColumn("__s", seconds.cast("bigint"))
    return e.withColumn("used", F.count("*").over(w)).withColumn("reset_in", F.min("__s").over(w) + window - F.col("__s")).drop("__s")


def short_page_streaks(pages: DataFrame, group: list[str], order: list, length: Column, short: int) -> DataFrame:
    """Runs of equally long short pages (gaps and islands): length, pages."""
    w = W.partitionBy(*group).orderBy(*order)
    p = pages.withColumn("__len", length).withColumn("__new", (~F.col("__len").eqNullSafe(F.lag("__len").over(w))).cast("int"))
    runs = p.withColumn("run", F.sum("__new").over(w)).groupBy(*group, "run").agg(F.min("__len").alias("length"), F.count("*").alias("n_pages"))
    return runs.where(F.col("length") < short)


def adaptive_interval(events: DataFrame, key: str, order: str, kind: str, base: float = 1.0, cap: float = 8.0) -> DataFrame:
    """Fold of a host's outcomes: doubled on a block (up to ``cap`` times base), halved after three ok, x1.5 after three slow.

    A host's outcomes are folded in order; the array of one host must fit into a task.
    """
    start = F.struct(F.lit(base).alias("interval"), F.lit(0).alias("ok"), F.lit(0).alias("slow"))

    def step(s, x):
        k = x["k"]
        blocked = F.struct(F.least(s["interval"] * 2, F.lit(base * cap)).alias("interval"), F.lit(0).alias("ok"), F.lit(0).alias("slow"))
        calm = F.struct(
            F.when(s["ok"] + 1 >= 3, F.greatest(s["interval"] / 2, F.lit(base))).otherwise(s["interval"]).alias("interval"),
            F.when(s["ok"] + 1 >= 3, F.lit(0)).otherwise(s["ok"] + 1).alias("ok"),
            F.lit(0).alias("slow"),
        )
        slow = F.struct(
            F.when(s["slow"] + 1 >= 3, F.least(s["interval"] * 1.5, F.lit(base * cap))).otherwise(s["interval"]).alias("interval"),
            F.lit(0).alias("ok"),
            F.when(s["slow"] + 1 >= 3, F.lit(0)).otherwise(s["slow"] + 1).alias("slow"),
        )
        return F.when(k == "blocked", blocked).when(k == "slow", slow).otherwise(calm)

    folded = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("k")))).alias("a"))
    return folded.select(key, F.size("a").cast("bigint").alias("n"), F.aggregate("a", start, step)["interval"].alias("interval"))


def natural_order(year: str, volume: str, issue: str) -> list[Column]:
    """Sort keys by year, volume and issue as numbers, others 0."""
    return [F.coalesce(C.cast_int(F.col(c)), F.lit(0)) for c in (year, volume, issue)]


def priority_pick(df: DataFrame, group: list[str], priority: str, position: str) -> DataFrame:
    """The row of the lowest priority (default 100) of each group, ties by position."""
    p = F.coalesce(C.cast_float(F.col(priority).cast("string")), F.lit(100.0))
    return df.groupBy(*group).agg(F.min_by(F.struct(*[c for c in df.columns if c not in group]), F.struct(p, F.col(position))).alias("r")).select(*group, "r.*")


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Rows with their number (from 1) in the whole order: ranges by the order, then counts before each range."""
    spread = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    spread = cut_lineage(spread.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(*order))))
    counts = spread.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"))  # one row a task
    out = spread.join(before, "__p").withColumn(name, (F.col("__before") + F.col("__r")).cast("bigint"))
    return out.drop("__p", "__r", "__before")


def chunks(df: DataFrame, order: str, size: int) -> DataFrame:
    """Rows dealt in order into chunks of ``size``."""
    out = numbered(df, [F.col(order)], "__place")
    return out.withColumn("chunk", F.floor((F.col("__place") - 1) / size).cast("bigint")).drop("__place")


def recycle_claims(queue: DataFrame, now: float, timeout: float) -> DataFrame:
    """Running items whose claim is older than the timeout are pending again."""
    late = (F.col("status") == "running") & (F.lit(now) - F.coalesce("running_ts", F.lit(0.0)) > timeout)
    return queue.withColumn("status", F.when(late, "pending").otherwise(F.col("status")))


def margin_cap(wall: Column, ratio: float) -> Column:
    return F.greatest(F.lit(1), F.floor(wall * ratio)).cast("bigint")


def cooldown(last: Column, window: int, now: int) -> Column:
    return F.greatest(F.lit(0), F.coalesce(last, F.lit(0)) + window - now)
