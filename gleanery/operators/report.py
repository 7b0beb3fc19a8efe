"""Reports from small results, hooks around a plan, and watches over batches."""

from __future__ import annotations

import html as escape
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleanery.functions import columns as C
from gleanery.operators import quality, relational

#: What a task text may ask for, and the column names that would hold it.
ASKED = {
    "date": (["日期", "时间", "date", "when"], ["date", "time", "日期", "时间", "year", "年份"]),
    "count": (["数量", "多少", "count", "how many"], ["count", "num", "数量", "total", "total_count"]),
    "issue": (["问题", "issue", "problem"], ["issue", "问题", "problem"]),
}


def profile_html(df: DataFrame, group: str | None = None, title: str = "Profile") -> str:
    """A page with the numeric profile, missing counts, and if asked the groups; every table is an aggregate."""
    numbers = quality.numeric_columns(df)
    parts = [("Missing", quality.missing_profile(df, df.columns))]
    if numbers:
        typed = df.select(*[C.measured_number(F.col(c)).alias(c) for c in numbers])
        parts.insert(0, ("Numbers", quality.numeric_profile(typed, numbers)))
        if group:
            parts.append((f"{numbers[0]} by {group}", quality.group_summary(df, group, C.measured_number(F.col(numbers[0]))).limit(200)))  # a report of 200 groups
    out = [f"<!DOCTYPE html><meta charset=utf-8><title>{escape.escape(title)}</title><h1>{escape.escape(title)}</h1>"]
    for name, t in parts:
        head = "".join(f"<th>{escape.escape(c)}</th>" for c in t.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in t.collect())
        out.append(f"<h2>{escape.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(out)


def missing_fields(df: DataFrame, task: str) -> list[str]:
    """Kinds of values the task text asks for that no column holds, or only blank ones."""
    wanted = {k: names for k, (words, names) in ASKED.items() if any(w in task.lower() for w in words)}
    found = {k: [c for c in df.columns if any(n in c.lower() for n in names)] for k, names in wanted.items()}
    columns = sorted({c for cs in found.values() for c in cs})
    filled = df.agg(*[F.coalesce(F.bool_or(~C.is_blank(F.col(c))), F.lit(False)).alias(c) for c in columns]).first().asDict() if columns else {}
    return [k for k, cs in found.items() if not any(filled[c] for c in cs)]


def with_hooks(df: DataFrame, hooks: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """User functions in order; one that returns None leaves the frame as it is."""
    for hook in hooks:
        out = hook(df)
        df = df if out is None else out
    return df


def observed(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Observation]:
    """The frame with counters that fill as it is written: rows and filled values of each column."""
    seen = Observation()
    counters = [F.sum((~C.is_blank(F.col(c))).cast("long")).alias(f"filled_{c}") for c in columns]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counters), seen


def all_keys(df: DataFrame, column: str, most: int = 5000) -> list[str]:
    """Names of all fields that occur in a JSON object column, in order; one aggregation. More than ``most`` are no table's columns: an error."""
    keys = df.select(F.explode(F.json_object_keys(column)).alias("k")).distinct().limit(most + 1).collect()
    if len(keys) > most:
        raise ValueError(f"{column} has more than {most} different fields")
    return sorted(r["k"] for r in keys)


def spread_json(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """JSON objects of differing fields as one table with the union of their fields as text columns."""
    v = F.try_parse_json(F.col(column))
    return df.select(*keep, *[C.jpath_text(v, f"{k}").alias(k) for k in all_keys(df, column)])


def saturated(batches: DataFrame, batch: str, key: str, quiet: int = 3) -> int | None:
    """The first batch that ends ``quiet`` batches in a row without a new key."""
    from pyspark.sql import Window as W

    first = batches.groupBy(key).agg(F.min(batch).alias(batch))
    new = first.groupBy(batch).agg(F.count("*").alias("new"))
    counts = batches.select(batch).distinct().join(new, batch, "left").select(batch, F.coalesce("new", F.lit(0)).alias("new"))
    run = F.max("new").over(W.orderBy(batch).rowsBetween(1 - quiet, 0))  # one row a batch
    n = F.row_number().over(W.orderBy(batch))
    hit = counts.withColumn("calm", (run == 0) & (n >= quiet)).where("calm").agg(F.min(batch).alias("b")).first()
    return hit["b"]


def watch(current: DataFrame, known: DataFrame, key: str, tell: Callable[[list], None], most: int = 1000) -> None:
    """Tell of keys that came or went since the last snapshot (a report of ``most`` rows)."""
    changes = relational.snapshot_diff(current, known, key).orderBy("change", key).limit(most).collect()
    if changes:
        tell([(r["change"], r[key]) for r in changes])
