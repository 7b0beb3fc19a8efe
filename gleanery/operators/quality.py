"""Profiling, completeness checks and audits. Each report is one scan and one aggregation where it can be."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import columns as C

#: Column names that hold dates, which are not profiled as numbers.
DATE_NAMES = ["年份", "year", "date", "时间", "日期"]
#: Hints of personal data in column names.
PII_HIGH = ["身份证", "idcard", "id_card", "passport", "护照", "bank", "银行卡", "password", "密码", "ssn"]
PII_MEDIUM = ["phone", "手机", "电话", "mobile", "email", "邮箱", "address", "地址", "姓名", "name", "微信", "qq", "ip"]


def numeric_columns(df: DataFrame, least: int = 3, share: float = 0.3) -> list[str]:
    """Columns that parse as numbers in at least ``share`` of the rows; one aggregation."""
    names = [c for c in df.columns if not any(w in c.lower() for w in DATE_NAMES)]
    if not names:
        return []
    row = df.agg(F.count("*").alias("__n"), *[F.count(C.measured_number(F.col(c))).alias(c) for c in names]).first()
    return [c for c in names if row[c] >= max(least, share * row["__n"])]


def medians(df: DataFrame, exprs: dict[str, Column], few: int = 20_000, margin: float = 0.001) -> dict[str, float | None]:
    """Exact medians of numbers; no task and not the driver holds more than ``few`` different values of a column.

    A sketch gives values a little below and above the middle; the rows below are counted, and of those between the different values.
    While there are more than ``few`` of them, a sketch of the rows between narrows them further.
    """
    numbers = df.select(*[x.cast("double").alias(f"x{i}") for i, x in enumerate(exprs.values())])
    sizes = numbers.agg(*[F.count(c).alias(c) for c in numbers.columns]).first()
    ranks = {c: ((sizes[c] - 1) // 2, sizes[c] // 2) for c in numbers.columns if sizes[c]}  # from 0
    inside, shares, found = {c: F.col(c).isNotNull() for c in ranks}, dict.fromkeys(ranks, 0.5), {}
    while len(found) < len(ranks):
        left = [c for c in ranks if c not in found]
        ends = numbers.agg(*[F.percentile_approx(F.when(inside[c], F.col(c)), [max(0.0, shares[c] - margin), min(1.0, shares[c] + margin)], 10_000).alias(c) for c in left]).first()
        inside |= {c: F.col(c).between(*ends[c]) for c in left}
        long = numbers.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.when(inside[c], F.col(c)).alias("x")) for c in left]))).where("x is not null")
        counted = long.groupBy("c", "x").agg(F.count("*").alias("n"))
        kinds = {r["c"]: (r["kinds"], r["n"]) for r in counted.groupBy("c").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect()}
        below = numbers.agg(*[F.count_if(F.col(c) < ends[c][0]).alias(c) for c in left]).first()
        small = [c for c in left if kinds[c][0] <= few]
        rows = counted.where(F.col("c").isin(small)).orderBy("c", "x").collect() if small else []
        for c in small:
            at, middle = below[c], []
            for r in (r for r in rows if r["c"] == c):
                middle += [r["x"]] * sum(at <= k < at + r["n"] for k in ranks[c])
                at += r["n"]
            found[c] = sum(middle) / 2
        shares |= {c: (ranks[c][0] - below[c]) / kinds[c][1] for c in left if c not in small}
    return {name: found.get(c) for name, c in zip(exprs, numbers.columns)}


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table: column, n, min, max, mean, median, missing."""
    numbers = {c: C.plain_number(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double") for c in columns}
    middle = medians(df, numbers)
    aggs = []
    for c, x in numbers.items():
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("n"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.round(F.avg(x.cast("decimal(30,6)")).cast("double"), 4).alias("mean"),
                F.lit(middle[c]).cast("double").alias("median"),
                F.sum(C.is_blank(F.col(c)).cast("bigint")).alias("missing"),
            )
        )
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.sum(C.is_blank(F.col(c)).cast("bigint")), F.lit(0)).alias("missing"), F.count("*").alias("total")) for c in columns])
    return df.agg(rows.alias("a")).select(F.inline("a"))


def group_summary(df: DataFrame, group: str, value: Column) -> DataFrame:
    """n, mean and sum of each group, rounded to cents; a blank group is ``(空)``."""
    g = F.when(C.is_blank(F.col(group)), "(空)").otherwise(F.col(group).cast("string")).alias("grp")
    x = value.cast("decimal(30,6)")
    out = df.groupBy(g).agg(F.count("*").alias("n"), F.round(F.avg(x).cast("double"), 2).alias("mean"), F.round(F.sum(x).cast("double"), 2).alias("total"))
    return out.orderBy(F.desc("n"), "grp")


def histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """Equal bins, the last one closed; two passes (range, then counts)."""
    x = df.select(value.cast("double").alias("x")).where("x is not null")
    low, high = x.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return x.select(F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0).cast("bigint").alias("n")).limit(0)
    width = ((high - low) or 1.0) / bins
    return x.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / width)).cast("int").alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), "n")


def token_topk(df: DataFrame, tokens: Column, k: int, least: int = 1) -> DataFrame:
    counted = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(k)


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def keyword_stats(df: DataFrame, key: str, text: str, groups: dict[str, list[str]]) -> DataFrame:
    """Characters, and for each group the count of its words and the frequency in 2000 characters."""
    t = C.text(F.col(text))
    total = F.length(t)
    out = [F.col(key), total.cast("bigint").alias("total_chars")]
    for name, words in groups.items():
        n = sum((C.count_of(t, w) for w in words[1:]), C.count_of(t, words[0]))
        out += [n.alias(f"{name}_kw_count"), F.when(total > 0, F.round(n * 2000 / total, 3)).alias(f"{name}_kw_freq")]
    return df.select(*out)


def key_sentences(df: DataFrame, key: str, text: str, words: list[str], most: int = 5) -> DataFrame:
    """The first sentences that hold a word, distinct by their first 80 characters, joined by `` || ``."""
    hit = F.filter(C.sentences(C.text(F.col(text))), lambda s: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(s, w)))
    heads = F.transform(hit, lambda s: F.substring(s, 1, 80))
    first = F.filter(F.transform(hit, lambda s, i: F.when(F.array_position(heads, F.substring(s, 1, 80)) == i + 1, s)), lambda s: s.isNotNull())
    return df.select(key, F.array_join(F.slice(first, 1, most), " || ").alias("key_sentences"))


def completeness(df: DataFrame, columns: list[str], keys: list[str] = (), least: float = 0.9) -> DataFrame:
    """column, filled, total, rate, pass: key columns need the rate, others fail only if blank throughout in three rows or more."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.sum((~C.is_blank(F.col(c))).cast("bigint")).alias("filled"), F.count("*").alias("total"), F.lit(c in keys).alias("is_key")) for c in columns])
    long = df.agg(rows.alias("a")).select(F.inline("a")).withColumn("filled", F.coalesce("filled", F.lit(0)))
    rate = F.when(F.col("total") > 0, F.col("filled") / F.col("total")).otherwise(0.0)
    ok = F.when(F.col("is_key"), rate >= least).otherwise(~((F.col("filled") == 0) & (F.col("total") >= 3)))
    return long.select("column", "filled", "total", F.round(rate, 4).alias("rate"), ok.alias("pass"))


def sparse_rates(df: DataFrame, columns: list[str], core: list[str]) -> DataFrame:
    """Overall and core fill rates of a sparse matrix."""

    def rate(names):
        total = sum((F.sum((~C.is_blank(F.col(c))).cast("bigint")) for c in names[1:]), F.sum((~C.is_blank(F.col(names[0]))).cast("bigint")))
        return F.round(total / (F.count("*") * len(names)), 4)

    return df.agg(rate(columns).alias("overall_rate"), rate(core).alias("core_rate"))


def gap_attribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, placeholder (the source says none), blank (truly empty), filled."""
    rows = []
    for c in columns:
        blank, none = C.is_blank(F.col(c)), C.is_placeholder(F.col(c))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.sum((none & ~blank).cast("bigint")).alias("placeholder"),
                F.sum(blank.cast("bigint")).alias("blank"),
                F.sum((~none).cast("bigint")).alias("filled"),
            )
        )
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def duplicate_check(df: DataFrame, keys: list[str]) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_key.agg(total.cast("bigint").alias("total"), F.count("*").alias("distinct_keys"), (total - F.count("*")).cast("bigint").alias("duplicates"), F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("largest"))


def reconcile(actual: DataFrame, stated: DataFrame, on: str, tolerance: float = 0.05) -> DataFrame:
    """Counts by batch against stated ones: ok, off, no_stated."""
    got = actual.groupBy(on).agg(F.count("*").alias("got"))
    out = got.join(stated.select(on, "stated"), on, "full_outer").withColumn("got", F.coalesce("got", F.lit(0)))
    verdict = F.when(F.col("stated").isNull(), "no_stated").when(F.abs(F.col("got") - F.col("stated")) > tolerance * F.col("stated"), "off").otherwise("ok")
    return out.select(on, "got", "stated", verdict.alias("verdict"))


def semantic_check(df: DataFrame, expect: list[str]) -> DataFrame:
    """token, found, pass: plain tokens (any one will do), ``+must``, ``!must not``, over all values of a row."""
    joined = F.concat_ws(" ", *[C.text(F.col(c)) for c in df.columns])
    bare = [t.lstrip("+!") for t in expect]
    rows = df.select(joined.alias("j")).agg(*[F.coalesce(F.bool_or(F.col("j").contains(t)), F.lit(False)).alias(f"t{i}") for i, t in enumerate(bare)])
    any_plain = F.lit(all(t[0] in "+!" for t in expect))
    for i, t in enumerate(expect):
        any_plain = any_plain | F.col(f"t{i}") if t[0] not in "+!" else any_plain
    items = [
        F.struct(F.lit(t).alias("token"), F.col(f"t{i}").alias("found"), (F.col(f"t{i}") if t[0] == "+" else ~F.col(f"t{i}") if t[0] == "!" else any_plain).alias("pass")) for i, t in enumerate(expect)
    ]
    return rows.select(F.inline(F.array(*items)))


def column_assertions(df: DataFrame, rules: list[str]) -> DataFrame:
    """``col!word`` (never holds) and ``col+word`` (always holds): assertion, violations, pass."""
    items = []
    for r in rules:
        m = re.match(r"^(.+?)([!+])(.+)$", r)
        held = C.text(F.col(m[1])).contains(m[3])
        bad = held if m[2] == "!" else ~held
        n = F.coalesce(F.sum(bad.cast("bigint")), F.lit(0))
        items.append(F.struct(F.lit(r).alias("assertion"), n.alias("violations"), (n == 0).alias("pass")))
    return df.agg(F.array(*items).alias("a")).select(F.inline("a"))


#: Columns that may be a key by themselves, in order; parts of a joint key.
KEY_COLUMNS = ["url", "link", "id", "shopId", "链接", "网址"]
TITLE_COLUMNS, NAME_COLUMNS, LINK_COLUMNS = ["title", "标题"], ["name", "名称"], ["link", "url", "链接", "网址"]


def choose_key(df: DataFrame, rows: int = 50) -> list[list[str]]:
    """Columns to tell duplicates by, read off the first rows when the plan is made: the first key column that half of them have, else
    title and link, else name and link; of several columns of one part the first that is filled counts. [] if there is none."""
    known = [c for c in dict.fromkeys([*KEY_COLUMNS, *TITLE_COLUMNS, *NAME_COLUMNS]) if c in df.columns]
    if not known:
        return []
    row = df.limit(rows).agg(F.count("*").alias("__n"), *[F.count_if(~C.is_blank(F.col(c))).alias(c) for c in known]).first()
    most = [c for c in known if row["__n"] and row[c] >= max(1, row["__n"] // 2)]
    for c in KEY_COLUMNS:
        if c in most:
            return [[c]]
    for part in (TITLE_COLUMNS, NAME_COLUMNS):
        if any(c in most for c in part):
            return [[c for c in part if c in df.columns], [c for c in LINK_COLUMNS if c in df.columns]]
    return []


def duplicates_by(df: DataFrame, key: list[list[str]]) -> DataFrame:
    """One row: ``duplicates`` and ``blank`` rows by a key of ``choose_key``."""
    parts = [F.coalesce(*[F.when(~C.is_blank(F.col(c)), F.trim(F.col(c).cast("string"))) for c in columns], F.lit("")) if columns else F.lit("") for columns in key]
    keyed = df.select(F.concat_ws("\x1f", *parts).alias("k"))
    counted = keyed.groupBy("k").agg(F.count("*").alias("n")).withColumn("blank", F.trim(F.replace("k", F.lit("\x1f"), F.lit(""))) == "")
    return counted.agg(
        F.coalesce(F.sum(F.when(~F.col("blank"), F.col("n") - 1)), F.lit(0)).cast("bigint").alias("duplicates"), F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).cast("bigint").alias("blank")
    )


def violating_rows(df: DataFrame, rules: list[str], key: str, most: int = 3) -> DataFrame:
    """(assertion, key, value): the first rows by key that break each rule of ``column_assertions``, up to ``most`` a rule (a report)."""
    parts = []
    for r in rules:
        m = re.match(r"^(.+?)([!+])(.+)$", r)
        value = C.text(F.col(m[1]))
        bad = value.contains(m[3]) if m[2] == "!" else ~value.contains(m[3])
        parts.append(df.where(bad).select(F.lit(r).alias("assertion"), F.col(key).alias("key"), value.alias("value")).orderBy("key").limit(most))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_audit(df: DataFrame, columns: list[str], path: Column | None = None) -> DataFrame:
    """Rows and fill rate of each input file: ok, partial, empty."""
    filled = sum(((~C.is_blank(F.col(c))).cast("int") for c in columns[1:]), (~C.is_blank(F.col(columns[0]))).cast("int"))
    out = df.groupBy((path if path is not None else F.input_file_name()).alias("file")).agg(F.count("*").alias("n_rows"), F.round(F.avg(filled / len(columns)), 4).alias("fill"))
    return out.withColumn("verdict", F.when(F.col("fill") == 0, "empty").when(F.col("fill") < 0.9, "partial").otherwise("ok"))


def panel_audit(panel: DataFrame, code: str, year: str, low: int, high: int, total: str, count: str, freq: str) -> DataFrame:
    """Issue rows (rule, code, year) of a panel: repeated key, code format, year out of window, frequency off its formula."""
    base = panel.select(F.col(code).cast("string").alias("code"), F.col(year).alias("year"), F.col(total).alias("t"), F.col(count).alias("n"), F.col(freq).alias("f"))
    repeated = base.groupBy("code", "year").agg(F.count("*").alias("k")).where("k > 1").select("code", "year", F.array(F.lit("duplicate_key")).alias("r"))
    off = F.abs(F.col("f") - F.round(F.col("n") * 2000 / F.col("t"), 3)) > 0.0015
    flags = F.array(
        F.when(~F.col("code").rlike(r"^\d{6}$"), "code_format"),
        F.when(~F.col("year").between(low, high), "year_window"),
        F.when((F.col("t") > 0) & off, "freq_formula"),
    )
    single = base.select("code", "year", F.filter(flags, lambda x: x.isNotNull()).alias("r"))
    return single.unionByName(repeated).select(F.explode("r").alias("rule"), "code", "year")


def pii_findings(columns: list[str]) -> dict[str, str]:
    """Columns whose names hint at personal data: red or amber."""
    out = {}
    for c in columns:
        low = c.lower()
        level = "red" if any(w in low for w in PII_HIGH) else "amber" if any(w in low for w in PII_MEDIUM) else None
        if level:
            out[c] = level
    return out


def log_pattern_counts(lines: DataFrame, line: str, patterns: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.coalesce(F.sum(C.count_of(C.text(F.col(line)), p)), F.lit(0)).alias("n")) for p in patterns])
    return lines.agg(rows.alias("a")).select(F.inline("a"))


def delivery_summary(df: DataFrame, status: str, size_kb: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(status) == "ok").alias("n_ok"),
        F.count_if(~F.col(status).eqNullSafe(F.lit("ok"))).alias("n_fail"),
        F.round(F.coalesce(F.sum(F.col(size_kb).cast("decimal(30,3)")), F.lit(0)).cast("double") / 1024, 2).alias("total_mb"),
    )


def coverage_metrics(df: DataFrame, columns: list[str], required: list[str]) -> DataFrame:
    def missing(names):
        return sum((F.sum(C.is_blank(F.col(c)).cast("bigint")) for c in names[1:]), F.sum(C.is_blank(F.col(names[0])).cast("bigint")))

    return df.agg(
        missing(columns).alias("missing_cells"),
        (F.count("*") * len(columns)).cast("bigint").alias("total_cells"),
        missing(required).alias("required_missing"),
        (F.count("*") * len(required)).cast("bigint").alias("required_cells"),
    )


def json_shape(df: DataFrame, column: str) -> DataFrame:
    """The schema that covers all JSON values of a column."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("schema"))


def table_quality(cells: DataFrame, key: str) -> DataFrame:
    """From long cells (key, col_name, value): rates of made-up names, blank cells and numeric headers; degraded or ok."""
    c = cells.groupBy(key).agg(
        F.round(F.avg(F.col("col_name").rlike(r"^col\d+$").cast("int")), 4).alias("fallback_rate"),
        F.round(F.avg(C.is_blank(F.col("value")).cast("int")), 4).alias("empty_rate"),
        F.round(F.avg(F.col("col_name").rlike(r"^[\d.,%-]+$").cast("int")), 4).alias("numeric_rate"),
    )
    bad = (F.col("fallback_rate") >= 0.5) | (F.col("empty_rate") >= 0.6) | (F.col("numeric_rate") >= 0.5)
    return c.withColumn("verdict", F.when(bad, "degraded").otherwise("ok"))


def inherit_blanks(df: DataFrame, group: list[str], order: list, columns: list[str]) -> DataFrame:
    """Blank cells take the last value above in their group."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    for c in columns:
        df = df.withColumn(c, F.last(F.when(~C.is_blank(F.col(c)), F.col(c)), ignorenulls=True).over(w))
    return df


def segment_by_header(df: DataFrame, group: list[str], order: str, is_header: Column) -> DataFrame:
    """``segment``: the order value of the last header row at or above."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("segment", F.last(F.when(is_header, F.col(order)), ignorenulls=True).over(w))


def attach_continuations(df: DataFrame, group: list[str], order: str, starts: Column, collect: str) -> DataFrame:
    """Rows that do not start a record belong to the one before: first row's columns and all collected values in order."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("record", F.sum(starts.cast("int")).over(w)).where("record > 0")
    values = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(collect).alias("v"))))
    out = rows.groupBy(*group, "record").agg(F.min(order).alias("first_row"), F.count("*").alias("n_rows"), values.alias("vs"))
    return out.withColumn("collected", F.filter(F.transform("vs", lambda x: x["v"]), lambda v: ~C.is_blank(v))).drop("vs")
