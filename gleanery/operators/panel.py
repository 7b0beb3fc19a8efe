"""The full audit of a panel (one row for each company and year) against its texts, its list of companies and what its notes claim.

Each rule is a filter, a join by (code, year) or an aggregate; all issues come as rows (rule, code, year, detail). Codes are brought to six digits on every side
(``600519.0`` and ``600519`` are one) except where the rule is about their form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import columns as C
from gleanery.operators import quality, rows
from gleanery.session import cut_lineage, join_small

#: What a title says of its year; marks in notes; signs of traditional script and of their simplified forms; units of claims.
TITLE_YEAR = r"(\d{4})\s*年年度报告"
NOT_REPEATABLE, TRADITIONAL = "不可复现", "繁体"
OLD_SIGNS, NEW_SIGNS = "國關於這時總運網發後來區員會務東車語", "国关于这时总运网发后来区员会务东车语"
UNITS = {"行": "rows", "家": "companies", "条": "rows"}
CLAIM = r"(?:(\d{4})\s*年[^0-9。；;\n]{0,12})?(\d{1,3}(?:,\d{3})+|\d+)\s*(行|家|条)"


def code6(c: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), r"\D", "")
    return F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0"))


def issues(table: DataFrame, rule: str, detail: Column | None = None) -> DataFrame:
    return table.select(F.lit(rule).alias("rule"), "code", "year", (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def window_issues(panel: DataFrame, universe: DataFrame, gaps: DataFrame | None, low: int, high: int) -> DataFrame:
    """Rows outside their company's years, and years of a company that are neither in the panel nor in the list of gaps.

    ``universe``: code, first_year, last_year; ``gaps``: code, year. Of a company listed more than once the last row by years counts.
    """
    one = universe.groupBy(code6(F.col("code")).alias("code")).agg(F.max(F.struct(F.col("first_year").cast("int").alias("a"), F.col("last_year").cast("int").alias("b"))).alias("w"))
    windows = one.select("code", F.coalesce("w.a", F.lit(low)).alias("a"), F.coalesce("w.b", F.lit(high)).alias("b"))
    joined = join_small(panel, windows, "code")
    outside = joined.where(F.col("a").isNull() | F.col("year").isNull() | ~F.col("year").between(F.col("a"), F.col("b")))
    asked = windows.where(F.greatest("a", F.lit(low)) <= F.least("b", F.lit(high)))
    expected = asked.select("code", F.explode(F.sequence(F.greatest("a", F.lit(low)).cast("bigint"), F.least("b", F.lit(high)).cast("bigint"))).alias("year"))
    missing = expected.join(panel.select("code", "year").distinct(), ["code", "year"], "left_anti")
    if gaps is not None:
        missing = missing.join(gaps.select(code6(F.col("code")).alias("code"), F.col("year").cast("bigint").alias("year")).distinct(), ["code", "year"], "left_anti")
    return issues(outside, "outside_window").unionByName(issues(missing, "missing_year"))


def text_issues(panel: DataFrame, texts: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """Rows without a text that no note excuses; texts whose length or keyword counts are not what the panel says; traditional script without a note.

    ``texts``: code, year, text. The panel has ``total``, ``note`` and a ``count_<group>`` for each group of keywords. Counts are those of
    whole texts and of all rows.
    """
    held = texts.select(code6(F.col("code")).alias("code"), F.col("year").cast("bigint").alias("year"), "text")
    heads = [F.length("text").alias("__chars"), rows.mostly(F.col("text"), OLD_SIGNS, NEW_SIGNS).alias("__old")]
    counts = [sum((C.count_of(F.col("text"), w) for w in words), F.lit(0)).alias(f"__n_{g}") for g, words in keywords.items()]
    measured = cut_lineage(held.groupBy("code", "year").agg(F.max("text").alias("text")).select("code", "year", *heads, *counts))
    real = panel.where(F.coalesce(F.col("total"), F.lit(0)) > 0)
    met = real.join(measured, ["code", "year"], "left")
    note = F.coalesce("note", F.lit(""))
    missing = met.where(F.col("__chars").isNull() & ~note.contains(NOT_REPEATABLE))
    off = F.filter(
        F.array(F.when(F.col("__chars") != F.col("total"), "total"), *[F.when(~F.col(f"__n_{g}").eqNullSafe(F.col(f"count_{g}")), g) for g in keywords]), lambda x: x.isNotNull()
    )
    recounted = met.where(F.col("__chars").isNotNull()).withColumn("__off", off).where(F.size("__off") > 0)
    old = met.where(F.col("__old") & ~note.contains(TRADITIONAL))
    return issues(missing, "text_missing").unionByName(issues(recounted, "recount", F.array_join("__off", ","))).unionByName(issues(old, "traditional_script"))


def title_issues(panel: DataFrame) -> DataFrame:
    said = F.regexp_extract(F.coalesce("title", F.lit("")), TITLE_YEAR, 1)
    return issues(panel.where((said != "") & ~said.cast("bigint").eqNullSafe(F.col("year"))), "title_year", said)


def claims(notes: DataFrame, text: str = "text") -> DataFrame:
    """(scope, measure, number, said): numbers of rows or companies in notes, of all or of one year (``2015年 共 1,234 行``)."""
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(CLAIM), F.lit(g)).alias(n) for n, g in (("year", 1), ("number", 2), ("unit", 3), ("said", 0))])
    each = notes.select(F.explode(found).alias("c")).select("c.*")
    unit = F.coalesce(*[F.when(F.col("unit") == u, m) for u, m in UNITS.items()])
    number = F.replace("number", F.lit(","), F.lit("")).try_cast("bigint")
    return each.select(F.when(F.col("year") == "", "all").otherwise(F.col("year")).alias("scope"), unit.alias("measure"), number.alias("number"), F.trim("said").alias("said"))


def claim_issues(panel: DataFrame, notes: DataFrame) -> DataFrame:
    """Claims that the panel does not bear out: aggregates of all and of each year, in one scan, met by an equi-join. A number of rows may be that of all or of those with a total."""
    by = panel.groupingSets([[], ["year"]], "year").agg(
        F.grouping("year").alias("whole"), F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("total"), F.lit(0)) > 0).alias("real"), F.count_distinct("code").alias("companies")
    )
    scope = F.when(F.col("whole") == 1, "all").otherwise(F.col("year").cast("string"))
    known = by.where((F.col("whole") == 1) | F.col("year").isNotNull()).select(
        scope.alias("scope"), F.explode(F.create_map(F.lit("rows"), F.array("rows", "real"), F.lit("companies"), F.array("companies"))).alias("measure", "values")
    )
    stated = claims(notes)
    joined = stated.join(known, ["scope", "measure"], "left")
    wrong = joined.where(~F.coalesce(F.array_contains("values", F.col("number")), F.lit(False)) & ~(F.col("values").isNull() & (F.col("number") == 0)))
    shown = F.concat(F.col("said"), F.lit(" / "), F.coalesce(F.array_join(F.col("values").cast("array<string>"), " or "), F.lit("0")))
    return issues(wrong.withColumn("code", F.lit("")).withColumn("year", F.lit(None).cast("bigint")), "note_claim", shown)


def audit(
    panel: DataFrame, low: int, high: int, groups: list[str], keywords: dict[str, list[str]] | None = None, universe: DataFrame | None = None,
    gaps: DataFrame | None = None, texts: DataFrame | None = None, notes: DataFrame | None = None,
) -> DataFrame:
    """All issues of a panel (code, year, total, title, note, and for each group ``count_<group>`` and ``freq_<group>``)."""
    whole = panel.withColumn("year", F.col("year").cast("bigint"))
    out = None
    for g in groups:
        found = quality.panel_audit(whole, "code", "year", low, high, "total", f"count_{g}", f"freq_{g}")
        found = found.select("rule", "code", "year", F.when(F.col("rule") == "freq_formula", g).otherwise("").alias("detail"))
        found = found if g == groups[0] else found.where("rule = 'freq_formula'")
        out = found if out is None else out.unionByName(found)
    even = cut_lineage(whole.withColumn("code", code6(F.col("code"))))
    parts = [title_issues(even)]
    if universe is not None:
        parts.append(window_issues(even, universe, gaps, low, high))
    if texts is not None:
        parts.append(text_issues(even, texts, keywords or {}))
    if notes is not None:
        parts.append(claim_issues(even, notes))
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
