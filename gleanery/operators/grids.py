"""Grids of cells (``ARRAY<STRING>`` rows of a table) and what records of declared columns leave blank."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import columns as C
from gleanery.session import join_small

#: Words of column heads, all and telling ones; columns whose lines are joined by a mark.
STRONG_WORDS = ["序号", "编号", "名称", "标题", "日期", "时间", "金额", "单位", "部门", "类别", "备注", "文号"]
HEAD_WORDS = [*STRONG_WORDS, "项目", "内容", "依据", "类型", "地址", "电话", "数量", "状态", "编码", "代码"]
JOINED_BY = {"、": ["部门", "单位", "机构"], "；": ["依据", "法规"]}


def clean_cell(cell: Column, name: str = "", header: bool = False) -> Column:
    """One line of a cell: heads are joined as they are, units by 、, grounds by ；, other lines by ； only before a new item."""
    lines = F.transform(F.split(F.replace(F.coalesce(cell, F.lit("")), F.lit("　"), F.lit(" ")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    lines = F.filter(lines, lambda x: x != "")
    if header:
        return F.array_join(lines, "")
    mark = next((m for m, words in JOINED_BY.items() if any(w in name for w in words)), None)
    if mark:
        return F.array_join(lines, mark)
    joined = F.array_join(F.transform(lines, lambda x, i: F.when((i > 0) & x.rlike("^[《【（(]"), F.concat(F.lit("；"), x)).otherwise(x)), "")
    return F.when(F.size(lines) > 1, F.regexp_replace(F.regexp_replace(joined, "；+", "；"), "^；|；$", "")).otherwise(joined)


def is_header(cells: Column) -> Column:
    """Two or more short cells without sentence marks, two with words of heads, one of them telling."""
    full = F.filter(F.transform(cells, lambda x: C.strip(F.coalesce(x, F.lit("")))), lambda x: x != "")

    def hits(words: list[str]) -> Column:
        return F.size(F.filter(full, lambda x: x.rlike("|".join(words))))

    return (F.size(full) >= 2) & ~F.exists(full, lambda x: (F.length(x) > 24) | x.rlike("[《。]")) & (hits(STRONG_WORDS) >= 1) & (hits(HEAD_WORDS) >= 2)


def merge_plan(blanks: list[int], heads: list[str] | None, drop: int) -> list[int]:
    """For each column its place after ``drop`` merges into the left neighbour: equal neighbouring heads first, then the blankest."""
    groups = [[i] for i in range(len(blanks))]
    blanks, heads = list(blanks), list(heads or [])
    for _ in range(min(drop, len(groups) - 1)):
        at = next((j for j in range(1, min(len(heads), len(groups))) if heads[j] == heads[j - 1]), None)
        if at is None:
            at = max(1, max(range(len(groups)), key=lambda i: blanks[i]))
        groups[at - 1] += groups.pop(at)
        del blanks[at], heads[at : at + 1]
    place = {c: i for i, g in enumerate(groups) for c in g}
    return [place[i] for i in range(len(place))]


def merge_sparse_columns(grid: DataFrame, table: str, cells: str, drop: int, heads: list[str] | None = None) -> DataFrame:
    """Rows of each table with ``drop`` columns fewer.

    Blanks are counted by table and column before the shuffle; only one small array a table is planned in
    Python. Ties go to the first column; null cells are blank; a table of one column stays.
    """
    counted = grid.select(table, F.posexplode(cells).alias("__c", "__v")).groupBy(table, "__c").agg(F.sum(C.is_blank(F.col("__v")).cast("int")).alias("__n"))
    arrays = counted.groupBy(table).agg(F.transform(F.sort_array(F.collect_list(F.struct("__c", "__n"))), lambda x: x["__n"]).alias("__blanks"))

    @F.pandas_udf("array<int>")
    def plan(blanks: pd.Series) -> pd.Series:
        return blanks.map(lambda b: merge_plan([int(x) for x in b], heads, drop))

    joined = join_small(grid, arrays.select(table, plan("__blanks").alias("__plan")), table)

    def part(k: Column) -> Column:
        mine = F.filter(F.arrays_zip(F.col(cells).alias("v"), F.slice("__plan", 1, F.size(cells)).alias("p")), lambda x: (x["p"] == k) & ~C.is_blank(x["v"]))
        return F.array_join(F.transform(mine, lambda x: x["v"]), " ")

    merged = F.transform(F.array_distinct(F.slice("__plan", 1, F.size(cells))), part)
    return joined.select(*[F.when(F.size(cells) > 0, merged).otherwise(F.col(cells)).alias(c) if c == cells else F.col(c) for c in grid.columns])


def declared_completeness(records: DataFrame, declared: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """One row: cells checked, missing, rate, sources whose heads could not be read.

    A source is held to the columns it declares (``columns`` of ``declared``); where it declares none, or is
    unknown, to all. Without a cell to check the rate is null.
    """
    slim = declared.groupBy(source).agg(F.max("columns").alias("__declared"), F.lit(True).alias("__known"))
    rows = join_small(records, slim, source)
    told = F.coalesce(F.size("__declared") > 0, F.lit(False))
    asked = {c: (~told | F.array_contains("__declared", c)) for c in columns}
    unread = F.when(F.col("__known") & ~told, F.col(source))
    out = rows.agg(
        *[F.coalesce(F.sum(sum(x.cast("long") for x in v)), F.lit(0)).alias(n) for n, v in (("checked", list(asked.values())), ("missing", [a & C.is_blank(F.col(c)) for c, a in asked.items()]))],
        F.count_distinct(unread).alias("sources_unreadable"),
    )
    return out.select("checked", "missing", F.when(F.col("checked") > 0, F.round(100 - F.col("missing") * 100 / F.col("checked"), 4)).alias("rate"), "sources_unreadable")


def missing_references(references: DataFrame, files: DataFrame, on: str) -> DataFrame:
    """Files that are referred to and not there, each once."""
    return references.where(F.col(on).isNotNull()).select(on).distinct().join(files.select(on), on, "left_anti")
