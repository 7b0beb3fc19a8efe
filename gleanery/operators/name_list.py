"""Records out of messy tables: headers, segments, continuation rows and sections, by windows over row numbers.

Input: ``doc``, ``row_no``, ``cells`` (array of text). A document's rows are ordered and gathered by
document only, as a table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Header words of each field, rows that are no records.
FIELDS = {
    "seq": ["序号"],
    "app_name": ["软件名称", "APP名称", "应用名称", "App名称", "应用名", "名称", "应用软件名称", "产品名称"],
    "company_name": ["企业名称", "开发者", "应用开发者", "公司名称", "开发者名称", "运营者名称", "生产厂商"],
    "version": ["版本", "版本号", "应用版本", "复测应用版本", "复测版本", "下架版本"],
    "store_source": ["版本来源", "应用来源", "应用来源商店", "来源", "应用商店", "来源商店", "样品来源"],
    "issue_types": ["所涉问题", "涉及问题", "问题", "问题项"],
}
OTHER_HEADERS = ["应用类别", "类别"]
TOTALS = r"^(合计|总计|小计|以上|以下|备注|说明|注[:：]|资料来源|数据来源)"
SECTION = r"^[（(][一二三四五六七八九十]+[)）]"


#: Words of company names, of stores, and of issues.
COMPANY_WORDS = [
    "有限公司", "有限责任公司", "公司", "集团", "中心", "研究院", "研究所", "大学", "学院", "银行", "医院", "工作室", "协会", "报社", "电视台", "出版社", "事业部",
    "管理局", "总局", "分行", "事务所", "连锁", "药房", "影院", "酒店", "网络科技", "信息技术", "传媒",
]
STORE_WORDS = r"(?i)(官网|商店|市场|应用宝|豌豆荚|百度|华为|小米|oppo|vivo|360|应用汇|搜狗|App ?Store|网站|网$|酷安|应用中心)"
ISSUE_WORDS = r"(收集|权限|推送|注销|弹窗|强制|欺骗|误导|骚扰|索取|超范围|私自|共享|泄露|SDK|广告|捆绑|不给|定向|账号|隐私|通讯录|麦克风|相册|位置|通讯|关闭|跳转|自动|违规|问题|收集使用|两次|默认)"


def cell_shape(c: Column) -> Column:
    """What a cell looks like: seq, section, company, store, issue, blank, other; the first that fits."""
    t = tidy(c)
    company = F.exists(F.array(*map(F.lit, COMPANY_WORDS)), lambda w: F.contains(t, w)) & (F.length(t) <= 40)
    out = F.when(t == "", "blank").when(t.rlike(r"^\d{1,4}$"), "seq").when(t.rlike(SECTION) | (t.endswith("名单") & (F.length(t) <= 30)), "section")
    return out.when(company, "company").when(t.rlike(STORE_WORDS) & (F.length(t) <= 20), "store").when(t.rlike(ISSUE_WORDS) & (F.length(t) <= 60), "issue").otherwise("other")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s　]+", "")


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s　]+", " "))


def place(header: Column, field: str) -> Column:
    """Column number (from 1) of a field in a header row, 0 if it has none."""
    words = F.array(*map(F.lit, FIELDS[field]))
    return F.coalesce(F.array_min(F.filter(F.transform(header, lambda x, i: F.when(F.array_contains(words, squeeze(x)), i + 1)), lambda x: x.isNotNull())), F.lit(0))


def assemble(grid: DataFrame) -> DataFrame:
    """One row a record: doc, record, first_row, n_rows, seq, the text fields, issue_types (array).

    Rows up to the first header have no columns to go by and are left out. A row gives the columns if it names the app
    and two more fields, and is all header words but one or has no number; other rows of header words are skipped. A row continues the record
    before it if its cells all lie at or right of the issues, or if the segment counts its rows (two
    sequence numbers or more, up to the largest int in their column) and this one has none; texts of a continuation are joined on, with a space where they had white space there
    between Latin letters or digits.
    """
    words = F.array(*[F.lit(w) for ws in [*FIELDS.values(), OTHER_HEADERS] for w in ws])
    filled = F.filter("cells", lambda x: squeeze(x) != "")
    hits = F.size(F.filter(filled, lambda x: F.array_contains(words, squeeze(x))))
    by_doc = W.partitionBy("doc").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    rows = grid.withColumn("__filled", filled).where(F.size("__filled") > 0)
    named = sum(((place(F.col("cells"), f) > 0).cast("int") for f in FIELDS), F.lit(0))
    counted_row = F.exists("__filled", lambda x: tidy(x).rlike(r"^\d{1,4}$"))
    rows = rows.withColumn("__words", hits >= F.greatest(F.lit(2), F.size("__filled") - 1))
    rows = rows.withColumn("__columns", (place(F.col("cells"), "app_name") > 0) & (named >= 3) & (F.col("__words") | ~counted_row))
    rows = rows.withColumn("__head", F.col("__words") | F.col("__columns"))
    rows = rows.withColumn("__map", F.last(F.when(F.col("__columns"), F.col("cells")), ignorenulls=True).over(by_doc))
    rows = rows.withColumn("__segment", F.last(F.when(F.col("__columns"), F.col("row_no")), ignorenulls=True).over(by_doc))
    first = tidy(F.element_at("__filled", 1))
    same = (F.size("__filled") > 1) & (F.size(F.array_distinct(F.transform("__filled", squeeze))) == 1)
    noise = same | ((F.size("__filled") == 1) & (first.rlike(SECTION) | (first.endswith("名单") & (F.length(first) <= 30))))
    noise = noise | (first.rlike(TOTALS) & ((F.size("__filled") == 1) | ~first.rlike(r"^\d{1,4}$")))
    rows = rows.where(~F.col("__head") & F.col("__map").isNotNull() & ~noise)
    at = {f: place(F.col("__map"), f).alias(f"__at_{f}") for f in FIELDS}
    rows = rows.select("doc", "row_no", "cells", "__segment", *at.values())
    value = {f: F.when(F.col(f"__at_{f}") > 0, F.try_element_at("cells", F.col(f"__at_{f}"))) for f in FIELDS}
    rows = rows.select("doc", "row_no", "__segment", "cells", "__at_issue_types", *[value[f].alias(f"v_{f}") for f in FIELDS])
    number = F.when(tidy(F.col("v_seq")).rlike(r"^\d+$"), tidy(F.col("v_seq")).try_cast("int"))
    rows = rows.withColumn("v_seq", number)
    counted = F.count("v_seq").over(W.partitionBy("doc", "__segment")) >= 2
    left = F.array_min(F.filter(F.transform("cells", lambda x, i: F.when(squeeze(x) != "", i + 1)), lambda x: x.isNotNull()))
    alone = F.size(F.filter("cells", lambda x: squeeze(x) != "")) == 1
    tail = (F.col("__at_issue_types") > 0) & (alone | (left >= F.col("__at_issue_types")))
    starts = ~F.coalesce(tail | (counted & F.col("v_seq").isNull()), F.lit(False))
    rows = rows.withColumn("record", F.sum(starts.cast("int")).over(by_doc)).where("record > 0")

    def joined(f: str) -> Column:
        v = F.col(f"v_{f}")
        gaps = [F.when(F.coalesce(v.rlike(p), F.lit(False)), "\0").otherwise("") for p in (r"(?U)^[\s　]", r"(?U)[\s　]$")]
        parts = F.array_sort(F.collect_list(F.struct("row_no", F.concat(gaps[0], F.replace(tidy(v), F.lit("\0"), F.lit("")), gaps[1]).alias("v"))))
        text = F.array_join(F.transform(parts, lambda x: x["v"]), "")
        return F.regexp_replace(F.regexp_replace(text, r"(?<=[A-Za-z0-9])\x00+(?=[A-Za-z0-9])", " "), r"\x00", "")

    pieces = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.coalesce("v_issue_types", F.lit("")).alias("v")))), lambda x: F.split(x["v"], "[\n;；]+")))
    issues = F.array_distinct(F.filter(F.transform(pieces, lambda x: F.regexp_replace(tidy(x), "^[ ；;、,，]+|[ ；;、,，]+$", "")), lambda x: (x != "") & ~F.array_contains(words, squeeze(x))))
    return rows.groupBy("doc", "record").agg(
        F.min("row_no").alias("first_row"),
        F.count("*").alias("n_rows"),
        F.first("v_seq", ignorenulls=True).alias("seq"),
        *[joined(f).alias(f) for f in ("app_name", "company_name", "version", "store_source")],
        issues.alias("issue_types"),
    )


def merge_sources(records: DataFrame) -> DataFrame:
    """Neighbouring records of one app become one: same identity, or same number and name; issues join, other sources go aside."""
    w = W.partitionBy("doc").orderBy("record")
    same = F.lit(True)
    for f in ("app_name", "company_name", "version", "store_source"):
        same = same & (F.col(f) == F.lag(f).over(w))
    same_app = F.col("seq").isNotNull() & (F.col("seq") == F.lag("seq").over(w)) & (F.col("app_name") != "") & (F.col("app_name") == F.lag("app_name").over(w))
    joins = F.coalesce((same | same_app) & ((F.col("app_name") != "") | (F.col("company_name") != "")), F.lit(False))
    rows = records.withColumn("app", F.sum((~joins).cast("int")).over(w))
    source = F.struct("record", "company_name", "version", "store_source")
    parts = F.array_sort(F.collect_list(F.struct("record", "seq", "app_name", source.alias("s"), "issue_types")))
    out = rows.groupBy("doc", "app").agg(parts.alias("p"))
    head = F.element_at("p", 1)
    others = F.filter(F.transform("p", lambda x: x["s"]), lambda s: (s["record"] != head["record"]) & (F.concat(s["company_name"], s["version"], s["store_source"]) != F.concat(head["s"]["company_name"], head["s"]["version"], head["s"]["store_source"])))
    return out.select(
        "doc", "app", head["seq"].alias("seq"), head["app_name"].alias("app_name"), head["s"]["company_name"].alias("company_name"), head["s"]["version"].alias("version"),
        head["s"]["store_source"].alias("store_source"), F.array_distinct(F.flatten(F.transform("p", lambda x: x["issue_types"]))).alias("issue_types"),
        F.transform(others, lambda s: s.dropFields("record")).alias("alt_sources"),
    )


def reading_order(segments: DataFrame, key: str, tolerance: float = 8.0) -> DataFrame:
    """Lines of text segments (x, y, text), from the top (largest y): a segment joins the line whose first one is at most the
    tolerance above it, else it begins a line; inside a line by x. A page's places are gathered, as a page is.

    Neighbours in Chinese characters join without a space.
    """
    fits = lambda starts, y: (F.size(starts) > 0) & (F.element_at(starts, -1) - y <= tolerance)
    ys = F.reverse(F.array_sort(F.collect_set(F.col("y").cast("double"))))
    begun = F.aggregate("__ys", F.array().cast("array<double>"), lambda starts, y: F.when(fits(starts, y), starts).otherwise(F.concat(starts, F.array(y))))
    pages = segments.groupBy(key).agg(ys.alias("__ys"), F.collect_list(F.struct(F.col("y").cast("double").alias("y"), "x", "text")).alias("__s")).select(key, "__s", begun.alias("__starts"))
    placed = pages.select(key, "__starts", F.explode("__s").alias("s")).select(key, F.size(F.filter("__starts", lambda a: a >= F.col("s.y"))).cast("bigint").alias("line"), "s.x", "s.text")
    lines = placed.groupBy(key, "line").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("s"))
    spaced = F.array_join(F.transform("s", lambda x: x["text"]), " ")
    return lines.select(key, "line", F.regexp_replace(spaced, r"(?<=\p{IsHan}) (?=\p{IsHan})", "").alias("text"))
