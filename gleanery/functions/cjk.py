"""Chinese numerals and counts stated in prose, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits, units, words around a stated count, sentences that repeat or sum up.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
SAYS = "尚有|仍有|共发现|检查发现|检测发现|发现|涉及|通报|共计|本批"
LEFT_OUT = ["提出整改要求", "进行下架"]


def chinese_int(c: Column) -> Column:
    """一百零六 as 106, 一千二百万 as 12000000; a fold over the characters."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    digit = F.create_map(*[F.lit(x) for k, v in DIGITS.items() for x in (k, v)])
    unit = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("now"))

    def step(s, x):
        d, u = F.try_element_at(digit, x), F.try_element_at(unit, x)
        with_unit = s["total"] + F.when(s["now"] == 0, 1).otherwise(s["now"]) * u
        total = F.when(x == "万", (s["total"] + s["now"]) * 10_000).when(u.isNotNull(), with_unit).otherwise(s["total"])
        now = F.when(d.isNotNull(), d.cast("bigint")).when((x == "万") | u.isNotNull(), F.lit(0).cast("bigint")).otherwise(s["now"])
        return F.struct(total.cast("bigint").alias("total"), now.cast("bigint").alias("now"))

    return F.aggregate(chars, start, step, lambda s: s["total"] + s["now"])


def stated_count(c: Column, unit: str = "款", most: int = 5000) -> Column:
    """Sum of the counts a text states, by sentence; sentences that sum up or repeat are left out. NULL if it states none."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", " ")
    sentences = F.split(F.regexp_replace(plain, r"\s+", " "), "[。；;]")

    def counts(s: Column) -> Column:
        out = s.contains("共计") & s.contains("上述")
        for w in LEFT_OUT:
            out = out | s.contains(w)
        number = "".join(DIGITS) + "".join(UNITS) + "万"
        found = F.regexp_extract_all(s, F.lit(f"(?<=(?:{SAYS})[^款]{{0,30}}?)([0-9]{{1,5}}|[{number}]{{1,6}})(?=\\s*{unit})"), F.lit(1))
        values = F.transform(found, lambda x: F.coalesce(x.try_cast("bigint"), chinese_int(x)))
        return F.when(out, F.array().cast("array<bigint>")).otherwise(F.filter(values, lambda v: v.between(1, most)))

    all_counts = F.flatten(F.transform(sentences, counts))
    return F.when(F.size(all_counts) > 0, F.aggregate(all_counts, F.lit(0).cast("bigint"), lambda a, x: a + x))


def promo_sentences(c: Column, words: list[str], longest: int = 120) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[。！？!?\n；;]"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (s != "") & (F.length(s) <= longest) & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(s, w)))
