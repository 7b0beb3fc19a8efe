import gzip
import random
import statistics

import pytest

from gleanery.operators import quality, rows
from gleanery.sources import io
from pyspark.sql import functions as F


def test_task_keywords():
    got = rows.task_keywords("请抓取图书的价格")
    assert got == ["取图书", "取图", "图书", "价格"] and rows.task_keywords("") == rows.task_keywords("的和为") == []


def test_gzip_bodies():
    assert io.decode_bytes(gzip.compress("<loc>甲</loc>".encode("gbk")), "text/xml; charset=gbk") == "<loc>甲</loc>"
    assert io.decode_bytes(b"\x1f\x8bno gzip").startswith("\x1f")


def test_key_choice(spark):
    d = lambda names, *values: spark.createDataFrame(list(values), ", ".join(f"`{n}` string" for n in names))
    assert quality.choose_key(d(["id", "url"], ("1", None), ("2", None), ("3", "u"), ("4", " "))) == [["id"]]
    assert quality.choose_key(d(["title", "link", "x"], ("a", "l", None))) == [["link"]]
    assert quality.choose_key(d(["title", "link"], ("a", None), ("b", " "))) == [["title"], ["link"]]
    assert quality.choose_key(d(["x"], ("a",))) == [] and quality.choose_key(d(["id"], ("a",)).limit(0)) == []
    t = d(["title", "标题", "link"], ("a", None, "1"), ("a", None, "2"), (None, "a", "1"), (None, None, " "), (" ", None, None))
    assert tuple(quality.duplicates_by(t, [["title", "标题"], ["link"]]).first()) == (1, 2)


@pytest.mark.parametrize("few", [3, 20_000])
def test_medians(spark, few):
    rng = random.Random(3)
    columns = {"a": [rng.gauss(0, 1) for _ in range(4001)], "b": [rng.randrange(3) for _ in range(4000)] + [None], "c": [None] * 4001, "d": [1.0] + [None] * 4000, "e": [1.0, 2.0] + [None] * 3999}
    df = spark.createDataFrame(list(zip(*columns.values())), "a double, b int, c double, d double, e double").repartition(3)
    got = quality.medians(df, {c: F.col(c) for c in columns}, few)
    assert got == {c: statistics.median([x for x in v if x is not None]) if any(x is not None for x in v) else None for c, v in columns.items()}
    assert quality.medians(df.limit(0), {"a": F.col("a")}) == {"a": None}
