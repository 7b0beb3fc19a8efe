from gleanery.functions import columns as C
from gleanery.operators import report
from pyspark.sql import functions as F


def test_report(spark):
    df = spark.createDataFrame([("A", "12万", "<b>"), ("B", "30万", None), ("A", "5万", "")], "city string, n string, note string")
    page = report.profile_html(df, "city", "a<b")
    assert "a&lt;b" in page and "120000.0" in page and "<td>A</td>" in page
    assert report.missing_fields(df, "哪个日期，数量多少") == ["date", "count"] and report.missing_fields(df.withColumn("date", F.lit("2026")), "日期") == []
    assert report.with_hooks(df, [lambda d: d.where("city = 'A'"), lambda d: None]).count() == 2
    out, seen = report.observed(df, ["note"])
    out.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "filled_note": 1}


def test_json_union(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":"x"}'), (2, '{"c":null,"a":[1]}'), (3, "broken"), (4, None)], "i int, j string")
    assert report.all_keys(df, "j") == ["a", "b", "c"]
    got = {r.i: (r.b, r.c) for r in report.spread_json(df, "j", ["i"]).collect()}
    assert got == {1: ("x", None), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_watch_and_saturation(spark):
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "y"), (5, "x"), (6, "z")], "b int, k string")
    assert report.saturated(b, "b", "k") == 5 and report.saturated(b.where("b < 4"), "b", "k") is None
    told = []
    report.watch(b.where("b > 3"), b.where("b < 4").withColumn("k", F.when(F.col("b") == 2, "w").otherwise(F.col("k"))), "k", told.extend)
    assert told == [("added", "y"), ("added", "z"), ("removed", "w")]


def test_columns(spark):
    df = spark.createDataFrame([("https://a/b?x=1&y=2#f", "[t](u) [t](v) [s](u)", "2026-08-07T10:00:00", "<script>x</script><p>hi  there</p>")], "u string, m string, t string, h string")
    r = df.select(C.merge_query(F.col("u"), {"y": "a b", "z": "3"}).alias("u"), C.markdown_links(F.col("m")).alias("m"), C.parse_timestamp(F.col("t")).cast("string").alias("t"), C.plain_head(F.col("h")).alias("h"), C.relative_text(F.lit("昨天"), F.lit(1786347020)).alias("w")).first()
    assert tuple(r) == ("https://a/b?x=1&y=a+b&z=3", ["u", "v"], "2026-08-07 10:00:00", "hi there", "2026-08-09 00:00:00")
