import random

import pytest
from gleanery.functions import html
from gleanery.sources import io
from gleanery.streaming import stateful
from pyspark.sql import functions as F

PAGE = """<html><head><title>T &amp; t</title><script>var t="</p>"; window.article_list = [{"title":"a","read":1024,},]; const X = {"k":[1]};</script></head>
<body><!-- <p>no</p> --><div class="item big"><a class=t href='/a?x=1&amp;y=2'>Alpha</a> <span class="p">10</span></div>
<div class="item"><a class="t" href="b">Beta</a></div><div class="item"><b hidden>secret</b></div>
<p><b>one<br>two<p>three <ul><li>x<li>y</ul>
<table><tr><th>省份<th>城市<th>值<tr><td rowspan=2>A<td>x<td>1<tr><td>y<td>2</table>
<table><tr><th>省<th>市<th>值</tr><tr><td colspan=2>合计<td>9</tr></table>
<table><tr><th>k</th></tr><tr><td>X<table><tr><th>q</th></tr><tr><td>in</td></tr></table></td></tr></table>
<form action="/s" method="POST"><input name="q" value="v"><select name="z"></select></form></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "http://h/d/", PAGE), (2, "http://h/", None), (3, "http://h/", "")], "page_id long, url string, html string")


def test_rows_and_fields(pages):
    out = html.extract_rows(pages, "html", ".item", {"t": ".t::text", "p": ".p", "u": "a::attr(href)"}, ["page_id"]).collect()
    assert [(r.t, r.p, r.u) for r in out] == [("Alpha", "10", "/a?x=1&y=2"), ("Beta", "", "b")]
    f = {r.page_id: r for r in html.extract_fields(pages, "html", {"t": "title", "li": "ul > li", "n": "li:nth-child(2)", "m": "nosuch", "a": "a[href^='/a']"}, ["page_id"]).collect()}
    assert (f[1].t, f[1].li, f[1].n, f[1].m, f[1].a) == ("T & t", "x\ny", "y", "", "Alpha") and f[2].t == f[3].t == ""
    with pytest.raises(ValueError):
        html.compile_selector("a:has(b)")


def test_tables(pages):
    cells = html.extract_tables(pages, "html", ["page_id"]).collect()
    got = {(r.table_no, r.row_no, r.col_name): r.value for r in cells}
    assert got[0, 1, "省份"] == "A" and got[0, 1, "城市"] == "y" and got[0, 1, "值"] == "2"
    assert got[1, 0, "省"] == "合计" and got[1, 0, "市"] == "" and got[1, 0, "值"] == "9"
    assert got[2, 0, "k"] == "X" and got[3, 0, "q"] == "in"


def test_other_extractors(pages):
    assert [r.json for r in html.extract_embedded(pages, "html", "article_list", ["page_id"]).collect()] == ['[{"title":"a","read":1024}]']
    assert html.embedded_json("if (X == {}) X = {'a':1}; var Y = [];", "X") == "{'a':1}" and html.embedded_json("var Y = [];", "Y") is None
    md = html.extract_markdown(pages, "html", ["page_id"]).where("page_id = 1").first().markdown
    assert "[Alpha](/a?x=1&y=2)" in md and "- x\n- y" in md and "| 省份 | 城市 | 值 |" in md and "secret" not in md and "article_list" not in md
    assert {(r.name, r.type, r.action, r.method) for r in html.extract_forms(pages, "html", ["page_id"]).collect()} == {("q", "input", "/s", "post"), ("z", "select", "/s", "post")}
    links = {(r.page_id, r.link) for r in io.page_links(pages, "html", "url", ["page_id"]).collect()}
    assert links == {(1, "http://h/a?x=1&y=2"), (1, "http://h/d/b")}


def test_random_markup_never_fails():
    rng = random.Random(9)
    bits = ["<p>", "</p>", "<td", "<tr>", "<table>", "</table>", "<li>", "&amp;", "&#x", "<!--", "-->", "<script>", "</script>", "text", "<a href=", "'", '"', ">", "<b/>", "\x00"]
    for _ in range(300):
        root = html.parse("".join(rng.choice(bits) for _ in range(40)))
        html.tables(root), html.markdown(root), root.text(), html.article(root)


def test_decode():
    assert io.decode_bytes("汉字".encode("gb18030")) == "汉字" and io.decode_bytes(b"\xef\xbb\xbfx") == "x" and io.decode_bytes(None) is None
    assert io.decode_bytes("é".encode("latin-1"), "text/html; charset=iso-8859-1") == "é"


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data":[{"x":1},{"x":2}]}')
    assert io.read_records(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "g.csv").write_bytes("城市,值\n广州,1\n".encode("gbk"))
    assert io.read_csv(spark, str(tmp_path / "g.csv")).first().城市 == "广州"
    df = spark.createDataFrame([("=x", [1], None), ("-3.5", [], 2)], "a string, b array<int>, c int")
    io.write_csv(df, str(tmp_path / "out"))
    assert {r.a for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()} == {"'=x", "-3.5"}
    io.write_parquet(df, str(tmp_path / "p"), all_text=True)
    assert set(dict(spark.read.parquet(str(tmp_path / "p")).dtypes).values()) == {"string"}
    new = spark.createDataFrame([("u", "body"), ("u", "body"), ("v", "x")], "url string, body string")
    assert io.write_snapshot(new, str(tmp_path / "s")).count() == 2 and io.write_snapshot(new, str(tmp_path / "s")).count() == 0
    lines = spark.createDataFrame([('var hq_str_sh1="A,1,2";\nvar hq_str_sz2="B,3";\njunk',)], "t string")
    assert [(r.key, r.n, r.p) for r in io.delimited_lines(lines, "t", r'var hq_str_(\w+)="([^"]*)"', ["n", "o", "p"]).collect()] == [("sh1", "A", "2"), ("sz2", "B", None)]
    maps = spark.createDataFrame([("i", "<loc>m1</loc><loc> m2 </loc>"), ("m1", "<loc>p1</loc>"), ("m2", "<loc>p2</loc><loc>i</loc>")], "url string, body string")
    assert {r.url for r in io.expand_sitemaps(maps, ["i"]).collect()} == {"p1", "p2"}


def run_stream(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(400).cache()
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = io_stream = stateful.file_stream(spark, str(tmp_path / "in"), batch.schema)
    got = run_stream(stateful.dedup_stream(stream, ["user_id", "event_type"], delay="60 days").select("user_id", "event_type"), tmp_path, "d", "append")
    assert len(got) == batch.select("user_id", "event_type").distinct().count()
    got = run_stream(stateful.tumbling(io_stream, ["event_type"]), tmp_path, "w", "complete")
    want = batch.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"), "event_type").count().collect()
    assert {(r.window_start, r.event_type, r.n) for r in got} == {(r.d, r.event_type, r["count"]) for r in want}
    timed = io_stream.select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("s"))
    got = run_stream(stateful.admission_stream(timed, "user_id", "s", 2, 86_400), tmp_path, "a", "append")
    plain = batch.select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("s"))
    out = stateful.admission(plain, "user_id", ["s", "event_id"], "s", 2, 86_400).collect()
    assert sum(r.admitted + r.denied for r in got) == len(out) == batch.count()
    assert sum(r.admitted for r in got) == sum(r.admitted for r in out)
    kinds = io_stream.select("user_id", "event_id", F.when(F.col("event_type") == "error", "blocked").otherwise("ok").alias("kind"))
    got = run_stream(stateful.adaptive_interval_stream(kinds, "user_id", "event_id", "kind"), tmp_path, "i", "append")
    assert got and all(1.0 <= r.interval <= 8.0 for r in got)


def test_admit_by_hand():
    ok, held = stateful.admit([0, 1, 2, 10, 10.5], [1] * 5, [], 2, 10)
    assert ok == [True, True, False, True, False] and held == [(1, 1), (10, 1)]
