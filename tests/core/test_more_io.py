import json
import zipfile

import pytest
from gleanery.functions import html
from gleanery.sources import io
from pyspark.sql import functions as F


def test_xpath(spark):
    page = "<div class='a b'><p>one<p>two</div><ul><li id=x>1<li><a href=/z>2</a></ul>"
    df = spark.createDataFrame([(1, page)], "i int, html string")
    fields = {"p2": "//div/p[2]/text()", "x": "//li[@id='x']", "href": "//ul//a/@href", "c": "//div[contains(@class,'b')]/p[1]", "none": "//table//td"}
    r = html.extract_fields(df, "html", fields, ["i"]).first()
    assert (r.p2, r.x, r.href, r.c, r.none) == ("two", "1", "/z", "one", "")
    with pytest.raises(ValueError):
        html.compile_xpath("//a[last()]")


def test_guess(spark):
    page = '<meta property="article:published_time" content="2026-08-07"><h1 class="job-title">T</h1><b class="salary">9k</b><ul class="tag-list"><li>a<li>b</ul><a href="/u">x</a>'
    r = html.guess_fields(spark.createDataFrame([(1, page)], "i int, html string"), "html", ["title", "price", "publish_date", "tags", "link", "author"], ["i"]).first()
    assert tuple(r)[1:] == ("T", "9k", "2026-08-07", "a、b", "/u", "")


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>名称</t></si><si><r><t>x</t></r><r><t>y</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>值</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>3.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    got = [(r.row_no, r.cells) for r in io.read_xlsx(spark, str(tmp_path)).orderBy("row_no").collect()]
    assert got == [(0, ["名称", "", "值"]), (1, ["xy", "", "3.5"])]
    (tmp_path / "c.xlsx").write_bytes(b"broken")
    assert sorted(r.copies for r in io.distinct_files(spark, str(tmp_path)).collect()) == [1, 2]


def test_small_scans(spark):
    x = spark.createDataFrame([(1, '<d p="1.5,1,25,16777215,0">hi</d><d p="2,4,25,255">yo</d>', json.dumps({"features": [{"properties": {"place": "A", "time": 1700000000000}, "geometry": {"coordinates": [1.5, 2, 3]}}]}))], "i int, xml string, j string")
    assert [(r.second, r.mode, r.text) for r in io.danmaku_rows(x, "xml", ["i"]).collect()] == [(1.5, 1, "hi"), (2.0, 4, "yo")]
    f = io.feature_rows(x, "j", ["place"], ["time"]).first()
    assert (f.place, f.time, f.lon, f.depth) == ("A", "2023-11-15 06:13:20", 1.5, 3.0)
    s = spark.createDataFrame([(1, "axios.get('/api/list?x'); post(\"/v2/save\"); u = `/api/list`;"), (2, None)], "i int, t string")
    assert {(r.method, r.path) for r in io.api_paths(s, "t", ["i"]).collect()} == {("GET", "/api/list"), ("POST", "/v2/save"), ("", "/api/list")}
    o = spark.createDataFrame([(1, '{"a":[{"id":1,"n":"x"},{"id":2}],"b":{"c":{"id":3,"n":"y"}}}'), (2, "broken"), (3, None)], "i int, j string")
    assert [json.loads(r.object)["id"] for r in io.find_objects(o, "j", ["id", "n"], ["i"]).collect()] == [1, 3]
    p = spark.createDataFrame([(1, 45), (2, 45)], "page int, total int")
    assert [(r.page, r.offset) for r in io.next_requests(p, "page", 20, "total").collect()] == [(3, 40)]
    assert io.next_requests(p.where("page > 5"), "page", 20, "total").count() == 0
    both = spark.createDataFrame([(1, b"\xba\xba"), (2, None)], "i int, b binary").select(io.decoded(F.col("b")).alias("t")).collect()
    assert [r.t for r in both] == ["汉", None]


def test_growing_table_and_guessed_path(spark, tmp_path):
    io.append_rows(spark.createDataFrame([(1, "x")], "a long, b string"), f"{tmp_path}/t")
    io.append_rows(spark.createDataFrame([(2, 0.5)], "a long, c double"), f"{tmp_path}/t")
    assert sorted(map(str, io.read_grown(spark, f"{tmp_path}/t").select("a", "b", "c").collect())) == ["Row(a=1, b='x', c=None)", "Row(a=2, b=None, c=0.5)"]
    docs = spark.createDataFrame([(None,), ("no json",), ('{"data": {"rows": [{"x": 1}]}}',)], "j string")
    assert io.guessed_records_path(docs, "j") == "data.rows" and io.guessed_records_path(docs.limit(0), "j") == ""
