import json

from gleanery.functions import html, pages
from gleanery.operators import grids
from pyspark.sql import functions as F

LONG = "a long text about the river and the mill " * 10
PAGE = f"""<html><head><title>T</title></head><body><nav><a href="/x">menu</a></nav>
<div style="display: none">{LONG * 3}</div><div class="side"><p>{"short words here " * 5}</p></div>
<article><h1>Head</h1><p>{LONG}</p><p>end</p></article></body></html>"""


def test_main_content(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>x</p>")], "id long, html string")
    got = {r.id: r for r in pages.extract_main(df, "html", ["id"]).collect()}
    assert got[1].main_text.startswith("Head a long text") and "menu" not in got[1].main_html and "short" not in got[1].main_text
    assert got[2].main_text == "" and got[3].main_text == "x"
    text = {r.id: r.markdown for r in pages.extract_safe_markdown(df, "html", ["id"]).collect()}
    assert text[1].startswith("# Head\n\na long text") and text[1].endswith("end") and text[2] == ""


def test_sites(spark):
    rows = [(1, "a.org", "<li>one</li><li> </li><li>two</li>"), (2, "b.com", "<h1>head</h1>"), (3, "c.net", "<h1>no</h1>"), (4, "a.org", None)]
    df = spark.createDataFrame(rows, "id long, host string, html string")
    sites = {"org": {"host": r"\.org$", "row": "li", "fields": {"t": "::text"}}, "com": {"host": r"\.com$", "row": "h1", "fields": {"t": "::text"}}}
    got = pages.extract_by_site(df, "html", F.col("host"), sites, ["t", "u"], ["id"]).collect()
    assert sorted((r.id, r._site, r.t, r.u) for r in got) == [(1, "org", "one", ""), (1, "org", "two", ""), (2, "com", "head", "")]


def test_rescue_and_similar(spark):
    old = html.parse('<div><span class="price">12</span></div>')
    known = {"price": html.fingerprint(html.select(old, html.compile_any(".price"))[0])}
    df = spark.createDataFrame([(1, '<div><span class="price">9</span></div>'), (2, '<div><span class="prize">8</span></div>'), (3, "<table></table>"), (4, None)], "id long, html string")
    got = {r.id: (r.price, r.price_action) for r in pages.rescue_fields(df, "html", {"price": ".price"}, known, ["id"], 50).collect()}
    assert got == {1: ("9", "kept"), 2: ("8", "rescued"), 3: ("", "none"), 4: ("", "none")}
    rows = spark.createDataFrame([(1, "<ul><li class=a>x</li><li class=a>y</li></ul><h1>z</h1>")], "id long, html string")
    like = pages.find_similar(rows, "html", "li", ["id"], 80).collect()
    assert [(r.tag, r.text, r.is_sibling, r.ancestors) for r in like] == [("li", "y", True, "ul")]


def test_attachments(spark):
    body = """<a href="/v/viewer.html?file=/d/a.pdf&x=1">v</a><a href='b.docx'>b</a><a href="/attach/99">c</a><a href="/files/m.css">d</a><a href="b.docx">b</a><img src="/picture/p.png">"""
    df = spark.createDataFrame([(body, "http://h.cn/p/q.html"), (None, "http://h.cn/")], "html string, url string")
    files, images = pages.attachment_targets(F.col("html"), F.col("url"))
    got = df.select(files.alias("f"), images.alias("i")).collect()
    assert got[0].f == ["http://h.cn/d/a.pdf", "http://h.cn/p/b.docx", "http://h.cn/attach/99"] and got[0].i == ["http://h.cn/picture/p.png"]
    assert not got[1].f and not got[1].i


def test_records_path():
    row = [{"a": 1}]
    cases = {"data.rows": {"data": {"rows": row}}, ".": row, "list": {"data": [], "list": row}, "data": {"data": []}, "odd": {"odd": row, "n": 1}, "": {"a": 1}, "result.items": {"data": {"rows": []}, "result": {"items": row}}}
    for want, value in cases.items():
        assert pages.records_path(value) == want
    assert [pages.records_path(x) for x in (None, 3, "x", [], {})] == ["", "", "", ".", ""]


def test_repair():
    text = '{"a": undefined, "b": new Set([1,2,]), "c": "NaN, ] new Set()", "d": new Map(), "e": -Infinity, "f": [NaN,],}'
    assert json.loads(html.repaired(text)) == {"a": None, "b": [1, 2], "c": "NaN, ] new Set()", "d": [], "e": None, "f": [None]}
    assert json.loads(html.embedded_json(f"<script>window.S = {text};</script>", "S"))["b"] == [1, 2]


def test_cells(spark):
    df = spark.createDataFrame([("a\n b　c",), ("x\n《y\n【z；",), (None,), (" one ",)], "c string")
    got = df.select(grids.clean_cell(F.col("c")), grids.clean_cell(F.col("c"), "实施部门"), grids.clean_cell(F.col("c"), "", True)).collect()
    assert [tuple(r) for r in got] == [("ab c", "a、b c", "ab c"), ("x；《y；【z", "x、《y、【z；", "x《y【z；"), ("", "", ""), ("one", "one", "one")]
    heads = spark.createDataFrame([(["序号", "名称"],), (["序号", "x"],), (["项目", "内容"],), (["序号", "《名称》"],), ([None, "名称"],), (None,)], "c array<string>")
    assert [r[0] for r in heads.select(F.coalesce(grids.is_header(F.col("c")), F.lit(False))).collect()] == [True, False, False, False, False, False]


def test_merge_columns(spark):
    assert grids.merge_plan([0, 3, 1, 3], None, 2) == [0, 0, 1, 1] and grids.merge_plan([5, 0], None, 9) == [0, 0]
    assert grids.merge_plan([0, 0, 0], ["a", "b", "b"], 1) == [0, 1, 1] and grids.merge_plan([1], None, 1) == [0]
    rows = [("t", ["a", None, "1"]), ("t", ["b", "c", "2"]), ("t", ["d"]), ("u", ["x", "y"]), ("u", None), (None, [" ", "q"]), ("v", [])]
    df = spark.createDataFrame(rows, "k string, cells array<string>")
    got = grids.merge_sparse_columns(df, "k", "cells", 1).collect()
    want = [("t", ["a", "1"]), ("t", ["b c", "2"]), ("t", ["d"]), ("u", ["x y"]), ("u", None), ("v", [])]
    assert sorted(((r.k, r.cells) for r in got if r.k), key=str) == sorted(want, key=str) and len(got) == len(rows)


def test_declared(spark):
    rows = [("a", "1", None), ("a", "", "x"), ("b", None, None), ("c", "1", "1"), (None, "1", "")]
    df = spark.createDataFrame(rows, "s string, x string, y string")
    declared = spark.createDataFrame([("a", ["x"]), ("b", []), ("d", None)], "s string, columns array<string>")
    r = grids.declared_completeness(df, declared, "s", ["x", "y"]).first()
    assert (r.checked, r.missing, r.rate, r.sources_unreadable) == (8, 4, 50.0, 1)
    r = grids.declared_completeness(df.limit(0), declared, "s", ["x", "y"]).first()
    assert (r.checked, r.missing, r.rate) == (0, 0, None)
    files = spark.createDataFrame([("p",)], "f string")
    assert [r.f for r in grids.missing_references(spark.createDataFrame([("p",), ("q",), ("q",), (None,)], "f string"), files, "f").collect()] == ["q"]
