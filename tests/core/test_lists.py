from gleanery import catalog_fields
from gleanery.functions import cjk, html
from gleanery.operators import name_list
from pyspark.sql import functions as F

HEAD = ["序号", "应用名称", "应用开发者", "版本", "版本 来源", "所涉问题"]


def test_chinese_numbers(spark):
    cases = {"一百零六": 106, "一百四十五": 145, "十": 10, "二十": 20, "两千零三": 2003, "一万二千": 12000, "": 0}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.n for r in df.select("s", cjk.chinese_int(F.col("s")).alias("n")).collect()} == cases


def test_stated_count(spark):
    cases = {
        "检查发现一百零六款APP存在问题。": 106,
        "尚有71款未整改，各管理局检查发现仍有74款。": 145,
        "对368款APP提出整改要求。目前尚有12款。": 12,
        "对上述共计106款APP进行下架；共发现3款": 3,
        "没有数字": None,
        "<p>通报<b>45</b>款</p>": 45,
        "发现9999款": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.n for r in df.select("s", cjk.stated_count(F.col("s")).alias("n")).collect()} == cases


def test_assemble(spark):
    doc1 = [HEAD, ["1", "甲", "甲公司", "1.0", "小米商店", "私自收集"], ["", "", "", "", "", "强制推送"], ["", "", "", "", "", "不给权限；定向推送"], ["2", "乙", "乙网络", "2.0", "应用宝", "超范围"], ["", "", "技术有限公司", "", "", ""], ["合计 41款", "", "", "", "", ""], ["（一）分节", "", "", "", "", ""], ["3", "丙", "丙公司", "", "", ""]]
    doc2 = [HEAD, ["", "甲", "甲公司", "1", "s", "x"], ["", "乙", "乙公司", "2", "s", "y"], HEAD, ["", "丙", "丙公司", "3", "s", "z"]]
    rows = [(d, i, c) for d, g in (("a", doc1), ("b", doc2)) for i, c in enumerate(g)] + [("c", 0, ["no", "header"]), ("d", 0, None)]
    grid = spark.createDataFrame(rows, "doc string, row_no int, cells array<string>")
    got = {(r.doc, r.record): r for r in name_list.assemble(grid).collect()}
    assert got["a", 1].issue_types == ["私自收集", "强制推送", "不给权限", "定向推送"] and got["a", 1].seq == 1 and got["a", 1].n_rows == 3
    assert got["a", 2].company_name == "乙网络技术有限公司" and got["a", 3].app_name == "丙"
    assert [got["b", i].app_name for i in (1, 2, 3)] == ["甲", "乙", "丙"] and len(got) == 6


def test_continuations_keep_the_space_between_latin_words(spark):
    rows = [HEAD, ["1", "甲", "co 7", "1.0", "s", "x"], ["", "", " ltd\n", "", "", ""], ["", "", "(a)", "", "", ""], ["2", "乙", "乙网络", "1. ", "s", "x"], ["", "", " 技术", "0", "", ""], ["3", "丙", "Net", "1", "s", "x"], ["", "", "work", "", "", ""]]
    grid = spark.createDataFrame([("a", i, c) for i, c in enumerate(rows)], "doc string, row_no int, cells array<string>")
    got = name_list.assemble(grid).orderBy("record").collect()
    assert [(r.company_name, r.version) for r in got] == [("co 7 ltd(a)", "1.0"), ("乙网络技术", "1.0"), ("Network", "1")]


def test_numbers_beyond_four_digits_begin_records(spark):
    rows = [HEAD, ["9999", "甲", "c", "1", "s", "x"], ["10000", "乙", "d", "1", "s", "y"], ["", "", "e", "", "", ""], ["123456", "丙", "f", "1", "s", "z"]]
    grid = spark.createDataFrame([("a", i, c) for i, c in enumerate(rows)], "doc string, row_no int, cells array<string>")
    got = name_list.assemble(grid).orderBy("record").collect()
    assert [(r.seq, r.app_name, r.company_name, r.issue_types) for r in got] == [(9999, "甲", "c", ["x"]), (10000, "乙", "de", ["y"]), (123456, "丙", "f", ["z"])]


def test_list_records_of_regions_of_one_name_and_of_equal_nations(spark, tmp_path):
    spark.createDataFrame([(1, "A", 0), (2, "B", 1), (3, "C", 1), (4, "D", 0), (4, "D", 0), (5, "E", 2)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "R"), (1, "R"), (2, "S")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got = sorted(tuple(r) for r in catalog_fields.list_records(spark, str(tmp_path)).collect())
    nations = [("R", 1, "A", 1), ("R", 1, "B", 2), ("R", 2, "C", 3), ("R", 2, "D", 4), ("R", 3, "D", 4), ("S", 1, "E", 5)]
    assert got == [(doc, seq, name, f"co {key} ltd", "first,second") for doc, seq, name, key in nations]


def test_merge_sources(spark):
    rows = [("d", 1, 1, "甲", "c", "1", "小米", ["a"]), ("d", 2, 1, "甲", "c", "2", "苹果", ["b", "a"]), ("d", 3, None, "乙", "e", "", "", ["x"]), ("d", 4, None, "乙", "e", "", "", ["y"]), ("d", 5, 3, "丙", "", "", "", [])]
    df = spark.createDataFrame(rows, "doc string, record int, seq int, app_name string, company_name string, version string, store_source string, issue_types array<string>")
    got = name_list.merge_sources(df).orderBy("app").collect()
    assert [(r.app_name, r.issue_types, [tuple(s) for s in r.alt_sources]) for r in got] == [("甲", ["a", "b"], [("c", "2", "苹果")]), ("乙", ["x", "y"], []), ("丙", [], [])]


def test_reading_order(spark):
    df = spark.createDataFrame([(1, 10.0, 100.0, "你"), (1, 30.0, 98.0, "好"), (1, 5.0, 50.0, "next"), (1, 40.0, 50.0, "line")], "doc int, x double, y double, text string")
    assert [r.text for r in name_list.reading_order(df, "doc").orderBy("line").collect()] == ["你好", "next line"]


def test_relocate(spark):
    old = html.parse('<div><h2 class="t" id="x">Title one</h2><p class="price">10</p></div>')
    known = html.fingerprint(next(n for n in old.walk() if n.tag == "p"))
    pages = spark.createDataFrame([(1, '<div><h2 class="t">Title two</h2><span>z</span><p class="price-now">12</p></div>'), (2, "<b>nothing</b>"), (3, None)], "id int, html string")
    got = html.relocate(pages, "html", known, ["id"], 55.0).collect()
    assert [(r.id, r.text) for r in got] == [(1, "12")]
    found = html.find_by_text(pages, "html", "Title", ["id"]).collect()
    assert [(r.tag, r.text) for r in found] == [("h2", "Title two")]
    root = html.parse(pages.first().html)
    assert [n.text() for n in html.select(root, html.compile_selector(found[0].selector))] == ["Title two"]
