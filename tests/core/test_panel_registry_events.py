"""Audits, reports, extensions and events on small fixtures."""

import pytest
from gleanery.operators import catalogue, panel, scripts
from gleanery.plans import infer, registry, spec
from gleanery.streaming import events, stateful
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeResult


def test_panel_rules(spark):
    rows = [
        ("000001", 2015, 10, "2015 年年度报告", "", 2, 400.0), ("000001", 2016, 12, "2015年年度报告", "", 2, 333.333), ("2.0", 2015, 5, None, "不可复现", 1, 400.0), ("000003", 2015, 40, "x", "", 0, 0.0),
        ("000004", 2015, 0, "", "", None, None), ("000004", 2015, 0, "", "", None, None),
    ]
    p = spark.createDataFrame(rows, "code string, year int, total int, title string, note string, count_k int, freq_k double")
    universe = spark.createDataFrame([("1.0", 2015, 2017), ("2", 2016, 2016), ("000003", 2015, 2015)], "code string, first_year int, last_year int")
    gaps = spark.createDataFrame([("1", 2017)], "code string, year int")
    texts = spark.createDataFrame([("000001", 2015, "kk" + "a" * 8), ("000001", 2016, "k" * 3 + "a" * 9), ("3", 2015, "國關於這時總運網發後來" + "a" * 29)], "code string, year int, text string")
    notes = spark.createDataFrame([("本表 6 行，1,000 家；2015年共 5 行；2016年 1 家；2014年 0 行；2013年 3 行",)], "text string")
    got = {tuple(r) for r in panel.audit(p, 2015, 2016, ["k"], {"k": ["k"]}, universe, gaps, texts, notes).collect()}
    assert got == {
        ("duplicate_key", "000004", 2015, ""), ("code_format", "2.0", 2015, ""), ("title_year", "000001", 2016, "2015"), ("outside_window", "000002", 2015, ""), ("outside_window", "000004", 2015, ""),
        ("missing_year", "000002", 2016, ""), ("recount", "000001", 2016, "k"), ("traditional_script", "000003", 2015, ""),
        ("note_claim", "", None, "1,000 家 / 4"), ("note_claim", "", None, "2013年 3 行 / 0"),
    }


def test_catalogue_report(spark):
    rows = [("a|b", "x", "1", "--"), ("a|b", "y", None, "2"), ("c", "x", "1", "2"), (None, "x", " ", "n/a")]
    df = spark.createDataFrame(rows, "maker string, kind string, title string, price string")
    n = catalogue.coverage(df, ["maker", "kind"], ["title", "price"], ["title"])
    got = {(r.level, r.maker, r.kind): (r.n_rows, r.filled_title, r.filled_price, r.required_missing_rate, r.missing_rate) for r in n.collect()}
    assert got[0, None, None] == (4, 2, 2, 0.5, 0.5) and got[1, "a|b", None] == (2, 1, 1, 0.5, 0.5) and got[1, None, None] == (1, 0, 0, 1.0, 1.0) and got[2, "c", "x"] == (1, 1, 1, 0.0, 0.0)
    assert len(got) == 8
    text = catalogue.report("Books", n, ["maker", "kind"], ["title", "price"], most=1, examples=df)
    assert "- required cells missing: 50.00%" in text and "| a\\|b | 2 | 50% | 50% |" in text and "(1 groups are shown)" in text and "| c | x | 1 | 2 |" in text
    assert catalogue.coverage(df.limit(0), [], ["title"], ["title"]).first().missing_rate == 0.0


def test_registry(spark):
    class Spread:
        """Columns follow from the argument."""

        @staticmethod
        def analyze(table, names):
            return AnalyzeResult(StructType().add("k", "string").add(names.value, "long"))

        def __init__(self):
            self.k, self.n = None, 0

        def eval(self, row, names):
            self.k, self.n = row["k"], self.n + row["n"]

        def terminate(self):
            yield self.k, self.n

    registry.step("twice", needs=["field"], replace=True)(lambda df, s, order: df.withColumn(s["field"], F.col(s["field"]) * 2))
    registry.table_step("total", Spread, needs=["args"], replace=True)
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n long")
    task = {"source": {"table": "t"}, "pipeline": [{"step": "twice", "field": "n"}, {"step": "total", "key": "k", "args": ["sum"]}]}
    got = spec.run(spark, task, {"t": df})
    assert got.columns == ["k", "sum"] and {tuple(r) for r in got.collect()} == {("a", 8), ("b", 4)}
    assert spec.faults({"source": {"table": "t"}, "pipeline": [{"step": "total"}, {"step": "twise"}]}) == [
        "step 1 (total): 'key' is missing", "step 1 (total): 'args' is missing", "step 2: unknown step 'twise'; did you mean 'twice'?",
    ]
    for wrong in (lambda: registry.step("filter")(lambda a, b, c: a), lambda: registry.step("twice")(lambda a, b, c: a)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(TypeError):
        registry.step("odd")(lambda df: df)
    with pytest.raises(TypeError):
        registry.table_step("odd", Spread, schema="k string")
    registry.remove("twice")
    registry.remove("total")
    assert "twice" not in spec.STEPS


def test_events_of_a_stream_that_fails(spark, tmp_path):
    spark.range(100).withColumn("ts", F.timestamp_seconds("id")).write.parquet(f"{tmp_path}/in")
    stream = stateful.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    with events.Log(spark, f"{tmp_path}/log", every=1) as log:
        stateful.run_now(stream.select("id"), name="good")
        with pytest.raises(Exception, match="bad row"):
            stateful.run_now(stream.select(F.when(F.col("id") == 7, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")).alias("id")), name="bad")
    rows = log.table().collect()
    runs = {r.name: r.run for r in rows if r.kind == "started"}
    assert sum(r.rows_in or 0 for r in rows if r.run == runs["good"]) == 100
    ends = {r.run: r.error for r in rows if r.kind == "ended"}
    assert ends[runs["good"]] is None and "bad row" in ends[runs["bad"]]


def test_scripts(spark):
    body = """const a=axios.create({headers:{x:1}, baseURL:'https://one.example/'}); b = axios.create({baseURL:"/two"});
      a.get('/list/:id', {params:{page:1}}); b.request("/list", {method:'x'}); c.post("/free",{q:1,q2:2}); a.get("/pic.png"); a.get("word"); fetch('https://abs.example/api'); a.get("/list/:id",{more:2});
      const routes=[{path:"/home"},{path:'/book/:id'},{path:"/x.js"}]"""
    df = spark.createDataFrame([(1, body), (2, "nothing"), (3, None), (4, 'a.get("/list/:id")')], "page long, body string")
    got = {(r.method, r.url): (list(r.params), r.n_scripts) for r in scripts.endpoints(df, ["page"]).collect()}
    assert got == {
        ("GET", "https://one.example/list/:id"): (["more", "page", "params"], 1), ("REQUEST", "/two/list"): (["method"], 1), ("POST", "/free"): (["q2"], 1),
        ("GET", "https://abs.example/api"): ([], 1), ("GET", "/list/:id"): ([], 1),
    }
    assert {r.route for r in scripts.routes(df, ["page"]).collect()} == {"/home", "/book/:id"}


def test_inferred_parameters(spark):
    rows = [(f"https://h/x?page={i}&size=20&start={i * 20}&sort=a{i}&one=7&odd={i * i}", "get", None, '{"data": {"list": [{"id": 1, "in": {"a": 2}}]}}') for i in (1, 2, 3, 5)]
    rows += [("https://h/y", "POST", f"currentPage={i}&w=b", "[{}]") for i in (2, 9)] + [("https://h/z#f", None, None, "no json"), ("https://h/one", "GET", None, '{"id": 5, "tags": [1]}')]
    df = spark.createDataFrame(rows, "url string, method string, post_data string, body string")
    got = {(r.endpoint, r.name): (r.kind, r.start, r.step, r.value) for r in infer.parameters(infer.requests(df)).collect()}
    assert got == {
        ("GET https://h/x", "page"): ("page", 1, 1, None), ("GET https://h/x", "size"): ("constant", None, None, "20"), ("GET https://h/x", "start"): ("key", None, None, None), ("GET https://h/x", "sort"): ("key", None, None, None),
        ("GET https://h/x", "one"): ("constant", None, None, "7"), ("GET https://h/x", "odd"): ("key", None, None, None), ("POST https://h/y", "body.currentPage"): ("page", 2, 7, None), ("POST https://h/y", "body.w"): ("constant", None, None, "b"),
    }
    found = infer.specifications(df)
    made, ask = found["GET https://h/x"]
    assert made["source"]["records_path"] == "data.list" and made["source"]["fields"] == {"id": "id", "in_a": "in.a"} and ask["paging"]["param"] == "page"
    assert found["GET https://h/z"][0] is None and found["GET https://h/one"][0]["source"]["fields"] == {"id": "id", "tags": "tags"}
