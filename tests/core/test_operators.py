import datetime as dt
import random

import pytest
from gleanery.operators import health, quality, relational, rows
from gleanery.plans import spec
from pyspark.sql import functions as F

ROWS = [("x", "美食测评", "50", "1,234"), ("  ", "旅游攻略", "200", "nan"), (None, "美食", "约50", "0"), ("a", "z", "100", None), ("a", "z", "10", "")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i long, title string, cat string, price string, read string")


def ids(d):
    return sorted(r.i for r in d.collect())


def test_filters(df):
    assert ids(rows.filter_rows(df, "title", "non_empty")) == [0, 3, 4]
    assert ids(rows.filter_rows(df, "cat", "contains", "美食")) == [0, 2]
    assert ids(rows.filter_rows(df, "price", "between", low=10, high=100)) == [0, 2, 4]
    assert ids(rows.filter_rows(df, "read", "between", low=1)) == [0, 1, 3, 4]
    assert ids(rows.filter_rows(df, "title", "not_contains", "")) == [0, 1, 2, 3, 4]
    assert ids(rows.filter_rows(df, "title", "eq", "")) == [2]
    assert ids(rows.filter_rows(df, "title", "regex", "(a+)+$")) == [0, 1, 2, 3, 4]  # refused pattern: the step is skipped
    assert ids(rows.validate_rows(df, "price", required=True, kind="int")) == [0, 1, 3, 4]
    assert ids(rows.filter_rows(df, "nosuch", "eq", "1")) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="unknown filter op"):
        rows.filter_rows(df, "title", "like", "x")


def test_steps(df):
    out = rows.cast(df, "read", "int").orderBy("i").collect()
    assert [r.read for r in out] == [1234, None, 0, None, None] and [r.read__cast_error for r in out] == [False, True, False, False, True]
    out = rows.rename(df, {"title": "cat"})
    assert out.columns == ["i", "cat", "price", "read"]
    assert [r.title for r in rows.fill_default(df, "title", "none").orderBy("i").collect()] == ["x", "  ", "none", "a", "a"]
    assert [r.w for r in rows.split_field(df.withColumn("p", F.lit(" a,,b ")), "p", ",", "w").collect()][0] == ["a", "b"]
    out = rows.map_record(df, {"t": "title", "c": {"constant": 1}, "l": {"template": "{cat}/{title}/{no}"}, "m": {"from": "nosuch", "default": "d"}}, keep_raw=True)
    r = out.where("raw_i = 2").first()
    assert (r.t, r.c, r.l, r.m) == (None, 1, "美食//{no}", "d")
    assert rows.regex_extract(df, "price", r"(\d)0", 1, "d").orderBy("i").first().d == "5"
    assert rows.dedup_names(["a", "", "a", None]) == ["a", "col2", "a_2", "col4"]
    assert rows.fuzzy_names(["应用名称", "版本号"], ["版本", "名称"]) == {"应用名称": "名称", "版本号": "版本"}


def test_dedup(spark, df):
    d = relational.dedup(df, ["title"], ["i"])
    assert ids(d) == [0, 1, 2, 3]
    assert ids(relational.dedup(d, ["title"], ["i"])) == [0, 1, 2, 3]  # a second step has its own memory
    zero = spark.createDataFrame([(1, 0), (2, 0), (3, None)], "i long, k int")
    assert ids(relational.dedup(zero, ["k"], ["i"])) == [1, 3]
    assert ids(relational.dedup_content(df.select("i", "title", "cat"), ["title", "cat"], ["i"])) == [0, 1, 2, 3]
    assert relational.dedup(df.limit(0), ["title"], ["i"]).count() == 0


def test_similar_sets(spark):
    rng = random.Random(1)
    sets = [(i, [str(rng.randrange(30)) for _ in range(rng.randrange(1, 15))]) for i in range(80)]
    sets += [(100 + i, sets[i][1] + ["extra"] * (i % 2)) for i in range(40)] + [(200, []), (201, None)]
    got = {(r.a, r.b): r.overlap for r in relational.similar_sets(spark.createDataFrame(sets, "k long, t array<string>"), "k", "t", 0.7).collect()}
    classes = {}
    for k, t in sets:
        if t:
            s = frozenset(t)
            classes[s] = min(k, classes.get(s, k))
    want = {}
    for s, a in classes.items():
        for t, b in classes.items():
            if a < b and len(s & t) >= 0.7 * max(len(s), len(t)):
                want[a, b] = len(s & t)
    assert got == want and want


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = {r.node: r.depth for r in relational.reachable_nodes(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_robots(spark):
    urls = spark.createDataFrame([("http://h/p2.html",), ("http://h/p1.html",), ("http://h/p2/ok",), ("http://other/x",), ("http://h/a.pdf",)], "url string")
    rules = spark.createDataFrame([("h", "/p2", False), ("h", "/p2/ok", True), ("h", "/*.pdf$", False)], "host string, pattern string, allow boolean")
    assert {r.url[-6:]: r.allowed for r in rows.robots_allowed(urls, rules).collect()} == {"2.html": False, "1.html": True, "/p2/ok": True, "ther/x": True, "/a.pdf": False}


def test_health(spark):
    def at(d):
        return dt.datetime(2026, 1, d)

    ledger = []
    for source, counts in {"drop": [1000] * 10 + [200], "spike": [1000] * 10 + [5000], "zero": [100] * 5 + [0], "zero_ok": [100] * 5 + [0], "first": [5], "none": [100] * 3 + [None]}.items():
        ledger += [(source, at(i + 1), c, "ok") for i, c in enumerate(counts)]
    ledger += [("blocked", at(1), 100, "ok"), ("blocked", at(2), 100, "blocked"), ("old", at(1), 10, "ok"), ("old", at(2), 10, "ok")]
    led = spark.createDataFrame(ledger, "source string, at timestamp, count long, status string")
    reg = spark.createDataFrame([("never", 24.0, None, at(1)), ("zero_ok", None, True, at(1)), ("old", 1.0, None, at(1))], "source string, expect_interval_h double, allow_empty boolean, registered_at timestamp")
    got = {r.source: r.verdict for r in health.verdicts(led, reg, F.lit(at(20))).collect()}
    assert got == {"drop": "volume_drop", "spike": "volume_spike", "zero": "empty_suspicious", "zero_ok": "ok", "first": "no_baseline", "none": "no_count", "blocked": "failing", "old": "stale", "never": "no_record"}
    base = health.baseline(spark.createDataFrame([("s", at(i + 1), i + 1, "ok") for i in range(25)], "source string, at timestamp, count long, status string")).first()
    assert (base.n, base.median, base.p10, base.p90, base.last_count) == (20, 15.5, 7.0, 24.0, 25.0)


def test_quality(spark, df):
    got = {r.column: (r.filled, r["pass"]) for r in quality.completeness(df, ["title", "cat"], ["title"]).collect()}
    assert got == {"title": (3, False), "cat": (5, True)}
    assert quality.numeric_columns(spark.createDataFrame([("A", "12万", "处理组", "2020"), ("B", "30万", "x", "2021"), ("C", "5万", "y", "2022")], "`城市` string, `机架` string, `组别` string, `年份` string")) == ["机架"]
    text = "short. 这是一句包含关键词的完整句子。这是一句包含关键词的完整句子！另外一句没有那个词的句子。"
    d = spark.createDataFrame([(1, text)], "i long, t string")
    assert quality.key_sentences(d, "i", "t", ["关键词"]).first().key_sentences == "short. 这是一句包含关键词的完整句子 || 这是一句包含关键词的完整句子"
    assert {r.pattern: r.n for r in quality.log_pattern_counts(d, "t", ["关键词", "zz"]).collect()} == {"关键词": 2, "zz": 0}
    h = quality.histogram(spark.createDataFrame([(float(x),) for x in [0, 1, 5, 10, 10]], "x double"), F.col("x")).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in h] == [(0, 1), (1, 1), (5, 1), (9, 2)]
    assert quality.pii_findings(["身份证号", "邮箱", "价格"]) == {"身份证号": "red", "邮箱": "amber"}
    cells = spark.createDataFrame([(1, None, "h", 0), (1, "a", "x", 1), (1, "", "y", 2), (1, "b", "z", 3), (1, " ", "w", 4)], "doc long, seq string, v string, row_no int")
    out = quality.attach_continuations(cells, ["doc"], "row_no", F.col("seq").rlike(r"\S"), "v").orderBy("record").collect()
    assert [r.collected for r in out] == [["x", "y"], ["z", "w"]]
    assert [r.seq for r in quality.inherit_blanks(cells, ["doc"], ["row_no"], ["seq"]).orderBy("row_no").collect()] == [None, "a", "a", "b", "b"]


def test_spec(spark, df):
    bad = {"source": {"kind": "htm_rows"}, "pipline": [], "pipeline": [{"step": "filtr"}, {"step": "cast", "field": "x"}, {"step": "filter", "field": "x", "op": "regex", "value": "(a+)+"}]}
    wrong = spec.faults(bad)
    assert len(wrong) == 6 and any("did you mean 'filter'" in w for w in wrong)
    with pytest.raises(ValueError):
        spec.run(spark, bad, {})
    task = {
        "source": {"table": "t", "kind": "json", "column": "body", "records_path": "data.list", "fields": {"name": "name", "n": "n"}},
        "pipeline": [{"step": "cast", "field": "n", "to": "int"}, {"step": "filter", "field": "n", "op": "between", "min": 2}, {"step": "dedup", "key": "name"}, {"step": "add", "field": "k", "value": 1}],
        "order": ["n"],
    }
    t = spark.createDataFrame([(1, '{"data":{"list":[{"name":"A","n":1},{"name":"B","n":"2"},{"name":"B","n":3}]}}'), (2, "broken"), (3, None)], "id long, body string")
    out = spec.run(spark, task, {"t": t}).collect()
    assert [(r.id, r.name, r.n, r.k) for r in out] == [(1, "B", 2, 1)]
    atoms = [None, True, 0, -1, 3.14, "", "null", 10**20, "inf", "nan", "x" * 300]
    fuzz = spark.createDataFrame([(i, None if a is None else str(a)) for i, a in enumerate(atoms)], "i long, v string")
    steps = [{"step": "cast", "field": "v", "to": k} for k in ("float", "str", "int")] + [{"step": "split", "field": "w"}, {"step": "parse_date", "field": "d", "now": 0}, {"step": "regex_extract", "field": "e", "pattern": r"(\d)"}, {"step": "template", "field": "f", "template": "{v}"}]
    fuzz = fuzz.select("i", "v", *[F.col("v").alias(c) for c in "wdef"])
    assert spec.run(spark, {"source": {"table": "f"}, "pipeline": steps, "order": ["i"]}, {"f": fuzz}).count() == len(atoms)
