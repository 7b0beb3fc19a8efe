"""Registered queries of patterns, many files, captures, scripts, exports and streams, each with its SQL."""

from __future__ import annotations

import gzip
import io as bytesio
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.catalog import query
from gleanery.functions import columns as C
from gleanery.operators import catalogue, diagnosis, panel, rows, scripts
from gleanery.plans import infer, registry, spec
from gleanery.session import cut_lineage, shared_folder, table
from gleanery.sources import io, many_files, workbook
from gleanery.streaming import events, stateful, timed

# patterns

#: Patterns around a brand's text, by the part's size: (pattern, growth, power, engine).
SHAPES = [
    ("^%[0-9]{1,3}$", "linear", 1, "jvm"), ("%(a+)+!", "exponential", 0, "none"), (r"\w+%", "polynomial", 2, "re2"), (r"%.*x.*y.*z", "polynomial", 4, "re2"), (r"(?:%|ab)+$", "polynomial", 2, "re2"),
    (r"(?:\d{1,4}\.?)+%", "exponential", 0, "none"), (r"(\d{1,3}\.){3}%", "linear", 1, "jvm"), ("(%", "invalid", 0, "none"), (r"(?=%)\w", "unproven", 0, "none"), (r"(\w+){5}%", "exponential", 0, "none"),
    (r"%[a-z]+ [a-z]+$", "linear", 1, "jvm"), (r"(?:a{1,30}){1,30}%", "exponential", 0, "none"),
]


def _case(i: int) -> str:
    return "CASE p_size % 12 " + " ".join(f"WHEN {n} THEN {shape[i]!r}" for n, shape in enumerate(SHAPES)) + " END"


@query(f"SELECT p_partkey, {_case(1)} AS pattern_growth, {_case(2)}::INTEGER AS pattern_power, {_case(3)} AS pattern_engine FROM part")
def pattern_verdicts(spark, sf_dir):
    shape = F.element_at(F.array(*[F.lit(p) for p, *_ in SHAPES]), (F.col("p_size") % 12 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.replace(shape, F.lit("%"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")).alias("pattern"))
    return rows.pattern_growth(p, "pattern").drop("pattern")


@query(r"SELECT doc_id, regexp_extract(text, '(\w+)@(\w+)\.\w+', 2) AS host FROM documents WHERE regexp_matches(text, '\w+ .*under .*[A-Z]+') OR regexp_matches(text, '\w+@\w+\.\w+')")
def search_in_linear_time(spark, sf_dir):
    """Patterns that a backtracking engine needs polynomial time for, over whole texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.where(rows.matches("text", "regex", r"\w+ .*under .*[A-Z]+") | rows.matches("text", "regex", r"\w+@\w+\.\w+"))
    found = rows.regex_extract(d, "text", r"(\w+)@(\w+)\.\w+", 2, "host")
    return found.select("doc_id", F.coalesce("host", F.lit("")).alias("host"))


# streams with timers

#: The last two sources in ten fall silent on the 15th; the clock's row is an hour, the watermark's delay, past the end of the month.
RUNS = """WITH ledger AS (SELECT event_type || '-' || user_id % 10 AS source, date_trunc('day', ts) AS d_at, count(*) AS count, CASE WHEN (day(ts) + user_id % 10) % 9 = 0 THEN 'error' ELSE 'ok' END AS status
    FROM events WHERE user_id % 10 < 8 OR day(ts) < 15 GROUP BY 1, 2, 4)
"""


def _run_files(spark, sf_dir):
    """The ledger of runs as files in order of time, read as a stream a few at a time."""
    k = F.col("user_id") % 10
    e = table(spark, sf_dir, "events").where((k < 8) | (F.dayofmonth("ts") < 15))
    status = F.when((F.dayofmonth("ts") + k) % 9 == 0, "error").otherwise("ok")
    runs = e.groupBy(F.concat("event_type", F.lit("-"), k.cast("string")).alias("source"), F.date_trunc("day", "ts").cast("timestamp").alias("at"), status.alias("status")).agg(F.count("*").alias("count"))
    clock = table(spark, sf_dir, "region").limit(1).select(F.lit(None).cast("string").alias("source"), F.lit("2024-02-01 01:00:00").cast("timestamp").alias("at"), F.lit("ok").alias("status"), F.lit(0).cast("bigint").alias("count"))
    return stateful.replayed(runs.unionByName(clock), "at", 6)


@query(
    RUNS
    + """, last AS (SELECT source, arg_max(count, d_at) AS c, arg_max(status, d_at) AS st, max(d_at) AS d_at FROM ledger GROUP BY source),
    three AS (SELECT source, count(*) FILTER (status <> 'ok') AS bad FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d_at DESC) AS i FROM ledger) WHERE i <= 3 GROUP BY source),
    h AS (SELECT l.source, l.count, row_number() OVER (PARTITION BY l.source ORDER BY l.d_at DESC) AS i FROM ledger l JOIN last USING (source) WHERE l.d_at < last.d_at AND l.status = 'ok'),
    b AS (SELECT source, count(*) AS n, median(count)::DOUBLE AS median FROM h WHERE i <= 20 GROUP BY source)
    SELECT source, CASE WHEN st <> 'ok' OR bad >= 3 THEN 'failing' WHEN epoch(TIMESTAMP '2024-02-01') - epoch(d_at) > 2 * 72 * 3600 THEN 'stale' WHEN c = 0 THEN 'empty_suspicious'
      WHEN c < 0.5 * median THEN 'volume_drop' WHEN c > 2 * median THEN 'volume_spike' WHEN b.n IS NULL THEN 'no_baseline' ELSE 'ok' END AS verdict,
      coalesce(b.n, 0) AS history, median, c::DOUBLE AS count FROM last JOIN three USING (source) LEFT JOIN b USING (source)"""
)
def stream_health(spark, sf_dir):
    """The last verdict that a stream of runs gives on each source; silence gives one too."""
    told = stateful.run_now(timed.health_stream(_run_files(spark, sf_dir), expect_hours=72))
    last = told.groupBy("source").agg(F.max_by(F.struct("verdict", "history", "median", "count"), "at").alias("last"))
    return last.select("source", "last.*")


@query(
    """SELECT user_id, event_type, ts FROM (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events WHERE ts < TIMESTAMP '2024-02-05')
    WHERE before IS NULL OR ts - before > INTERVAL 24 HOUR"""
)
def stream_first_seen(spark, sf_dir):
    """Keys that come back after a day of silence count as new; state is kept for a day."""
    e = table(spark, sf_dir, "events").where("ts < timestamp '2024-02-05'").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    clock = table(spark, sf_dir, "region").limit(1).select(F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), F.lit("clock").alias("event_type"), F.lit("2024-02-09").cast("timestamp").alias("ts"))
    out = stateful.run_now(timed.first_seen_stream(stateful.replayed(e.unionByName(clock), "ts", 6), ["user_id", "event_type"], keep_hours=24))
    return out.where("event_type <> 'clock'").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# workbooks


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '''=' || c_name ELSE c_name END AS c_name, c_acctbal, c_mktsegment FROM customer")
def xlsx_round_trip(spark, sf_dir):
    """A table written as workbooks and read back."""
    place = f"{shared_folder(spark)}/workbooks-{uuid.uuid4().hex}"
    name = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_name")).alias("c_name")
    workbook.write_xlsx(table(spark, sf_dir, "customer").select("c_custkey", name, "c_acctbal", "c_mktsegment"), place, rows_per_file=100_000)
    c = F.col("cells")
    rows = io.read_xlsx(spark, f"{place}/*.xlsx").where("row_no > 0")
    return rows.select(c[0].cast("bigint").alias("c_custkey"), c[1].alias("c_name"), c[2].cast("double").alias("c_acctbal"), c[3].alias("c_mktsegment"))


# many files

#: Lists of the suppliers of each nation as CSV (JSON where the nation's number is 3 of 5), with a version stuck to the names in every fifth; every fifth
#: comes a second time, clean, and every seventh has a broken file beside it.
FILES = """WITH s AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, s_name || ' 1.0' AS name FROM supplier),
    f AS (SELECT k, 'n' || lpad(k::VARCHAR, 2, '0') || 'a' AS path, CASE WHEN k % 5 = 3 THEN 'json' ELSE 'csv' END AS chain, CASE WHEN k % 5 = 0 THEN '1.0' ELSE '2' END AS version FROM (SELECT DISTINCT k FROM s)
      UNION ALL SELECT k, 'n' || lpad(k::VARCHAR, 2, '0') || 'b', 'csv', '2' FROM (SELECT DISTINCT k FROM s) WHERE k % 5 = 0)
"""


def _files(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", F.concat("s_name", F.lit(" 1.0")).alias("name"))
    made = s.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "name"))).alias("l"))

    def path(part):
        return F.concat(F.lit("n"), F.lpad(F.col("k").cast("string"), 2, "0"), F.lit(part))

    def text(version):
        lines = F.transform("l", lambda x, i: F.concat_ws(",", (i + 1).cast("string"), x["name"], F.concat(F.lit("co "), x["s_suppkey"].cast("string")), version))
        return F.concat_ws("\n", F.lit("序号,应用名称,企业名称,版本"), lines)

    def records(version):
        rows = F.transform("l", lambda x, i: F.struct((i + 1).cast("string").alias("序号"), x["name"].alias("应用名称"), F.concat(F.lit("co "), x["s_suppkey"].cast("string")).alias("企业名称"), version.alias("版本")))
        return F.to_json(F.struct(rows.alias("data")))

    first = made.select(path("a").alias("path"), F.when(F.col("k") % 5 == 3, records(F.lit("2"))).otherwise(text(F.when(F.col("k") % 5 == 0, "1.0").otherwise("2"))).cast("binary").alias("content"))
    second = made.where("k % 5 = 0").select(path("b").alias("path"), text(F.lit("2")).cast("binary").alias("content"))
    broken = made.where("k % 7 = 0").select(path("x").alias("path"), F.concat(F.lit(b"PK\x03\x04"), F.col("k").cast("string").cast("binary")).alias("content"))
    return first.unionByName(second).unionByName(broken)


@query(
    FILES
    + """SELECT path AS source_file, i AS seq, name AS app_name, 'co ' || s_suppkey AS company_name, version FROM f JOIN s USING (k) WHERE path LIKE CASE WHEN k % 5 = 0 THEN '%b' ELSE '%a' END"""
)
def many_files_records(spark, sf_dir):
    records, _ = many_files.tables_of(_files(spark, sf_dir))
    return records.select("source_file", F.col("seq").cast("bigint").alias("seq"), "app_name", "company_name", "version")


@query(
    FILES
    + """, n AS (SELECT k, count(*) AS n_rows FROM s GROUP BY k)
    SELECT path, chain, n_rows, NULL AS error, CASE WHEN path LIKE '%a' AND k % 5 = 0 THEN 'same list' ELSE 'kept' END AS part, CASE WHEN k % 5 = 0 THEN replace(path, 'a', 'b') ELSE path END AS kept_file FROM f JOIN n USING (k)
    UNION ALL SELECT 'n' || lpad(k::VARCHAR, 2, '0') || 'x', NULL, 0, 'BadZipFile', 'nothing', NULL FROM n WHERE k % 7 = 0"""
)
def many_files_account(spark, sf_dir):
    _, account = many_files.tables_of(_files(spark, sf_dir))
    return account.withColumn("error", F.regexp_extract("error", r"^\w+", 0))


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'zip' WHEN 3 THEN 'gz' WHEN 4 THEN 'pdf' WHEN 5 THEN 'doc' ELSE 'unknown' END AS kind FROM documents")
def file_kinds(spark, sf_dir):
    """Files made from each document's text; a plain ZIP's text names the parts of the others."""

    def file(i: int, t: str | None) -> bytes:
        text = (t or "").encode() + b" word/document.xml xl/workbook.xml"
        name = {0: "word/document.xml", 1: "xl/workbook.xml", 2: "notes.txt"}.get(i % 7)
        if name:
            held = bytesio.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr(name, text)
            return held.getvalue()
        return {3: lambda: gzip.compress(text), 4: lambda: b"%PDF-1.7\n" + text, 5: lambda: b"\xd0\xcf\x11\xe0" + "WordDocument".encode("utf-16-le") + text}.get(i % 7, lambda: b"- " + text)()

    @F.arrow_udf("binary")
    def made(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in C.portions(batches):
            yield pa.array([file(i, t) for i, t in zip(ids.to_pylist(), texts.to_pylist())], pa.binary())

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.file_kind(made("doc_id", "text")).alias("kind"))


# scripts and captures


@query(
    """WITH p AS (SELECT page_id, page_id % 3 AS k, page_id % 4 AS host FROM pages)
    SELECT method, url, coalesce(list_sort(list(DISTINCT param) FILTER (param IS NOT NULL)), []) AS params, count(DISTINCT page_id) AS n_scripts FROM (
      SELECT page_id, 'GET' AS method, 'https://h' || host || '.example/v1/items/' || k || '/list' AS url, unnest(['page', 'params', 'size']) AS param FROM p
      UNION ALL SELECT page_id, 'POST', 'https://h' || host || '.example/v1/save', unnest(['kind', 'user_id']) FROM p
      UNION ALL SELECT page_id, 'POST', '/gateway/plain/' || k, NULL FROM p WHERE k <> 1 UNION ALL SELECT page_id, 'POST', 'https://other.example/api/gateway/plain/' || k, NULL FROM p WHERE k = 1
      UNION ALL SELECT page_id, 'GET', CASE WHEN k = 1 THEN 'https://other.example/api' ELSE '' END || '/raw/' || k, unnest(['mode']) FROM p
      UNION ALL SELECT page_id, 'CFG', 'https://full.example/api/search', unnest(['data', 'word']) FROM p WHERE k = 2)
    GROUP BY method, url"""
)
def script_endpoints(spark, sf_dir):
    """Scripts planted behind each page: clients with a base, a default base in a third of them, calls, and things that are no endpoints."""
    k, host = (F.col("page_id") % 3).cast("string"), (F.col("page_id") % 4).cast("string")
    text = F.concat(
        F.lit('<script>const api=axios.create({timeout:5,baseURL:"https://h'), host, F.lit('.example/v1/"});'), F.when(k == "1", 'axios.defaults.baseURL="https://other.example/api";').otherwise(""),
        F.lit('api.get("/items/'), k, F.lit('/list",{params:{page:1,"size":20}});api.post("/save",{kind:a,user_id:b});axios.post("/gateway/plain/'), k, F.lit('");fetch("/raw/'), k, F.lit("\",{mode:1});fetch('/logo.png');x.get('no path');"),
        F.when(k == "2", '$.ajax({url:"https://full.example/api/search",data:{word:1}});').otherwise(""), F.lit("</script>"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("html", r"(?is)<script\b.*?</script\s*>", ""), text).alias("html"))
    return scripts.endpoints(scripts.page_scripts(pages, "page_id", "html"), ["page_id", "script"])


def _captured(spark, sf_dir):
    """Responses of two endpoints: events by offset, documents by a page number in a JSON body."""
    e = table(spark, sf_dir, "events").withColumn("page", F.expr("event_id div 100"))
    record = F.struct("event_id", "event_type", F.struct(F.col("user_id").alias("id"), F.lit("u").alias("kind")).alias("user"), "value")
    lists = e.groupBy("page").agg(F.collect_list(record).alias("list"))
    events = lists.select(
        F.concat(F.lit("https://api.example/v1/events?limit=100&offset="), (F.col("page") * 100).cast("string"), F.lit("&t="), F.md5(F.col("page").cast("string"))).alias("url"), F.lit("get").alias("method"),
        F.lit(None).cast("string").alias("post_data"), F.to_json(F.struct(F.lit(0).alias("code"), F.struct("list", F.lit(1).alias("total")).alias("data"))).alias("body"),
    )
    d = table(spark, sf_dir, "documents").withColumn("page", F.expr("doc_id div 50") + 1)
    lists = d.groupBy("page").agg(F.collect_list(F.struct("doc_id", "lang", "source")).alias("items"))
    docs = lists.select(
        F.lit("https://api.example/v1/documents").alias("url"), F.lit("POST").alias("method"), F.to_json(F.struct(F.col("page").alias("pageNo"), F.lit("all").alias("q"))).alias("post_data"),
        F.to_json(F.struct(F.struct("items").alias("result"))).alias("body"),
    )
    return events.unionByName(docs)


@query("SELECT event_id::VARCHAR AS event_id, event_type, user_id::VARCHAR AS user_id, 'u' AS user_kind, value FROM events")
def capture_to_table(spark, sf_dir):
    """The table comes back out of captured responses by the specification that was inferred from them."""
    captured = cut_lineage(_captured(spark, sf_dir))
    made, _ = infer.specifications(captured)["GET https://api.example/v1/events"]
    rows = spec.run(spark, made, {"captured": infer.of_endpoint(captured, "GET https://api.example/v1/events")})
    return rows.select("event_id", "event_type", "user_id", "user_kind", F.col("value").cast("double").alias("value"))


@query(
    """SELECT * FROM (VALUES ('GET https://api.example/v1/events', 'limit', 'constant', NULL, NULL, '100'), ('GET https://api.example/v1/events', 't', 'key', NULL, NULL, NULL), ('POST https://api.example/v1/documents', 'body.q', 'constant', NULL, NULL, 'all')) AS v(endpoint, name, kind, start, step, value)
    UNION ALL SELECT 'GET https://api.example/v1/events', 'offset', 'offset', min(event_id // 100) * 100, 100, NULL FROM events
    UNION ALL SELECT 'POST https://api.example/v1/documents', 'body.pageNo', 'page', min(doc_id // 50) + 1, 1, NULL FROM documents"""
)
def capture_parameters(spark, sf_dir):
    return infer.parameters(infer.requests(_captured(spark, sf_dir)))


# panels, catalogues, extensions, events

#: A panel of customers and years out of orders: the text of a cell is as long as its total says but for some, titles name their year but for some.
PANEL = """WITH p AS (SELECT lpad((o_custkey % 300)::VARCHAR, 6, '0') AS code, year(o_orderdate)::BIGINT AS year, sum(o_orderkey % 90 + 10)::BIGINT AS total, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
    q AS (SELECT *, CASE WHEN k % 13 = 0 THEN year + 1 ELSE year END AS said, CASE WHEN k % 7 = 0 THEN NULL ELSE repeat('a', (total - n)::INT) || repeat('x', (CASE WHEN k % 11 = 0 THEN n + 1 ELSE n END)::INT) END AS text, CASE WHEN k % 2 = 0 THEN '不可复现' ELSE '' END AS note FROM p),
    w AS (SELECT code, CASE WHEN code::INT % 9 = 0 THEN 1994 ELSE 1992 END AS a, CASE WHEN code::INT % 10 = 0 THEN 1996 ELSE 1998 END AS b FROM (SELECT DISTINCT code FROM p) WHERE code::INT % 17 <> 0)
"""


def _panel(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("k")
    p = o.groupBy(F.lpad((F.col("o_custkey") % 300).cast("string"), 6, "0").alias("code"), F.year("o_orderdate").cast("bigint").alias("year")).agg(
        F.sum(F.col("o_orderkey") % 90 + 10).alias("total"), F.count("*").alias("n"), F.min("o_orderkey").alias("k")
    )
    said = F.when(k % 13 == 0, F.col("year") + 1).otherwise(F.col("year"))
    n = F.when(k % 11 == 0, F.col("n") + 1).otherwise(F.col("n"))
    text = F.when(k % 7 != 0, F.concat(F.repeat(F.lit("a"), (F.col("total") - F.col("n")).cast("int")), F.repeat(F.lit("x"), n.cast("int"))))
    return cut_lineage(p.select("*", F.concat(said.cast("string"), F.lit("年年度报告")).alias("title"), text.alias("text"), F.when(k % 2 == 0, "不可复现").otherwise("").alias("note")))


@query(
    PANEL
    + """SELECT 'title_year' AS rule, code, year, said::VARCHAR AS detail FROM q WHERE said <> year
    UNION ALL SELECT 'year_window', code, year, '' FROM q WHERE year > 1997
    UNION ALL SELECT 'outside_window', q.code, q.year, '' FROM q LEFT JOIN w USING (code) WHERE w.a IS NULL OR q.year NOT BETWEEN w.a AND w.b
    UNION ALL SELECT 'missing_year', code, y, '' FROM (SELECT code, unnest(range(greatest(a, 1992), least(b, 1997) + 1)) AS y FROM w) AS e WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.code = e.code AND q.year = e.y) AND y <> 1997
    UNION ALL SELECT 'text_missing', code, year, '' FROM q WHERE text IS NULL AND note = ''
    UNION ALL SELECT 'recount', code, year, CASE WHEN length(text) <> total THEN 'total,words' ELSE 'words' END FROM q WHERE text IS NOT NULL AND (length(text) <> total OR length(text) - length(replace(text, 'x', '')) <> n)
    UNION ALL SELECT 'note_claim', '', NULL, '1995年 共 7 行 / ' || (SELECT count(*) || ' or ' || count(*) FROM q WHERE year = 1995)
    UNION ALL SELECT 'note_claim', '', NULL, '12,345 家 / ' || (SELECT count(DISTINCT code) FROM q)"""
)
def panel_full_audit(spark, sf_dir):
    q = _panel(spark, sf_dir)
    rows_in = q.select("code", "year", "total", "title", "note", F.col("n").alias("count_words"), F.round(F.col("n") * 2000 / F.col("total"), 3).alias("freq_words"))
    code = F.col("code").cast("int")
    universe = q.select("code").distinct().where(code % 17 != 0).select(
        F.concat(code.cast("string"), F.lit(".0")).alias("code"), F.when(code % 9 == 0, 1994).otherwise(1992).alias("first_year"), F.when(code % 10 == 0, 1996).otherwise(1998).alias("last_year")
    )
    gaps = q.select("code").distinct().select("code", F.lit(1997).alias("year"))
    texts = q.where("text is not null").select("code", "year", "text")
    counted = q.agg(F.count("*").alias("n"), F.count_if(F.col("year") == 1995).alias("y"))
    said = F.format_string("本表 %d 行；1995年 共 7 行；其中 12,345 家；1995年 %d 行", "n", "y")
    return panel.audit(rows_in, 1992, 1997, ["words"], {"words": ["x"]}, universe, gaps, texts, counted.select(said.alias("text")))


@query(
    """WITH p AS (SELECT p_brand, p_type, p_partkey, p_name AS title, CASE WHEN p_size % 5 = 0 THEN '--' ELSE p_type END AS kind, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_brand END AS maker FROM part)
    SELECT (2 - grouping(p_brand) - grouping(p_type))::INTEGER AS level, p_brand, p_type, count(*) AS n_rows, count(DISTINCT p_partkey) AS n_keys, count(title) AS filled_title, count(*) FILTER (kind <> '--') AS filled_kind,
      count(*) FILTER (maker <> ' ') AS filled_maker, round(1 - (count(title) + count(*) FILTER (kind <> '--')) / (count(*) * 2), 4) AS required_missing_rate,
      round(1 - (count(title) + count(*) FILTER (kind <> '--') + count(*) FILTER (maker <> ' ')) / (count(*) * 3), 4) AS missing_rate
    FROM p GROUP BY GROUPING SETS ((), (p_brand), (p_brand, p_type))"""
)
def catalogue_coverage(spark, sf_dir):
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").select(
        "p_brand", "p_type", "p_partkey", F.col("p_name").alias("title"), F.when(size % 5 == 0, "--").otherwise(F.col("p_type")).alias("kind"), F.when(size % 3 == 0, " ").otherwise(F.col("p_brand")).alias("maker")
    )
    return catalogue.coverage(p, ["p_brand", "p_type"], ["title", "kind", "maker"], ["title", "kind"], "p_partkey")


class Gaps:
    """A user's table function: of each key's rows, in order, the days since the row before, and one row with their number at the end."""

    def __init__(self):
        self.last, self.n, self.key = None, 0, None

    def eval(self, row, least: int):
        day = row["o_orderdate"]
        days = None if self.last is None else (day - self.last).days
        self.last, self.n, self.key = day, self.n + 1, row["o_custkey"]
        if days is not None and days >= least:
            yield self.key, "gap", days

    def terminate(self):
        if self.n:
            yield self.key, "rows", self.n


@query(
    """WITH g AS (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), o_orderdate) AS days FROM orders)
    SELECT o_custkey AS customer, 'gap' AS what, days::BIGINT AS n FROM g WHERE days >= 30 UNION ALL SELECT o_custkey, 'rows', count(*) FROM orders GROUP BY o_custkey"""
)
def extension_steps(spark, sf_dir):
    """A specification with two steps that a user registered: a function and a table function."""
    registry.step("only", needs=["columns"], replace=True)(lambda df, settings, order: df.select(*settings["columns"]))
    registry.table_step("gaps", Gaps, schema="customer bigint, what string, n bigint", replace=True)
    steps = [{"step": "only", "columns": ["o_custkey", "o_orderdate"]}, {"step": "gaps", "key": "o_custkey", "sort": "o_orderdate", "args": [30]}]
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return spec.run(spark, {"source": {"table": "orders"}, "pipeline": steps}, {"orders": orders})


@query("SELECT 'progress' AS kind, 4 AS n_batches, count(*) AS rows_in FROM events UNION ALL SELECT 'started', 0, 0 UNION ALL SELECT 'ended', 0, 0")
def stream_events(spark, sf_dir):
    """What a listener wrote of a stream: as many rows came in as the table has, in as many batches as files."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    with events.Log(spark, f"{shared_folder(spark)}/events-{uuid.uuid4().hex}") as log:
        name = f"q{uuid.uuid4().hex}"
        stateful.run_now(stateful.replayed(e, "ts", 4).select("event_id"), name=name)
    told = log.table()
    mine = told.join(told.where(F.col("name") == name).select("run").distinct(), "run")
    counts = mine.groupBy("kind").agg(F.count_if(F.col("rows_in") > 0).cast("int").alias("n_batches"), F.coalesce(F.sum("rows_in"), F.lit(0)).alias("rows_in"))
    return counts.select("kind", "n_batches", "rows_in")


@query(
    """SELECT page_id, CASE page_id % 12 WHEN 1 THEN 'session_expired' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'access_denied' WHEN 4 THEN 'challenge' WHEN 5 THEN 'access_denied' WHEN 6 THEN 'challenge' WHEN 7 THEN 'server_error' WHEN 8 THEN 'missing'
      WHEN 10 THEN 'other' ELSE 'ok' END AS kind, page_id % 12 BETWEEN 1 AND 6 AS blocked,
    CASE page_id % 12 WHEN 1 THEN 10 WHEN 2 THEN 13 WHEN 3 THEN 6 WHEN 4 THEN 9 WHEN 5 THEN 12 WHEN 6 THEN 5 WHEN 7 THEN 9 WHEN 8 THEN 9 WHEN 10 THEN 0 ELSE 4 END AS weight FROM pages"""
)
def response_diagnosis(spark, sf_dir):
    """Pages with planted evidence: statuses, headers, words in titles and between the tags, scripts; one without any, and words that prove nothing."""
    k = F.col("page_id") % 12
    plain = F.regexp_replace("html", r"(?is)<script\b.*?</script\s*>|<title>.*?</title>|<h1.*?</h1>|<div[^>]+id=.?(app|root)[^>]*>\s*</div>|<meta[^>]*>", "")
    planted = {3: "<title>Access Denied</title>", 4: "<p>Please enable JavaScript</p><script>var _0x12ab=1</script>", 5: "<h1>访问受限</h1>", 9: "<p>How an access denied page looks</p>"}
    body = plain
    for at, text in planted.items():
        body = F.when(k == at, F.concat(plain, F.lit(text))).otherwise(body)
    status = F.when(k == 1, 419).when(k == 2, 429).when(k == 5, 403).when(k == 6, 412).when(k == 7, 503).when(k == 8, 404).when(k == 10, 999).otherwise(200)
    headers = F.when(k == 2, F.create_map(F.lit("Retry-After"), F.lit("30"))).when(k == 5, F.create_map(F.lit("Server"), F.lit("***"))).otherwise(F.create_map(F.lit("Server"), F.lit("nginx")))
    p = table(spark, sf_dir, "pages").select("page_id", status.alias("status"), body.alias("body"), headers.alias("headers"))
    return diagnosis.diagnose(p, "status", "body", "headers").select("page_id", "kind", "blocked", "weight")
