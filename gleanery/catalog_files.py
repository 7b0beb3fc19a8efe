"""Registered queries of the readers and sinks (written from the tables, read back), of reports, hooks and small cell functions, each with its SQL."""

from __future__ import annotations

import codecs
import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.catalog import query
from gleanery.functions import cjk
from gleanery.functions import columns as C
from gleanery.functions import pages
from gleanery.operators import grids, quality, relational, report, rows
from gleanery.plans import spec
from gleanery.session import shared_folder, table
from gleanery.sources import io
from gleanery.streaming import stateful


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# readers and sinks


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_records(spark, sf_dir):
    """A table written as JSON documents of an API's form, one a line and file, and read back record by record."""
    o = table(spark, sf_dir, "orders")
    docs = o.groupBy(F.expr("o_orderkey div 1000").alias("k")).agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("records"))
    place = _place(spark, "json")
    docs.select(F.to_json(F.struct(F.lit("ok").alias("status"), F.struct("records").alias("data"))).alias("value")).repartition(4).write.option("lineSep", "\n").text(place)
    lines = spark.read.text(place).select(F.col("value").alias("body"))
    task = {"source": {"table": "t", "kind": "json", "column": "body", "records_path": "data.records", "fields": {"o_orderkey": "o_orderkey", "o_orderstatus": "o_orderstatus", "o_totalprice": "o_totalprice"}}}
    return spec.run(spark, task, {"t": lines}).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def record_files(spark, sf_dir):
    """A file a region, whole documents with their records under a known key."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = _place(spark, "records")
    n.groupBy("r_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name", "r_name")).alias("items")).select("items").write.option("maxRecordsPerFile", 1).json(place)
    r = io.read_records(spark, f"{place}/*.json").select("record")
    return r.select(F.variant_get("record", "$.n_nationkey", "bigint").alias("n_nationkey"), F.variant_get("record", "$.n_name", "string").alias("n_name"), F.variant_get("record", "$.r_name", "string").alias("r_name"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 0")
def captured_records(spark, sf_dir):
    """Files of captured responses: lists of bodies, one a line, some bare, some under ``json``, and responses that hold no records."""
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0")
    body = F.struct(F.collect_list(F.struct("event_id", "user_id")).alias("rows"))
    made = e.groupBy(F.expr("event_id div 500").alias("k")).agg(body.alias("data")).withColumn("part", F.expr("k div 10"))
    one = F.when(F.col("k") % 2 == 0, F.to_json(F.struct("data"))).otherwise(F.to_json(F.struct(F.struct("data").alias("json"))))
    files = made.groupBy("part").agg(F.concat(F.lit('["text", null, 5, '), F.array_join(F.collect_list(one), ", "), F.lit("]")).alias("value"))
    place = _place(spark, "capture")
    files.select("value").repartition(8).write.text(place)
    r = io.capture_records(spark, f"{place}/*.txt", "data.rows")
    return r.select(F.variant_get("record", "$.event_id", "bigint").alias("event_id"), F.variant_get("record", "$.user_id", "bigint").alias("user_id"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN ', \"q\"' ELSE '' END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN '''=1' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    """Separators, quotes and formulas through the CSV sink and the reader that finds each file's encoding."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.when(k % 3 == 0, ', "q"').otherwise("")).alias("c_name"), F.when(k % 5 == 0, "=1").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    place = _place(spark, "csv")
    io.write_csv(c, place)
    return io.read_csv(spark, f"{place}/*.csv")


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def mixed_files(spark, sf_dir):
    """JSON lines and CSV in one folder, told apart by what they hold; a column that only some files have."""
    s = table(spark, sf_dir, "supplier")
    place = _place(spark, "mixed")
    s.where("s_suppkey % 2 = 0").select("s_suppkey", "s_name", "s_acctbal").coalesce(2).write.json(f"{place}/a")
    s.where("s_suppkey % 2 = 1").select("s_suppkey", "s_name").coalesce(2).write.csv(f"{place}/b", header=True)
    return io.read_any(spark, [f"{place}/a/part-*", f"{place}/b/part-*"]).select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def decoded_bodies(spark, sf_dir):
    """Whole texts through UTF-8, UTF-8 and UTF-16 with marks, GB18030 named in a meta tag, and gzip; the encoding is found for each."""

    def body(i: int, t: str) -> bytes:
        forms = [t.encode, lambda: codecs.BOM_UTF8 + t.encode(), lambda: codecs.BOM_UTF16_LE + t.encode("utf-16-le"), lambda: b"<meta charset=gbk>" + t.encode("gb18030"), lambda: gzip.compress(t.encode())]
        return forms[i % 5]()

    @F.arrow_udf("binary")
    def sent(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in C.portions(batches):
            yield pa.array([body(i, t or "") for i, t in zip(ids.to_pylist(), texts.to_pylist())], pa.binary())

    d = table(spark, sf_dir, "documents").select("doc_id", sent("doc_id", "text").alias("body"))
    return d.select("doc_id", F.regexp_replace(io.decoded(F.col("body")), "^<meta charset=gbk>", "").alias("text"))


@query("SELECT 'https://site.example/p/' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS depth FROM pages")
def sitemap_pages(spark, sf_dir):
    """An index of sitemaps that lists one directly and another through a second index, and itself."""
    p = table(spark, sf_dir, "pages")
    loc = F.concat(F.lit("<url><loc> https://site.example/p/"), F.col("page_id").cast("string"), F.lit(" </loc></url>"))
    maps = p.groupBy((F.col("page_id") % 2).alias("k")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("body"))
    captured = maps.select(F.concat(F.lit("https://site.example/map"), F.col("k").cast("string")).alias("url"), "body")
    index = p.limit(1).select(F.lit("https://site.example/index").alias("url"), F.lit("<s><loc>https://site.example/more</loc><loc>https://site.example/index</loc></s>").alias("body"))
    more = p.limit(1).select(F.lit("https://site.example/more").alias("url"), F.lit("<s><loc>https://site.example/map1</loc></s>").alias("body"))
    out = io.expand_sitemaps(captured.unionByName(index).unionByName(more), ["https://site.example/index", "https://site.example/map0"])
    return out.select("url", F.when(F.col("depth") == 1, 1).otherwise(F.col("depth") - 1).cast("int").alias("depth"))


@query("SELECT p_partkey::VARCHAR AS key, p_brand AS brand, p_size::VARCHAR AS size FROM part WHERE p_partkey % 4 <> 0")
def quoted_lines(spark, sf_dir):
    """Script lines of the form ``var hq_str_1="a,b";`` among others, in texts of many lines."""
    p = table(spark, sf_dir, "part")
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("// "), "p_name")).otherwise(F.concat(F.lit("var hq_str_"), F.col("p_partkey").cast("string"), F.lit('="'), "p_brand", F.lit(","), F.col("p_size").cast("string"), F.lit('";')))
    texts = p.groupBy(F.expr("p_partkey div 100").alias("k")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return io.delimited_lines(texts, "text", r'hq_str_(\w+)="([^"]*)"', ["brand", "size"])


@query(
    """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS o_orderpriority FROM orders"""
)
def grown_table(spark, sf_dir):
    """Rows appended twice, the second time with a column more."""
    o, place = table(spark, sf_dir, "orders"), _place(spark, "grown")
    io.append_rows(o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus"), place)
    io.append_rows(o.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus", "o_orderpriority"), place)
    return io.read_grown(spark, place)


@query("SELECT c_custkey::VARCHAR AS c_custkey, '{\"name\":\"' || c_name || '\",\"tags\":[\"' || c_mktsegment || '\"]}' AS nested FROM customer")
def flat_parquet(spark, sf_dir):
    """Nested columns as JSON text in a Parquet sink of text columns."""
    place = _place(spark, "flat")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.array("c_mktsegment").alias("tags")).alias("nested"))
    io.write_parquet(c, place, all_text=True)
    return spark.read.parquet(place)


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer")
def json_sink(spark, sf_dir):
    """Nulls are kept as fields."""
    place = _place(spark, "nulls")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    io.write_json(c, place)
    kept = spark.read.text(place).where(~F.contains("value", F.lit('"segment":')))
    if not kept.isEmpty():
        raise AssertionError("a null field is missing")
    return spark.read.schema("c_custkey bigint, c_name string, segment string").json(place)


@query(
    """SELECT url, count(DISTINCT body) AS versions, sum(new)::BIGINT AS written FROM (SELECT url, body, count(*) OVER (PARTITION BY url, body) AS c, CASE WHEN row_number() OVER (PARTITION BY url, body ORDER BY o) = 1 THEN 1 ELSE 0 END AS new
      FROM (SELECT source AS url, coalesce(lang, '') AS body, doc_id AS o FROM documents)) GROUP BY url"""
)
def snapshot_versions(spark, sf_dir):
    """Responses appended in two rounds; only what a snapshot does not hold yet is written."""
    place = _place(spark, "snapshot")
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("url"), F.coalesce("lang", F.lit("")).alias("body"), "doc_id")
    for part in (0, 1):
        io.write_snapshot(d.where(F.col("doc_id") % 2 == part).select("url", "body"), place)
    return spark.read.parquet(place).groupBy("url").agg(F.count_distinct("body").alias("versions"), F.count("*").alias("written"))


@query("SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def distinct_file_bodies(spark, sf_dir):
    """Files with equal content are one: the orders of a status, each written as often as it has orders of one digit's key."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    place = _place(spark, "copies")
    for copy in ("a", "b"):
        o.repartition(3, "status").select(F.to_json(F.struct("status", "n", "first")).alias("value")).write.text(f"{place}/{copy}")
    found = io.distinct_files(spark, f"{place}/*/part-*").where("copies >= 2 and length > 0")
    bodies = spark.read.text(f"{place}/a/*").select(F.from_json("value", "status string, n bigint, first bigint").alias("r")).select("r.*")
    return bodies if found.count() >= 1 else bodies.limit(0)


@query("SELECT event_type, count(*) AS n, 2 * count(*) AS both FROM events GROUP BY event_type")
def many_sinks(spark, sf_dir):
    """One stream into two sinks."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    place = _place(spark, "sinks")
    sinks = [lambda f, n: f.write.mode("append").parquet(f"{place}/a"), lambda f, n: f.write.mode("append").json(f"{place}/b")]
    stateful.write_many(stateful.replayed(e, "ts", 3), sinks, f"{place}/state").awaitTermination()
    a = spark.read.parquet(f"{place}/a").groupBy("event_type").agg(F.count("*").alias("n"))
    b = spark.read.schema("event_type string").json(f"{place}/b").groupBy("event_type").agg(F.count("*").alias("m"))
    return a.join(b, "event_type").select("event_type", "n", (F.col("n") + F.col("m")).alias("both"))


# rows, hooks, reports


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'new' END AS note FROM orders WHERE o_orderkey % 3 <> 1 OR o_orderkey % 2 = 0")
def resumed_export(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 3 = 0").withColumn("note", F.lit("new"))
    return relational.resume_export(new, o.where("o_orderkey % 3 <> 1 or o_orderkey % 2 = 0"), "o_orderkey")


@query("SELECT c_name AS title, c_mktsegment AS segment, c_custkey AS raw_c_custkey, c_name AS raw_c_name, c_mktsegment AS raw_c_mktsegment FROM customer")
def kept_raw(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return rows.map_record(c, {"title": "c_name", "segment": "c_mktsegment"}, keep_raw=True)


@query("SELECT s_suppkey AS 编号, s_name AS 名称, s_acctbal AS 名称_2, s_phone AS col4 FROM supplier".replace("s_phone", "s_nationkey"))
def named_columns(spark, sf_dir):
    """Heads of a sheet, some alike and one blank, made different and met with the names that are wanted."""
    heads = rows.dedup_names(["供应商编号", "名称", "名称", " "])
    met = rows.fuzzy_names(heads, ["编号", "名称"])
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey").toDF(*heads)
    return rows.rename(s, met)


@query("SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def hooked(spark, sf_dir):
    """User functions around a plan; one that gives nothing back changes nothing."""
    hooks = [lambda df: df.where("o_orderstatus = 'F'"), lambda df: None, lambda df: df.withColumn("o_totalprice", F.col("o_totalprice") * 2)]
    return report.with_hooks(table(spark, sf_dir, "orders"), hooks).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) <> '') AS filled_text, count(lang) AS filled_lang FROM documents")
def observed_counters(spark, sf_dir):
    """Counters that fill while the rows are written."""
    d, seen = report.observed(table(spark, sf_dir, "documents").select("doc_id", F.trim("text").alias("text"), "lang"), ["text", "lang"])
    d.write.parquet(_place(spark, "observed"))
    got = seen.get
    return table(spark, sf_dir, "region").limit(1).select(*[F.lit(got[k]).cast("bigint").alias(n) for k, n in (("rows", "n"), ("filled_text", "filled_text"), ("filled_lang", "filled_lang"))])


@query(
    """WITH f AS (SELECT user_id, min(day(ts)) AS d FROM events WHERE month(ts) = 1 AND year(ts) = 2024 GROUP BY 1), n AS (SELECT d, count(*) AS new FROM f GROUP BY 1),
    c AS (SELECT e.d, coalesce(new, 0) AS new FROM (SELECT DISTINCT day(ts) AS d FROM events WHERE month(ts) = 1 AND year(ts) = 2024) e LEFT JOIN n USING (d))
    SELECT min(d)::BIGINT AS calm_from FROM (SELECT d, max(new) OVER (ORDER BY d ROWS 1 PRECEDING) AS m, row_number() OVER (ORDER BY d) AS i FROM c) WHERE m = 0 AND i >= 2"""
)
def saturation(spark, sf_dir):
    """The first day that ends two days in a row without a new user."""
    e = table(spark, sf_dir, "events").where("month(ts) = 1 and year(ts) = 2024").select(F.dayofmonth("ts").alias("day"), "user_id")
    calm = report.saturated(e, "day", "user_id", 2)
    return table(spark, sf_dir, "region").limit(1).select(F.lit(calm).cast("bigint").alias("calm_from"))


@query("SELECT 'area' AS name, false AS numeric, false AS personal UNION ALL SELECT 'phone', false, true UNION ALL SELECT 'balance', true, false UNION ALL SELECT 'n_nationkey', true, false")
def column_kinds(spark, sf_dir):
    """Which columns hold numbers, and which are named like personal data."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("r_name").alias("area"), F.concat("r_name", F.lit("-x")).alias("phone"), F.concat(F.round("s_acctbal", 1).cast("string"), F.lit(" 元")).alias("balance"), "n_nationkey")
    numbers, personal = quality.numeric_columns(s), quality.pii_findings(s.columns)
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c in numbers).alias("numeric"), F.lit(c in personal).alias("personal")) for c in s.columns]))
    return table(spark, sf_dir, "region").limit(1).select(names.alias("c")).select("c.*")


@query("SELECT doc_id, coalesce(lang, '') = 'en' AND coalesce(text, '') <> '' AS private FROM documents WHERE doc_id % 2 = 0")
def script_variants(spark, sf_dir):
    """Texts with signs of traditional script put in where the language is English; private-use characters are looked for as well."""
    d = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    marked = d.select("doc_id", F.when((F.coalesce("lang", F.lit("")) == "en") & (F.coalesce("text", F.lit("")) != ""), F.concat(F.lit("國關於這時總運網發後來區"), "text")).otherwise(F.col("text")).alias("text"))
    if rows.has_private_use(marked)["text"]:
        raise AssertionError("there are no private-use characters")
    return marked.select("doc_id", rows.mostly(F.col("text"), "國關於這時總運網發後來區", "国关于这时总运网发后来区").alias("private"))


# cells


@query(
    r"""SELECT n_nationkey, 'https://h/' || n_nationkey AS one, ['https://t/' || n_nationkey, '/p'] AS links, n_name || ' ok' AS clean, CASE WHEN n_nationkey % 2 = 0 THEN 12 + n_nationkey ELSE NULL END::BIGINT AS stated,
    n_nationkey % 3 = 0 AS head FROM nation"""
)
def cell_values(spark, sf_dir):
    """First of several links, targets of Markdown links, zero-width signs, counts stated in prose, rows of heads: made from each nation's row."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    number = k.cast("string")
    links = F.concat(F.lit("https://h/"), number, F.lit(" https://other/"), number)
    marked = F.concat(F.lit("see [a](https://t/"), number, F.lit(") and [b](/p) and [c](https://t/"), number, F.lit(")"))
    dirty = F.concat(name, F.lit("​ \x01ok"))
    said = F.when(k % 2 == 0, F.concat(F.lit("本次通报12款应用。另通报"), number, F.lit("款应用存在问题；"))).otherwise(F.lit("没有说明"))
    cells = F.when(k % 3 == 0, F.array(F.lit("序号"), F.lit("应用名称"), F.lit("企业名称"))).otherwise(F.array(number, name, F.lit("x")))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", C.smart_single(links).alias("one"), C.markdown_links(marked).alias("links"), C.scrub(dirty).alias("clean"), cjk.stated_count(said).alias("stated"), grids.is_header(cells).alias("head")
    )


@query(
    """SELECT event_id, epoch(date_trunc('minute', ts))::BIGINT - 28800 AS said, date_trunc('second', ts)::TIMESTAMP AS stamp FROM events WHERE event_id % 3 = 0"""
)
def parsed_times(spark, sf_dir):
    """Times as sites write them, in UTC+8, behind a line without one; and as plain timestamps."""
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0")
    said = F.concat(F.lit("no time here\n发布于："), F.date_format("ts", "yyyy年M月d日 HH:mm"))
    return e.select("event_id", C.parse_when(said, F.lit(1_700_000_000)).alias("said"), C.parse_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("stamp"))


@query("SELECT event_id, user_id::VARCHAR AS id, value AS depth, event_id::DOUBLE / 2 AS lon FROM events WHERE event_id % 4 = 0")
def geo_features(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 4 = 0")
    feature = F.struct(F.struct(F.col("user_id").alias("id"), F.col("event_id").alias("event_id")).alias("properties"), F.struct(F.array(F.col("event_id").cast("double") / 2, F.lit(1.5), F.col("value").cast("double")).alias("coordinates")).alias("geometry"))
    docs = e.groupBy(F.expr("event_id div 1000").alias("k")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("body"))
    return io.feature_rows(docs, "body", ["id", "event_id"]).select(F.col("event_id").cast("bigint").alias("event_id"), "id", "depth", "lon")


@query("""SELECT event_id, '{"k": ' || event_id || ', "v": "' || event_type || '"}' AS object FROM events WHERE event_id % 5 = 0""")
def objects_inside(spark, sf_dir):
    """Objects that have two keys, wherever they stand in a document."""
    e = table(spark, sf_dir, "events").where("event_id % 5 = 0")
    inner = F.struct(F.col("event_id").alias("k"), F.col("event_type").alias("v"))
    body = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.struct(F.array(F.struct(inner.alias("x"))).alias("list")).alias("data")))).otherwise(F.to_json(F.array(F.struct(F.lit(1).alias("k"), F.array(inner).alias("w")))))
    return io.find_objects(e.select("event_id", body.alias("body")), "body", ["k", "v"], ["event_id"])


@query("SELECT l_orderkey, l_linenumber::DOUBLE AS second, (l_linenumber % 3)::INTEGER AS mode, (l_orderkey % 1000)::INTEGER AS color, 'c' || l_linenumber AS text FROM lineitem WHERE l_orderkey % 2 = 0")
def timed_comments(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0")
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    d = F.concat(F.lit('<d p="'), n.cast("string"), F.lit(".0,"), (n % 3).cast("string"), F.lit(",25,"), (k % 1000).cast("string"), F.lit(',0">c'), n.cast("string"), F.lit("</d>"))
    xml = item.groupBy("l_orderkey").agg(F.concat(F.lit("<i>"), F.array_join(F.collect_list(d), ""), F.lit("</i>")).alias("xml"))
    return io.danmaku_rows(xml, "xml", ["l_orderkey"])


@query("SELECT page, (page - 1) * 40 AS \"offset\" FROM (SELECT unnest(range(6, ceil(count(*) / 40.0)::BIGINT + 1)) AS page FROM customer)")
def pages_to_come(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    total = c.agg(F.count("*").alias("total"))
    answers = c.where("c_custkey <= 200").select((F.expr("(c_custkey - 1) div 40") + 1).alias("page")).distinct().join(F.broadcast(total))
    return io.next_requests(answers, "page", 40, "total")


@query(
    """WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[。！？!?\n；;]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents WHERE doc_id % 2 = 0)
    SELECT doc_id, length(array_to_string(parts, '')) > 0 AS any_text FROM s"""
)
def plain_heads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    page = F.concat(F.lit("<html><script>var a;</script><p>"), F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&。！？!?\n；;]", " "), F.lit("</p>"))
    return d.select("doc_id", (F.length(C.plain_head(page, 200)) > 0).alias("any_text"))


@query("SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'removed' ELSE 'added' END AS change, o_orderkey FROM orders WHERE o_orderkey % 50 IN (0, 7) AND o_orderkey < 3000")
def watched_changes(spark, sf_dir):
    """What a watch tells of two snapshots: keys that came or went."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").where("o_orderkey < 3000")
    told: list[tuple] = []
    report.watch(o.where("o_orderkey % 50 <> 0"), o.where("o_orderkey % 50 <> 7"), "o_orderkey", told.extend)
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("change"), F.lit(k).cast(o.schema["o_orderkey"].dataType).alias("o_orderkey")) for c, k in told]))
    return table(spark, sf_dir, "region").limit(1).select(names.alias("c")).select("c.*")


@query("SELECT 'count' AS missing UNION ALL SELECT 'issue' WHERE (SELECT count(*) FROM documents WHERE coalesce(text, '') <> '') > 0")
def asked_fields(spark, sf_dir):
    """A task asks for a date, a count and an issue: only the date is there, the count's column is blank."""
    d = table(spark, sf_dir, "documents").select(F.lit("2024-01-01").alias("date"), F.lit(" ").alias("total_count"), "text")
    missing = report.missing_fields(d, "日期 and count of each issue")
    return table(spark, sf_dir, "region").limit(1).select(F.explode(F.array(*map(F.lit, missing))).alias("missing"))


@query(
    r"""SELECT page_id, [r || '/download/' || page_id || '.docx', r || '/files/' || page_id || '.pdf'] AS attachments, [r || '/upload/image/' || page_id || '.png'] AS images FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS r FROM pages)"""
)
def planted_attachments(spark, sf_dir):
    """Attachments behind a viewer and by type, with images and page assets beside them; each once."""
    k = F.col("page_id").cast("string")
    body = F.concat(
        F.lit('<a href="/viewer.html?file=/download/'), k, F.lit('.docx">v</a><a href="/files/'), k, F.lit('.pdf">a</a><a href="/files/'), k, F.lit('.pdf">again</a><link href="/files/style.css"><img src="/upload/image/'), k, F.lit('.png">'),
    )
    files, images = pages.attachment_targets(F.col("body"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", "url", body.alias("body")).select("page_id", files.alias("attachments"), images.alias("images"))
