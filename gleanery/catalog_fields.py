"""Registered queries of the cell, field, URL and list functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.catalog import query
from gleanery.functions import cjk
from gleanery.functions import columns as C
from gleanery.operators import grids, health, name_list, quality, relational, report, rows
from gleanery.session import table


@query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '''=SUM(1)' WHEN 1 THEN '-3.5' WHEN 2 THEN '''@x' WHEN 3 THEN '''+cmd' ELSE c_name END AS safe,
    CASE c_custkey % 3 WHEN 0 THEN 'a_b_c' WHEN 1 THEN 'untitled' ELSE c_name END AS file FROM customer"""
)
def guarded_cells(spark, sf_dir):
    k = F.col("c_custkey")
    cell = F.when(k % 5 == 0, "=SUM(1)").when(k % 5 == 1, "-3.5").when(k % 5 == 2, "@x").when(k % 5 == 3, "+cmd").otherwise(F.col("c_name"))
    name = F.when(k % 3 == 0, 'a/\\b:*c').when(k % 3 == 1, "  ").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.spreadsheet_safe(cell).alias("safe"), C.safe_filename(name).alias("file"))


@query(
    r"""SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?' || array_to_string(list_concat(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('ref', 'z')), ['ref=a+b', 'z=3']), '&') AS merged,
    CASE WHEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([A-Za-z0-9]{1,5})$', 1) = '' THEN 'bin' ELSE lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([A-Za-z0-9]{1,5})$', 1)) END AS kind,
    regexp_matches(url, '/(en|de)/') AND NOT contains(url, 'page=') AS allowed, replace(url, '://m.', '://') || '#top' AS rewritten FROM pages"""
)
def url_fields(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", C.merge_query(u, {"ref": "a b", "z": "3"}).alias("merged"), C.extension(u).alias("kind"), rows.link_allowed(u, ["/(en|de)/"], ["page="]).alias("allowed"),
        rows.url_rewrite(u, "https://x", "#top", [("://m.", "://")]).alias("rewritten"),
    )


@query(
    r"""SELECT doc_id, contains(lower(text), 'licensed') OR contains(text, 'password') OR contains(source, 'src1') AS relevant,
    len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[。！？!?\n；;]'), lambda s: trim(s, ' ')), lambda s: s <> '' AND length(s) <= 120 AND (contains(s, 'Licensed') OR contains(s, 'password')))) AS found FROM documents"""
)
def relevant_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.lower("text").alias("low"))
    kept = rows.relevant(["low", "source"], ["licensed", "src1"]) | rows.relevant(["text"], ["password"])
    return d.select("doc_id", kept.alias("relevant"), F.size(cjk.promo_sentences(F.col("text"), ["Licensed", "password"])).cast("bigint").alias("found"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END || '|https://h/' || o_custkey || '|{"a":"' || o_orderkey || '","b":"x"}|' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '{"q":"1"}' END AS key FROM orders"""
)
def request_keys(spark, sf_dir):
    k = F.col("o_orderkey")
    params = F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), k.cast("string"))
    body = F.when(k % 2 == 1, F.create_map(F.lit("q"), F.lit("1")))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.request_key(F.when(k % 2 == 0, "get").otherwise("post"), F.concat(F.lit("https://h/"), "o_custkey"), params, body).alias("key"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 100)::BIGINT * 10000 WHEN 1 THEN o_orderkey WHEN 2 THEN (o_orderkey % 50)::BIGINT * 100000000 ELSE 0 END AS n FROM orders"""
)
def like_counts(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, F.concat(k % 100, F.lit("万"))).when(k % 4 == 1, F.concat(k, F.lit("+"))).when(k % 4 == 2, F.concat(k % 50, F.lit("亿"))).otherwise(F.lit("many"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.like_count(said).alias("n"))


@query("SELECT p_partkey, ['agree', 'alt_wins', 'differ', 'no_alt'][p_partkey % 4 + 1] AS verdict FROM part")
def two_readings(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    other = F.when(k == 0, F.concat(name, F.lit(" "))).when(k == 1, F.expr("substring(p_name, 1, length(p_name) - 1)")).when(k == 2, F.lit("quite another")).otherwise(F.lit(None))
    return table(spark, sf_dir, "part").select("p_partkey", C.two_reading_verdict(name, other).alias("verdict"))


@query("""SELECT event_id, props AS body, (props::JSON ->> 'k') AS k FROM events""")
def jsonp_bodies(spark, sf_dir):
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("cb.f("), "props", F.lit(");"))).otherwise(F.col("props"))
    bodies = table(spark, sf_dir, "events").select("event_id", C.unwrap_jsonp(wrapped).alias("body"))
    return report.spread_json(bodies, "body", ["event_id", "body"])


@query(
    """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name || '、' || r_name WHEN 1 THEN n_name || '；《' || r_name ELSE n_name || r_name END AS cell FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def cell_lines(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey") % 3
    cell = F.concat(F.lit("\n "), "n_name", F.lit("\n"), F.when(k == 1, "《").otherwise(""), "r_name", F.lit(" \n"))
    return n.select("n_nationkey", F.when(k == 0, grids.clean_cell(cell, "实施部门")).when(k == 1, grids.clean_cell(cell)).otherwise(grids.clean_cell(cell, "", True)).alias("cell"))


@query(
    """SELECT o_orderkey, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS priority FROM orders"""
)
def inherited_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, " ").alias("priority"))
    out = quality.inherit_blanks(o.withColumn("priority", F.when(F.trim("priority") != "", F.col("priority"))), ["o_custkey"], ["o_orderkey"], ["priority"])
    return out.select("o_orderkey", "priority")


@query(
    """WITH c AS (SELECT l_suppkey AS doc, CASE WHEN l_suppkey % 4 = 1 THEN 'col' || l_linenumber WHEN l_suppkey % 4 = 2 THEN '12.5' ELSE 'name' END AS n, CASE WHEN l_suppkey % 4 = 3 AND l_linenumber < 6 THEN '' ELSE 'v' END AS v FROM lineitem),
    r AS (SELECT doc, round(avg(starts_with(n, 'col')::INT), 4) AS fallback_rate, round(avg((v = '')::INT), 4) AS empty_rate, round(avg((n = '12.5')::INT), 4) AS numeric_rate FROM c GROUP BY doc)
    SELECT *, CASE WHEN fallback_rate >= 0.5 OR empty_rate >= 0.6 OR numeric_rate >= 0.5 THEN 'degraded' ELSE 'ok' END AS verdict FROM r"""
)
def table_verdicts(spark, sf_dir):
    k = F.col("l_suppkey") % 4
    name = F.when(k == 1, F.concat(F.lit("col"), "l_linenumber")).when(k == 2, "12.5").otherwise("name")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), name.alias("col_name"), F.when((k == 3) & (F.col("l_linenumber") < 6), " ").otherwise("v").alias("value"))
    return quality.table_quality(cells, "doc")


@query(
    r"""SELECT page_id, CASE WHEN NOT ends_with(h, '.org') THEN true WHEN ends_with(p, '.html') OR contains(p, 'page=') THEN false WHEN starts_with(p, '/en/') THEN true WHEN starts_with(p, '/e') THEN false ELSE true END AS allowed
    FROM (SELECT page_id, regexp_extract(url, '://(?:www\.)?([^/?#]+)', 1) AS h, regexp_replace(url, '^[a-z]+://[^/]*', '') AS p FROM pages)"""
)
def robots_rules(spark, sf_dir):
    """The same five lines for each host that ends in .org; the longest pattern that fits decides."""
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    lines = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(a).alias("allow")) for p, a in (("/*page=", False), ("/en/", True), ("/e", False), ("/*.html$", False), ("/", True))])
    hosts = urls.select(C.host(F.col("url")).alias("host")).distinct().where(F.col("host").endswith(".org"))
    return rows.robots_allowed(urls, hosts.select("host", F.inline(lines))).select("page_id", "allowed")


@query(
    """SELECT assertion, key, value FROM (SELECT *, row_number() OVER (PARTITION BY assertion ORDER BY key) AS i FROM (
      SELECT 'o_orderstatus!F' AS assertion, o_orderkey AS key, o_orderstatus AS value FROM orders WHERE contains(o_orderstatus, 'F') UNION ALL SELECT 'o_orderpriority+-', o_orderkey, o_orderpriority FROM orders WHERE NOT contains(o_orderpriority, '-')
      UNION ALL SELECT 'o_orderpriority!URGENT', o_orderkey, o_orderpriority FROM orders WHERE contains(o_orderpriority, 'URGENT'))) WHERE i <= 3"""
)
def assertion_rows(spark, sf_dir):
    return quality.violating_rows(table(spark, sf_dir, "orders"), ["o_orderstatus!F", "o_orderpriority+-", "o_orderpriority!URGENT"], "o_orderkey")


@query(
    """WITH RECURSIVE s AS (SELECT l_orderkey AS doc, l_quantity AS y, l_linenumber AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS i FROM lineitem),
    f(doc, i, y, x, start, line) AS (SELECT doc, i, y, x, y, 1::BIGINT FROM s WHERE i = 1
      UNION ALL SELECT s.doc, s.i, s.y, s.x, CASE WHEN f.start - s.y <= 8 THEN f.start ELSE s.y END, CASE WHEN f.start - s.y <= 8 THEN f.line ELSE f.line + 1 END FROM f JOIN s ON s.doc = f.doc AND s.i = f.i + 1)
    SELECT doc, line, string_agg('w' || x, ' ' ORDER BY x) AS text FROM f GROUP BY doc, line"""
)
def reading_order(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").alias("y"), F.col("l_linenumber").alias("x"), F.concat(F.lit("w"), "l_linenumber").alias("text"))
    return name_list.reading_order(s, "doc", 8.0)


@query(
    """SELECT r_name AS doc, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS seq, n_name AS app_name, 'co ' || n_nationkey || ' ltd' AS company_name, 'first,second' AS issues FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def list_records(spark, sf_dir):
    """A grid a region, also of regions of one name: heads, then three rows a nation, of which two go on with the company's name and a second issue; totals at the end."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.row_number().over(name_list.W.partitionBy("r_regionkey").orderBy("n_nationkey"))
    n = n.select(F.struct("r_regionkey", "r_name").alias("doc"), "n_name", "n_nationkey", place.alias("i"))
    none = F.lit("")
    cells = F.array(
        F.array(F.col("i").cast("string"), F.col("n_name"), F.concat(F.lit("co "), "n_nationkey"), F.lit("first")), F.array(none, none, F.lit(" ltd"), none), F.array(none, none, none, F.lit("second"))
    )
    lines = n.select("doc", "i", F.posexplode(cells).alias("p", "cells")).select("doc", (F.col("i") * 10 + F.col("p")).alias("row_no"), "cells")
    docs = lines.select("doc").distinct()
    heads = docs.select("doc", F.lit(0).alias("row_no"), F.array(*map(F.lit, ["序号", "应用名称", "企业名称", "所涉问题"])).alias("cells"))
    totals = docs.select("doc", F.lit(1000).alias("row_no"), F.array(F.lit("合计 9款"), none, none, none).alias("cells"))
    out = name_list.assemble(heads.unionByName(lines).unionByName(totals))
    return out.select(F.col("doc.r_name").alias("doc"), F.col("seq").cast("bigint").alias("seq"), "app_name", "company_name", F.array_join("issue_types", ",").alias("issues"))


@query("SELECT o_orderkey, greatest(1, floor(o_totalprice * 0.001))::BIGINT AS cap, greatest(0, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END, 0) + 600 - 1000)::BIGINT AS wait FROM orders")
def caps_and_waits(spark, sf_dir):
    last = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", health.margin_cap(F.col("o_totalprice"), 0.001).alias("cap"), health.cooldown(last, 600, 1000).cast("bigint").alias("wait"))


LINKS = """SELECT 'http://h' || doc_id % 3 || '/p/' || doc_id AS src, 'http://h' || (doc_id * 2 + 1) % 3 || '/p/' || (doc_id * 2 + 1) AS dst FROM documents
      UNION ALL SELECT 'http://h' || doc_id % 3 || '/p/' || doc_id, 'http://h' || (doc_id * 3 % 1000) % 3 || '/q/' || (doc_id * 3 % 1000) FROM documents"""


def _links(spark, sf_dir):
    def url(k, part="p"):
        return F.concat(F.lit("http://h"), (k % 3).cast("string"), F.lit(f"/{part}/"), k.cast("string"))

    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(url(k).alias("src"), url(k * 2 + 1).alias("dst")).unionByName(d.select(url(k).alias("src"), url(k * 3 % 1000, "q").alias("dst")))


@query(
    f"""WITH RECURSIVE e AS (SELECT * FROM ({LINKS}) WHERE regexp_matches(dst, '/[pq]/') AND NOT regexp_matches(dst, '7$') AND (starts_with(dst, 'http://h1/') OR starts_with(dst, 'http://h0/'))),
    walk(node, depth) AS (SELECT * FROM (VALUES ('http://h1/p/1', 0), ('http://h0/p/3', 0)) UNION SELECT dst, depth + 1 FROM walk JOIN e ON src = node WHERE depth < 6)
    SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node ORDER BY depth, node LIMIT 12"""
)
def crawl(spark, sf_dir):
    seeds = spark.createDataFrame([("http://h1/p/1",), ("http://h0/p/3",)], "node string")
    return relational.crawl(_links(spark, sf_dir), seeds, 6, ["/[pq]/"], ["7$"], True, 12)


@query(
    """WITH RECURSIVE links AS (SELECT 'p' || page_id AS src, 'p' || (page_id + 1) AS dst FROM pages WHERE (page_id + 1) % 10 <> 0 AND page_id % 7 <> 3),
    w(node, depth) AS (SELECT 'p' || page_id, 0 FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT dst, depth + 1 FROM w JOIN links ON src = node WHERE depth < 7) SELECT node, depth FROM w"""
)
def next_pages(spark, sf_dir):
    """Chains of pages from each tenth one on; some break off."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    links = pages.where(((k + 1) % 10 != 0) & (k % 7 != 3)).select(F.concat(F.lit("p"), k.cast("string")).alias("src"), F.concat(F.lit("p"), (k + 1).cast("string")).alias("dst"))
    return relational.next_pages(links, pages.where(k % 10 == 0).select(F.concat(F.lit("p"), k.cast("string")).alias("node")), 7)


@query("SELECT p_partkey, regexp_extract(lower(p_brand || chr(10) || p_type), 'brand.*?[0-9]+', 0) AS found, '' AS missed, '[' || p_size || '] ' || p_name || ' {no} {{no}}' AS label FROM part")
def loose_patterns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat("p_brand", F.lit("\n"), "p_type")
    return p.select("p_partkey", F.lower(rows.regex_first(text, "BRAND.*?[0-9]+", 5)).alias("found"), rows.regex_first(text, "no such").alias("missed"), rows.template("[{{p_size}}] {p_name} {no} {{no}}", p.columns).alias("label"))


@query(
    """SELECT n_nationkey, ['seq', 'company', 'store', 'issue', 'section', 'blank', 'other'][n_nationkey % 7 + 1] AS shape FROM nation"""
)
def cell_shapes(spark, sf_dir):
    cells = ["12", "某某科技有限公司", "小米 应用商店", "私自收集 个人信息", "（一）问题名单", " 　", "甲"]
    cell = F.element_at(F.array(*map(F.lit, cells)), (F.col("n_nationkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", name_list.cell_shape(cell).alias("shape"))


@query("SELECT event_id, (props::JSON ->> 'k') AS first, 'none' AS empty FROM events")
def json_heads(spark, sf_dir):
    v = F.try_parse_json(F.concat(F.lit('{"a": ['), F.get_json_object("props", "$.k"), F.lit(', 7], "b": []}')))
    return table(spark, sf_dir, "events").select("event_id", C.jpath_first(v, "a").alias("first"), C.jpath_first(v, "b", "none").alias("empty"))


@query("SELECT (count(*) - count(DISTINCT text))::BIGINT AS duplicates, 0::BIGINT AS blank FROM documents WHERE trim(text) <> ''")
def duplicates_by_chosen_key(spark, sf_dir):
    """Ids are renamed so that the title is the key that is left; it is chosen from the first rows."""
    d = table(spark, sf_dir, "documents").where("trim(text) <> ''").select(F.col("text").alias("title"), F.lit("").alias("link"), "doc_id")
    return quality.duplicates_by(d, quality.choose_key(d))


@query(
    """WITH h AS (SELECT o_custkey AS u, o_orderkey, o_orderstatus, 0 AS v FROM orders WHERE o_orderdate < '1995-01-01' UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus, 1 FROM orders WHERE o_orderdate >= '1995-01-01'),
    n AS (SELECT u, v, count(*) FILTER (o_orderstatus = 'F') AS n FROM h GROUP BY 1, 2), b AS (SELECT u, arg_max(v, n * 2 - v) AS v FROM n GROUP BY u)
    SELECT o_custkey, o_orderkey FROM (SELECT h.u AS o_custkey, o_orderkey FROM h JOIN b ON h.u = b.u AND h.v = b.v)"""
)
def fuller_versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    out = relational.fuller_version(o.where("o_orderdate < '1995-01-01'"), o.where("o_orderdate >= '1995-01-01'"), "o_custkey", F.col("o_orderstatus") == "F")
    return out.select("o_custkey", "o_orderkey")


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS kind FROM part""")
def nested_fields(spark, sf_dir):
    p = rows.nest(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "kind", {"brand": "p_brand", "size": "p_size"})
    return p.select("p_partkey", F.to_json("kind").alias("kind"))
