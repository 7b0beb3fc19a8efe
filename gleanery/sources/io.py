"""Readers and sinks: JSON, CSV and line sources with encodings, sitemaps, captured responses; safe exports."""

from __future__ import annotations

import codecs
import contextlib
import csv
import gzip
import io
import json as jsonlib
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import columns as C
from gleanery.functions import pages

#: Keys under which APIs put their records, in order.
RECORD_KEYS = ["records", "items", "list", "results", "data", "announcements", "rows", "dataList"]
ENCODINGS = ["utf-8-sig", "utf-8", "gb18030"]


def decode_bytes(body: bytes | None, header: str = "") -> str | None:
    """Text of a response, unpacked if it is gzip: byte-order mark, header, meta tag, then the first encoding that fits."""
    if body is None:
        return None
    if body[:2] == b"\x1f\x8b":
        with contextlib.suppress(OSError, EOFError, zlib.error):
            body = gzip.decompress(body)
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    named = re.search(r"charset=[\"']?([\w-]+)", header or "") or re.search(rb"charset=[\"']?([\w-]+)", body[:4096])
    names = [named[1] if isinstance(named[1], str) else named[1].decode()] if named else []
    for name in [*names, *ENCODINGS]:
        try:
            return body.decode("gb18030" if name.lower() in ("gb2312", "gbk") else name)
        except (UnicodeDecodeError, LookupError):
            continue
    return body.decode("utf-8", "replace")


def decoded(body: Column) -> Column:
    """Binary responses as text, in Arrow batches, a bounded number of bytes at a time."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in C.portions(batches):
            yield pa.array([decode_bytes(b) for b in part.to_pylist()], pa.string())

    return run(body)


def read_records(spark: SparkSession, path: str, records_path: str = "") -> DataFrame:
    """VARIANT records of JSON documents (one a file): by path, or under the first known key, or the document itself."""
    docs = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    if records_path:
        found = [C.jpath(F.col("v"), records_path)]
    else:
        found = [F.col("v"), *[F.try_variant_get("v", f"$['{k}']", "variant") for k in RECORD_KEYS]]
    lists = [F.try_variant_get(x, "$", "array<variant>") for x in found]
    return docs.select(F.explode(F.coalesce(*lists, F.array("v"))).alias("record")).where("record is not null")


def capture_records(spark: SparkSession, path: str, records_path: str = "") -> DataFrame:
    """VARIANT records of captured responses (files that hold a list of them, each bare or under ``json``), by a path; what a path
    leads to counts as one record if it is no list. A file may hold many such lists, one a line: it does if its first line is whole by
    itself. What is no list, and records that are no objects, give nothing."""
    body = F.regexp_replace("value", r"^\s+", "")
    lines = F.split(body, r"\r?\n")
    docs = F.when(F.try_parse_json(F.get(lines, 0)).isNotNull(), lines).otherwise(F.array(body))
    files = spark.read.text(path, wholetext=True).select(F.explode(docs).alias("value")).select(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>").alias("l"))
    items = files.select(F.explode("l").alias("i")).select(F.coalesce(F.try_variant_get("i", "$.json", "variant"), F.col("i")).alias("v"))
    found = items.select(C.jpath(F.col("v"), records_path).alias("v")) if records_path else items
    rows = found.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).alias("record"))
    return rows.where(F.schema_of_variant("record").startswith("OBJECT"))


def guessed_records_path(docs: DataFrame, column: str) -> str:
    """The records path of a JSON column, read off one document when the plan is made; '' if it is no JSON."""
    row = docs.where(F.try_parse_json(column).isNotNull()).select(column).first()
    return pages.records_path(jsonlib.loads(row[0])) if row else ""


#: Files above this size are taken for UTF-8 (CSV) or JSON lines and never read whole.
WHOLE = 1 << 30


def fitting(body: bytes) -> str:
    """UTF-8 if all of the bytes are, else GB18030."""
    try:
        body.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        return "GB18030"


def read_csv(spark: SparkSession, path: str | list[str], encoding: str | None = None, multi_line: bool = True) -> DataFrame:
    """All columns as text. Without an encoding each file of up to ``WHOLE`` bytes is UTF-8 if all of it is, else GB18030.

    ``multi_line=False`` lets Spark split large files; cells then hold no line breaks. Spark's reader takes UTF-8 and its kin; files in
    other encodings are decoded whole in Arrow batches and parsed line by line, so their quoted cells hold no line breaks.
    """
    if encoding is None:
        files = spark.read.format("binaryFile").load(path)
        small = F.pandas_udf(lambda b: b.map(lambda x: fitting(bytes(x))), "string")("content")
        kinds = files.where(F.col("length") <= WHOLE).select("path", small.alias("kind")).unionByName(files.where(F.col("length") > WHOLE).select("path", F.lit("UTF-8").alias("kind")))
        by_kind: dict[str, list[str]] = {}
        for r in kinds.collect():  # a row a file
            by_kind.setdefault(r["kind"], []).append(r["path"])
        parts = [read_csv(spark, sorted(p), k, multi_line) for k, p in sorted(by_kind.items(), reverse=True)]
        out = parts[0] if parts else read_csv(spark, path, "UTF-8", multi_line)
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
    if encoding.lower() in ("utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32", "us-ascii", "iso-8859-1"):
        return spark.read.csv(path, header=True, encoding=encoding, multiLine=multi_line, escape='"')

    def decode(body: pd.Series) -> pd.Series:
        return body.map(lambda b: bytes(b).decode(encoding, "replace"))

    lines = F.split(F.pandas_udf(decode, "string")("content"), "\r?\n")
    files = spark.read.format("binaryFile").load(path).select(lines.alias("l"))
    head = files.select(F.element_at("l", 1).alias("h")).first()
    names = next(csv.reader([head["h"]])) if head else ["value"]
    schema = T.StructType([T.StructField(n or f"col{i + 1}", T.StringType()) for i, n in enumerate(names)])
    rows = files.select(F.explode(F.slice("l", 2, 1 << 30)).alias("l")).where("l <> ''")
    return rows.select(F.from_csv("l", _ddl(schema), {"escape": '"'}).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` string" for f in schema.fields)


#: Keys that wrap a file's records, in order.
WRAPPERS = ["data", "list", "rows", "items"]


def file_records(body: bytes, data_key: str = "") -> list[str] | None:
    """A JSON or JSON lines file's records as JSON texts; None if the file is no JSON (so CSV).

    An object is unwrapped by ``data_key`` (dotted), else by the first of ``WRAPPERS`` that holds a list, else by the only
    path that leads to a list of objects; of several none is chosen, and the object is the record.
    """
    text = decode_bytes(body).lstrip("\ufeff")
    if text.lstrip()[:1] not in ("{", "["):
        return None
    try:
        value = jsonlib.loads(text)
    except ValueError:
        return [jsonlib.dumps(jsonlib.loads(x), ensure_ascii=False) for x in text.split("\n") if x.strip()]
    if isinstance(value, dict):
        if data_key:
            for part in data_key.split("."):
                value = value[part]
        else:
            wrapped = next((value[k] for k in WRAPPERS if isinstance(value.get(k), list)), None)
            found = [v for v in value.values() if isinstance(v, list) and v and isinstance(v[0], dict)]
            value = wrapped if wrapped is not None else found[0] if len(found) == 1 else value
    return [jsonlib.dumps(x, ensure_ascii=False) for x in (value if isinstance(value, list) else [value])]


def read_any(spark: SparkSession, path: str, data_key: str = "") -> DataFrame:
    """JSON, JSON lines or CSV, told by what each file holds and not by its name; larger files than ``WHOLE`` by their name.

    Records of JSON files get one schema over all files; CSV columns are text. With both, columns are joined by name as text.
    """
    files = spark.read.format("binaryFile").load(path)
    records = F.pandas_udf(lambda b: b.map(lambda x: file_records(bytes(x), data_key)), "array<string>")
    read = files.where(F.col("length") <= WHOLE).select("path", records("content").alias("r"))
    kinds = read.select("path", F.col("r").isNotNull().alias("json")).collect()  # a row a file
    tables = [r["path"] for r in kinds if not r["json"]]
    large = [r["path"] for r in files.where(F.col("length") > WHOLE).select("path").collect()]
    parts = []
    if any(r["json"] for r in kinds):
        rows = read.where("r is not null").select(F.explode("r").alias("r")).select(F.try_parse_json("r").alias("v")).where("v is not null")
        kind = rows.agg(F.schema_of_variant_agg("v").alias("s")).first()["s"]
        if kind.startswith("OBJECT<"):
            parts.append(rows.select(F.try_variant_get("v", "$", kind.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")).alias("r")).select("r.*"))
        else:
            parts.append(rows.select(F.to_json("v").alias("value")))
    if lines := [p for p in large if p.endswith((".json", ".jsonl", ".ndjson"))]:
        parts.append(spark.read.json(lines))
    if tables or len(lines) < len(large):
        parts.append(read_csv(spark, tables + [p for p in large if p not in lines]))
    if len(parts) > 1:
        parts = [p.select(*[F.col(f"`{c}`").cast("string").alias(c) if not isinstance(p.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(f"`{c}`").alias(c) for c in p.columns]) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sitemap_urls(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))


def expand_sitemaps(captured: DataFrame, seeds: list[str], max_depth: int = 5) -> DataFrame:
    """Page URLs of sitemaps among captured (url, body) responses; index files are followed, each once."""
    from gleanery.operators.relational import reachable_nodes

    links = captured.select(F.col("url").alias("src"), F.explode(sitemap_urls(F.col("body"))).alias("dst"))
    start = captured.sparkSession.createDataFrame([(s,) for s in seeds], "node string")
    nodes = reachable_nodes(links, start, max_depth)
    return nodes.join(links.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("url"), "depth")


def delimited_lines(df: DataFrame, text: str, pattern: str, names: list[str], sep: str = ",") -> DataFrame:
    """``var hq_str_X="a,b,c"`` lines as rows: the pattern's first group is the key, its second the fields by place."""
    lines = df.select(F.explode(F.split(F.col(text), "\n")).alias("l")).where(F.col("l").rlike(pattern))
    parts = F.split(F.regexp_extract("l", pattern, 2), re.escape(sep))
    return lines.select(F.regexp_extract("l", pattern, 1).alias("key"), *[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def page_links(df: DataFrame, html: str, url: str, keep: list[str]) -> DataFrame:
    """(keep, link): hrefs outside comments and scripts, entities undone, absolute, without fragment, distinct by page."""
    body = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    raw = F.regexp_extract_all(body, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    links = df.select(*keep, F.col(url).alias("__base"), F.explode(raw).alias("link"))
    link = F.replace(F.replace(F.col("link"), F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"'))
    out = links.where(~link.rlike("(?i)^(javascript|mailto|tel|data):")).withColumn("link", F.regexp_replace(C.absolute_url(link, F.col("__base")), "#.*$", ""))
    return out.where("link <> ''").select(*keep, "link").distinct()


def flat_text(df: DataFrame) -> DataFrame:
    """All columns as text, nested ones as JSON."""
    out = []
    for f in df.schema.fields:
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
        out.append((F.to_json(F.col(f.name)) if nested else F.col(f.name).cast("string")).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    safe = flat_text(df)
    safe.select(*[C.spreadsheet_safe(F.col(c)).alias(c) for c in safe.columns]).write.csv(path, header=True, mode=mode, escape='"')


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.json(path, mode=mode, ignoreNullFields=False)


def write_parquet(df: DataFrame, path: str, all_text: bool = False, mode: str = "errorifexists") -> None:
    (flat_text(df) if all_text else df).write.parquet(path, mode=mode)


def append_rows(df: DataFrame, path: str) -> None:
    """More rows of a table whose columns may grow; ``read_grown`` gives them with the columns of all."""
    df.write.mode("append").parquet(path)


def read_grown(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``append_rows`` with the union of their columns; what an earlier row did not have is null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_snapshot(new: DataFrame, path: str, url: str = "url", body: str = "body") -> DataFrame:
    """Append responses whose (url, content hash) the snapshot folder does not hold yet; returns what was new."""
    spark = new.sparkSession
    hashed = new.withColumn("sha256", F.sha2(F.col(body).cast("string"), 256)).withColumn("chars", F.length(body))
    try:
        old = spark.read.parquet(path).select(url, "sha256")
        hashed = hashed.join(old, [url, "sha256"], "left_anti")
    except Exception as e:  # the first snapshot
        if "PATH_NOT_FOUND" not in str(e):
            raise
    from gleanery.session import cut_lineage

    fresh = cut_lineage(hashed.dropDuplicates([url, "sha256"]))
    fresh.write.mode("append").parquet(path)
    return fresh


def markdown_table(df: DataFrame, rows: int = 50) -> str:
    """A small result as a Markdown table (a report of ``rows`` rows)."""
    head = [f"| {' | '.join(df.columns)} |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in df.limit(rows).collect()])


def sheet_rows(body: bytes) -> list[list[str]]:
    """Rows of the first sheet of an XLSX file."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(space + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(space + "si")]
        out = []
        for row in ElementTree.fromstring(z.read(names[0])).iter(space + "row") if names else []:
            cells: dict[int, str] = {}
            for i, c in enumerate(row.iter(space + "c")):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters[0]))) - 1 if letters else i
                v = c.find(space + "v")
                text = "".join(t.text or "" for t in c.iter(space + "t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, cells) of the first sheet of each file; broken files give no rows. Feed ``name_list.assemble`` or pick columns."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                try:
                    rows = sheet_rows(b.column(1)[i].as_py())
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError):
                    rows = []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[i].as_py()] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["path", "row_no", "cells"]
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row_no int, cells array<string>")


def distinct_files(spark: SparkSession, path: str) -> DataFrame:
    """Files by content: sha256, the first path, how many there are."""
    files = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), "path", "length")
    return files.groupBy("sha256").agg(F.min("path").alias("path"), F.min("length").alias("length"), F.count("*").alias("copies"))


def danmaku_rows(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """Timed comments ``<d p="second,mode,size,color,...">text</d>`` as rows."""
    items = df.select(*keep, F.explode(F.regexp_extract_all(xml, F.lit(r"(<d p=\"[^\"]*\">[^<]*</d>)"), F.lit(1))).alias("d"))
    p = F.split(F.regexp_extract("d", r'p="([^"]*)"', 1), ",")
    return items.select(*keep, F.get(p, 0).try_cast("double").alias("second"), F.get(p, 1).try_cast("int").alias("mode"), F.get(p, 3).try_cast("int").alias("color"), F.regexp_extract("d", ">([^<]*)<", 1).alias("text"))


def feature_rows(df: DataFrame, json: str, properties: list[str], times: list[str] = ()) -> DataFrame:
    """GeoJSON features as rows: properties, coordinates by place, millisecond times as text in UTC+8."""
    feature = F.explode(F.try_variant_get(F.try_parse_json(F.col(json)), "$.features", "array<variant>")).alias("f")
    v = df.select(feature)
    cols = [F.try_variant_get("f", f"$.properties['{p}']", "string").alias(p) for p in properties]
    cols += [C.unix_to_datetime(F.try_variant_get("f", f"$.properties['{t}']", "string")).alias(t) for t in times]
    xyz = [F.try_variant_get("f", f"$.geometry.coordinates[{i}]", "double").alias(n) for i, n in enumerate(("lon", "lat", "depth"))]
    return v.select(*cols, *xyz)


def api_paths(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Distinct request paths in script text, with the method if one stands before."""
    found = F.regexp_extract_all(text, F.lit(r"""((?:(?:get|post|put|delete)\s*\(\s*)?["'`]/(?:api|v\d+|rest|graphql)[\w/.{}$-]*)"""), F.lit(1))
    rows = df.select(*keep, F.explode(found).alias("x"))
    return rows.select(*keep, F.upper(F.regexp_extract("x", r"^(get|post|put|delete)", 1)).alias("method"), F.regexp_extract("x", r"(/.*)$", 1).alias("path")).distinct()


def find_objects(df: DataFrame, json: str, keys: list[str], keep: list[str], depth: int = 8) -> DataFrame:
    """JSON objects at any place, down to ``depth``, that have all the given keys; each as JSON text."""
    source = df.select(*keep, F.col(json).alias("__json"))
    schema = T.StructType([*[source.schema[k] for k in keep], T.StructField("object", T.StringType())])

    def walk(x, left):
        if isinstance(x, dict):
            if all(k in x for k in keys):
                yield x
            x = list(x.values())
        if isinstance(x, list) and left:
            for y in x:
                yield from walk(y, left - 1)

    def run(batches):
        for b in batches:
            index, found = [], []
            for i, t in enumerate(b.column("__json").to_pylist()):
                try:
                    hits = list(walk(jsonlib.loads(t or "null"), depth))
                except ValueError:
                    hits = []
                found += [jsonlib.dumps(h, ensure_ascii=False) for h in hits]
                index += [i] * len(hits)
            take = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in keep], pa.array(found, pa.string())], [*keep, "object"])

    return source.mapInArrow(run, schema)


def next_requests(pages: DataFrame, page: str, size: int, total: str) -> DataFrame:
    """The pages that a paged answer says are still to come: (page, offset)."""
    last = F.ceil(F.col(total) / size)
    todo = pages.groupBy().agg(F.max(last).alias("last"), F.max(page).alias("now")).where("last > now")
    return todo.select(F.explode(F.sequence(F.col("now").cast("long") + 1, F.col("last").cast("long"))).alias("page")).withColumn("offset", (F.col("page") - 1) * size)
