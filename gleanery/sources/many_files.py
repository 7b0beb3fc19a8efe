"""Tables out of many files of mixed kinds, with an account of each file.

One pass reads every file once, tells its kind by what it holds, and gives its rows of cells or what went wrong; a broken file costs its own rows only.
From that scan come the records (``name_list``) and the diagnostics: a file without rows is told of as well as one that failed.

Lists that were published twice become one: files are taken in the order of their names, and a file whose set of names overlaps that of one taken
before in nine tenths of the larger follows it. Of a list's files the one stays with the fewest names that have the version stuck to them, the first of those.
"""

from __future__ import annotations

import csv
import io as bytesio
import json
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import columns as C
from gleanery.operators import name_list, relational
from gleanery.session import cut_lineage, join_small
from gleanery.sources import io

#: Fixed value: what the heading of a list of repeated findings holds.
AGAIN = "复测"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def document_rows(body: bytes) -> list[list[str]]:
    """The rows of all tables of a DOCX file; a cell's paragraphs are lines."""
    with zipfile.ZipFile(bytesio.BytesIO(body)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for line in root.iter(f"{WORD}tr"):
        cells = []
        for c in line.findall(f"{WORD}tc"):
            cells.append("\n".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in c.iter(f"{WORD}p")).strip())
        out.append(cells)
    return out


def record_rows(records: list[str]) -> list[list[str]]:
    """JSON records as a head and rows; what is no object has one column."""
    values = [json.loads(r) for r in records]
    values = [v if isinstance(v, dict) else {"value": v} for v in values]
    names = list(dict.fromkeys(k for v in values for k in v))
    text = [[x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False) for x in (v.get(n) for n in names)] for v in values]
    return [names, *text] if values else []


def file_rows(body: bytes) -> tuple[str, list[list[str]]]:
    """The chain that read the file, and its rows of cells. Raises what the chain raises."""
    if body[:4] == b"PK\x03\x04":
        kind = C.container_kind(body)
        if kind == "docx":
            return kind, document_rows(body)
        return "xlsx", io.sheet_rows(body)  # a broken directory is told of here
    if body[:4] == b"%PDF" or b"\0" in body[:1024]:
        raise ValueError("no table can be read from this kind of file")
    found = io.file_records(body)
    if found is not None:
        return "json", record_rows(found)
    return "csv", [r for r in csv.reader(bytesio.StringIO(io.decode_bytes(body).lstrip("﻿"))) if r]


def scan(files: DataFrame) -> DataFrame:
    """(path, chain, error, cells) of files (path, content); each is read once. ``chain`` is null where reading failed."""

    def run(batches):
        for b in batches:
            for path, body in zip(b.column(0).to_pylist(), b.column(1)):
                chain, rows, error = None, [], None
                try:
                    chain, rows = file_rows(body.as_py() or b"")
                except Exception as e:  # noqa: BLE001  told in the account
                    error = f"{type(e).__name__}: {e}"[:200]
                columns = [pa.array([path]), pa.array([chain], pa.string()), pa.array([error], pa.string()), pa.array([rows], pa.list_(pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "chain", "error", "cells"])

    return files.select("path", "content").mapInArrow(run, "path string, chain string, error string, cells array<array<string>>")


def leaders(pairs: DataFrame, most: int = 100) -> DataFrame:
    """(member, leader) for pairs (a, b) of similar names, a before b: in order, a name leads if no leader before it is similar to it,
    else it follows the first that is. Rounds grow with the longest chain of names each of which keeps the next from leading."""
    pairs = cut_lineage(pairs.where("a < b").distinct())
    rest, following = pairs, None
    for _ in range(most):
        if rest.isEmpty():
            led = pairs if following is None else pairs.join(following.withColumnRenamed("name", "a"), "a", "left_anti")
            return led.groupBy("b").agg(F.min("a").alias("leader")).withColumnRenamed("b", "member")
        before = rest.select(F.col("b").alias("a")).distinct()
        heads = rest.join(before, "a", "left_anti")  # names with nothing before them lead
        gone = heads.select(F.col("b").alias("name")).distinct()
        following = cut_lineage(gone if following is None else following.unionByName(gone).distinct())
        out = rest.join(heads.select("a").distinct(), "a", "left_anti")
        for end in ("a", "b"):  # who follows keeps nobody else from leading
            out = out.join(following.withColumnRenamed("name", end), end, "left_anti")
        rest = cut_lineage(out.select("a", "b"))
    raise RuntimeError("lists did not settle")


def tables_of(files: DataFrame, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Records of the files (path, content) and the account of each file.

    Records: ``name_list``'s, with ``source_file`` and ``list_kind``. Account: path, chain, n_rows (records), error, and ``part``: ``kept``, ``same list``
    with ``kept_file``, or ``nothing``.
    """
    read = cut_lineage(scan(files))
    grid = read.where("size(cells) > 0").select(F.col("path").alias("doc"), F.posexplode("cells").alias("row_no", "cells"))
    records = cut_lineage(name_list.merge_sources(name_list.assemble(grid)))
    version, name = name_list.squeeze(F.col("version")), name_list.squeeze(F.col("app_name"))
    glued = F.count_if((version != "") & name.endswith(version))
    lists = cut_lineage(records.groupBy("doc").agg(F.count("*").alias("n_rows"), glued.alias("glued"), F.collect_set(F.when(name != "", name)).alias("names")))

    named = lists.where("size(names) > 0")
    equal = cut_lineage(named.withColumn("head", F.xxhash64(F.array_sort("names"))).select("doc", "names", F.min("doc").over(name_list.W.partitionBy("head")).alias("head")))
    similar = relational.similar_sets(equal.where("doc = head").select("doc", "names"), "doc", "names", share)
    led = leaders(similar.select("a", "b"))
    groups = join_small(equal.select("doc", "head"), led.withColumnRenamed("member", "head"), "head").select("doc", F.coalesce("leader", "head").alias("leader"))
    groups = groups.unionByName(lists.where("size(names) = 0").select("doc", F.col("doc").alias("leader")))
    ranked = groups.join(lists.select("doc", "glued", "n_rows"), "doc")
    best = ranked.groupBy("leader").agg(F.min_by("doc", F.struct("glued", "doc")).alias("kept_file"))
    places = cut_lineage(ranked.join(best, "leader").select("doc", "n_rows", "kept_file"))

    heading = F.concat_ws(" ", F.element_at("cells", 1))
    kinds = read.where("size(cells) > 0").select(F.col("path").alias("doc"), F.when(F.contains(heading, F.lit(AGAIN)), AGAIN).otherwise("").alias("list_kind"))
    kept = places.where("doc = kept_file").select("doc").join(kinds, "doc")
    out = records.join(kept, "doc").withColumnRenamed("doc", "source_file")
    account = read.select(F.col("path").alias("doc"), "chain", "error").join(places, "doc", "left")
    part = F.when(F.col("kept_file").isNull(), "nothing").when(F.col("kept_file") == F.col("doc"), "kept").otherwise("same list")
    return out, account.select(F.col("doc").alias("path"), "chain", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), "error", part.alias("part"), "kept_file")


def read_many(spark: SparkSession, path: str | list[str], share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """``tables_of`` all files of a path."""
    return tables_of(spark.read.format("binaryFile").load(path), share)
