"""Specifications out of captured requests: which parameter turns the page, where the records are, what their fields are.

``parameters`` looks at all values that each parameter of an endpoint took: one value is a constant; whole numbers in steps of one are a page number, in steps of the page's
size (the parameter that is constant and equal to the step, or the records that come) an offset; anything else is a key. Values are summed up by endpoint and parameter
before any shuffle, so an endpoint with most of the requests is no hot spot. ``shapes`` merges the schemas of all bodies of an endpoint; the records are the first list of objects in it, by the keys that
usually hold them. ``specification`` puts both together, as ``spec.run`` takes it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import pages
from gleanery.session import cut_lineage

#: Names of page numbers and of offsets, which decide where the values leave it open.
PAGE_NAMES = ["pageNo", "currentPage", "pageIndex", "pageNum", "page"]
OFFSET_NAMES = ["offset", "start", "skip", "from"]


def requests(captured: DataFrame, url: str = "url", method: str = "method", sent: str = "post_data", body: str = "body") -> DataFrame:
    """(endpoint, params, body): parameters are those of the query string, and the top-level ones of a JSON or form body as ``body.<name>``."""
    plain = F.regexp_replace(F.col(url), "#.*$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    way = F.upper(F.coalesce(F.col(method), F.lit("GET")))

    def pairs(text: Column) -> Column:
        parts = F.filter(F.split(text, "&"), lambda p: p != "")
        return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("name"), F.regexp_extract(p, "=(.*)$", 1).alias("value")))

    posted = F.coalesce(F.col(sent), F.lit(""))
    fields = F.from_json(posted, "map<string,string>")
    is_json = F.ltrim(posted).startswith("{")
    form = F.when(~is_json & posted.contains("="), pairs(posted)).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    held = F.when(is_json, F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))).otherwise(form)
    named = F.transform(F.coalesce(held, F.array().cast("array<struct<name:string,value:string>>")), lambda x: F.struct(F.concat(F.lit("body."), x["name"]).alias("name"), x["value"].alias("value")))
    params = F.concat(pairs(query), named)
    return captured.select(F.concat(way, F.lit(" "), F.regexp_replace(plain, r"\?.*$", "")).alias("endpoint"), params.alias("params"), F.col(body).alias("body"))


def parameters(asked: DataFrame) -> DataFrame:
    """(endpoint, name, kind, start, step, value): kind is constant, page, offset or key; value is that of a constant, else null."""
    rows = asked.select("endpoint", F.explode("params").alias("p")).select("endpoint", "p.name", "p.value")
    number = F.when(F.col("value").rlike(r"^\d{1,18}$"), F.col("value").cast("bigint"))
    values = cut_lineage(rows.select("endpoint", "name", "value", number.alias("n")).distinct())
    summed = values.groupBy("endpoint", "name").agg(
        F.count("*").alias("kinds"), F.count("n").alias("numbers"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("value").alias("one")
    )
    # n different whole numbers lie in equal steps if the span is n - 1 steps and each is a number of steps from the least
    step = F.when((F.col("numbers") == F.col("kinds")) & (F.col("kinds") > 1) & ((F.col("high") - F.col("low")) % (F.col("kinds") - 1) == 0), ((F.col("high") - F.col("low")) / (F.col("kinds") - 1)).cast("bigint"))
    summed = summed.withColumn("step", step)
    off = values.join(F.broadcast(summed.where("step is not null").select("endpoint", "name", "low", "step")), ["endpoint", "name"]).where((F.col("n") - F.col("low")) % F.col("step") != 0)
    summed = summed.join(off.select("endpoint", "name").distinct().withColumn("uneven", F.lit(True)), ["endpoint", "name"], "left")
    last = F.regexp_replace("name", r"^.*\.", "")
    even = F.col("step").isNotNull() & F.col("uneven").isNull()
    kind = (
        F.when(F.col("kinds") == 1, "constant")
        .when(even & (F.col("step") == 1) & (F.col("low") <= 1), "page")
        .when(even & ((F.col("low") == 0) | last.isin(OFFSET_NAMES)) & (F.col("step") > 1), "offset")
        .when((F.col("numbers") == F.col("kinds")) & last.isin(PAGE_NAMES), "page")
        .otherwise("key")
    )
    return summed.select("endpoint", "name", kind.alias("kind"), F.when(kind.isin("page", "offset"), F.col("low")).alias("start"), F.when(kind.isin("page", "offset"), F.coalesce("step", F.lit(1))).alias("step"), F.when(kind == "constant", F.col("one")).alias("value"))


def shapes(asked: DataFrame) -> DataFrame:
    """(endpoint, n_requests, shape): the merged schema of all JSON bodies of an endpoint; null if there is none."""
    v = F.try_parse_json("body")
    return asked.select("endpoint", v.alias("v")).groupBy("endpoint").agg(F.count("*").alias("n_requests"), F.schema_of_variant_agg("v").alias("shape"))


def _example(kind: T.DataType):
    """A value of that type, so that what is known of JSON documents can be asked of schemas."""
    if isinstance(kind, T.StructType):
        return {f.name: _example(f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType):
        return [_example(kind.elementType)]
    return None


def records_and_fields(shape: str | None) -> tuple[str | None, dict[str, str]]:
    """The path of the records ('.': the document is the list; '': it is the record; None: no JSON) and their fields' paths by name; nested objects give names with underscores."""
    if not shape or shape.startswith("VOID"):
        return None, {}
    kind = T.DataType.fromDDL(shape.replace("OBJECT<", "STRUCT<").replace("OBJECT", "STRING").replace("VOID", "STRING"))
    path = pages.records_path(_example(kind))
    for part in path.split(".") if path not in ("", ".") else ():
        kind = kind[part].dataType
    if isinstance(kind, T.ArrayType):
        kind = kind.elementType
    fields: dict[str, str] = {}

    def walk(struct: T.StructType, before: tuple[str, ...]):
        for f in struct:
            if isinstance(f.dataType, T.StructType) and len(f.dataType):
                walk(f.dataType, (*before, f.name))
            else:
                fields["_".join((*before, f.name))] = ".".join((*before, f.name))

    if isinstance(kind, T.StructType):
        walk(kind, ())
    return path, fields


def specification(endpoint: str, shape: str | None, params: list[tuple], table: str = "captured", column: str = "body") -> tuple[dict | None, dict]:
    """A specification for ``spec.run`` over captured bodies (None without records), and how the endpoint is asked for a page.

    ``params`` are rows of ``parameters``: (name, kind, start, step, value).
    """
    method, url = endpoint.split(" ", 1)
    turning = [(n, k, start, step) for n, k, start, step, _ in params if k in ("page", "offset")]
    turning.sort(key=lambda x: (x[0].split(".")[-1] not in PAGE_NAMES + OFFSET_NAMES, x[0]))
    ask: dict = {"method": method, "url": url, "params": {n: v for n, k, *_, v in params if k == "constant"}, "keys": sorted(n for n, k, *_ in params if k == "key")}
    for at, (name, kind, start, step) in enumerate(turning):
        if at == 0:
            ask["paging"] = {"param": name, "kind": kind, "start": start, "step": step}
            ask["params"][name] = "{{page}}" if kind == "page" else "{{offset}}"
        else:
            ask["keys"] = sorted([*ask["keys"], name])
    path, fields = records_and_fields(shape)
    if path is None or not fields:
        return None, ask
    source = {"table": table, "kind": "json", "column": column, "records_path": "" if path == "." else path, "fields": fields}
    return {"source": source}, ask


def specifications(captured: DataFrame, **columns: str) -> dict[str, tuple[dict | None, dict]]:
    """A specification and the way of asking for each endpoint of captured (url, method, post_data, body); a few rows an endpoint come to the driver."""
    asked = cut_lineage(requests(captured, **columns))
    params: dict[str, list[tuple]] = {}
    for r in parameters(asked).orderBy("endpoint", "name").collect():
        params.setdefault(r["endpoint"], []).append(tuple(r)[1:])
    return {r["endpoint"]: specification(r["endpoint"], r["shape"], params.get(r["endpoint"], []), column=columns.get("body", "body")) for r in shapes(asked).orderBy("endpoint").collect()}


def of_endpoint(captured: DataFrame, endpoint: str, url: str = "url", method: str = "method") -> DataFrame:
    """The captured rows of one endpoint."""
    way = F.upper(F.coalesce(F.col(method), F.lit("GET")))
    return captured.where(F.concat(way, F.lit(" "), F.regexp_replace(F.col(url), "[?#].*$", "")) == endpoint)


def as_json(found: dict) -> str:
    return json.dumps(found, ensure_ascii=False, sort_keys=True)
