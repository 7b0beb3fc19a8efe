"""Task specifications: a JSON document of source, extraction, steps and checks, run as one DataFrame plan.

``{"source": {"table": ..., "kind": "html_rows|html_fields|json|rows", "row": css, "fields": {...}, "records_path": ...},
"record": {"fields": {...}}, "pipeline": [{"step": ...}], "order": [...], "limit": n}``. A specification is
checked first; every fault is told at once.
"""

from __future__ import annotations

from difflib import get_close_matches

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import columns as C
from gleanery.functions import html
from gleanery.operators import relational, rows

KINDS = ["rows", "html_rows", "html_fields", "json"]
FILTER_OPS = ["contains", "not_contains", "eq", "regex", "between", "non_empty"]


def _filter(df, s, order):
    return rows.filter_rows(df, s["field"], s.get("op", "contains"), s.get("value", s.get("pattern")), s.get("min"), s.get("max"))


def _dedup(df, s, order):
    keys = s["key"] if isinstance(s.get("key"), list) else [s["key"]]
    if keys == ["content_hash"]:
        return relational.dedup_content(df, s.get("fields") or df.columns, order)
    return relational.dedup(df, keys, order)


STEPS = {
    "filter": _filter,
    "dedup": _dedup,
    "dedup_content": lambda df, s, order: relational.dedup_content(df, s.get("fields") or [s["field"]], order),
    "rename": lambda df, s, order: rows.rename(df, s["mapping"]),
    "cast": lambda df, s, order: rows.cast(df, s["field"], s["to"]),
    "add": lambda df, s, order: rows.add(df, s["field"], s.get("value")),
    "transform": lambda df, s, order: rows.transform(df, s["field"], s["op"], s.get("format", "%Y-%m-%d %H:%M:%S")),
    "template": lambda df, s, order: df.withColumn(s.get("to", s["field"]), rows.template(s["template"], df.columns)),
    "regex_extract": lambda df, s, order: rows.regex_extract(df, s["field"], s["pattern"], s.get("group", 1), s.get("to")),
    "validate": lambda df, s, order: rows.validate_rows(df, s["field"], s.get("required", False), s.get("as"), s.get("pattern")),
    "default": lambda df, s, order: rows.fill_default(df, s["field"], s.get("value")),
    "split": lambda df, s, order: rows.split_field(df, s["field"], s.get("sep", ","), s.get("to")),
    "parse_date": lambda df, s, order: df.withColumn(s.get("to", s["field"]), C.parse_when(F.col(s["field"]), F.lit(int(s["now"])))),
}
NEEDS = {
    "filter": ["field"], "dedup": ["key"], "dedup_content": [], "rename": ["mapping"], "cast": ["field", "to"], "add": ["field"], "transform": ["field", "op"],
    "template": ["field", "template"], "regex_extract": ["field", "pattern"], "validate": ["field"], "default": ["field"], "split": ["field"], "parse_date": ["field", "now"],
}


def faults(spec: dict) -> list[str]:
    """Everything that is wrong with a specification, in plain words."""
    out = []

    def hint(word, known):
        near = get_close_matches(str(word), known, 1)
        return f"; did you mean {near[0]!r}?" if near else f"; known: {', '.join(known)}"

    known = ["source", "record", "pipeline", "order", "limit"]
    out += [f"unknown key {k!r}{hint(k, known)}" for k in spec if k not in known]
    source = spec.get("source") or {}
    if not source.get("table"):
        out.append("source.table is missing")
    kind = source.get("kind", "rows")
    if kind not in KINDS:
        out.append(f"unknown source kind {kind!r}{hint(kind, KINDS)}")
    if kind.startswith("html"):
        if not source.get("fields"):
            out.append("source.fields is missing")
        for s in [*(source.get("fields") or {}).values(), *([source.get("row", "")] if kind == "html_rows" else [])]:
            try:
                html.compile_any(s)
            except ValueError as e:
                out.append(str(e))
    for i, s in enumerate(spec.get("pipeline") or []):
        name = s.get("step")
        if name not in STEPS:
            out.append(f"step {i + 1}: unknown step {name!r}{hint(name, list(STEPS))}")
            continue
        out += [f"step {i + 1} ({name}): {k!r} is missing" for k in NEEDS[name] if k not in s]
        if name == "filter" and s.get("op", "contains") not in FILTER_OPS:
            out.append(f"step {i + 1}: unknown filter op {s['op']!r}{hint(s['op'], FILTER_OPS)}")
        pattern = s.get("pattern") or (s.get("value") if s.get("op") == "regex" else None)
        if pattern and not rows.regex_is_safe(str(pattern)):
            out.append(f"step {i + 1}: the pattern {pattern!r} is broken or may take exponential time")
    return out


def run(spark: SparkSession, spec: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """The plan of a specification over named tables. Filters on columns that need no markup run below the extraction."""
    if wrong := faults(spec):
        raise ValueError("; ".join(wrong))
    source, steps = spec["source"], list(spec.get("pipeline") or [])
    df = tables[source["table"]]
    kind = source.get("kind", "rows")
    order = [F.col(c) for c in spec.get("order") or []]
    if kind != "rows":
        keep = [c for c in df.columns if c != source.get("column", "html")]
        made = set(source.get("fields") or {}) | set((spec.get("record") or {}).get("fields") or {})
        while steps and steps[0]["step"] == "filter" and steps[0]["field"] in keep and steps[0]["field"] not in made:
            df = _filter(df, steps.pop(0), order)
        column = source.get("column", "html")
        if kind == "html_rows":
            df = html.extract_rows(df, column, source["row"], source["fields"], keep)
        elif kind == "html_fields":
            df = html.extract_fields(df, column, source["fields"], keep)
        else:
            found = C.jpath(F.try_parse_json(F.col(column)), source.get("records_path", ""))
            items = F.coalesce(F.try_variant_get(found, "$", "array<variant>"), F.array(found))
            df = df.select(*keep, F.explode(items).alias("record")).where("record is not null")
            df = df.select(*keep, *[C.jpath_text(F.col("record"), p).alias(n) for n, p in (source.get("fields") or {}).items()])
    if (spec.get("record") or {}).get("fields"):
        df = rows.map_record(df, spec["record"]["fields"], spec["record"].get("keep_raw", False))
    order = order or [F.col(c) for c in df.columns if c != "record"]
    for s in steps:
        df = STEPS[s["step"]](df, s, order)
    if spec.get("limit"):
        df = df.orderBy(*order).limit(int(spec["limit"]))
    return df
