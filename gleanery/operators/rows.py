"""Row operators: predicates, field mapping and cleaning steps, each a function from DataFrame to DataFrame.

Missing values count as the empty string in text predicates. Steps never fail on dirty values.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import columns as C
from gleanery.functions import patterns

#: Hints in class names and texts of pages that block readers.
BLOCK_WORDS = ["captcha", "access denied", "are you a robot", "unusual traffic", "verify you are human", "请输入验证码", "访问过于频繁", "安全验证"]


# predicates


def matches(field: str, op: str = "contains", value=None, low=None, high=None) -> Column:
    """One of contains, not_contains, eq, regex, between (half open, unparsable values pass), non_empty."""
    c = F.col(field)
    s = C.text(c)
    if op == "contains":
        return s.contains(str(value))
    if op == "not_contains":
        return ~s.contains(str(value)) if str(value) else F.lit(True)
    if op == "eq":
        return s == str(value)
    if op == "regex":
        return patterns.search(s, str(value)) if regex_is_safe(str(value)) else F.lit(True)
    if op == "non_empty":
        return ~C.is_blank(c)
    if op == "between":
        x = C.plain_number(c)
        inside = F.lit(True)
        if low is not None:
            inside = inside & (x >= float(low))
        if high is not None:
            inside = inside & (x < float(high))
        return x.isNull() | inside
    raise ValueError(f"unknown filter op {op!r}; known: contains not_contains eq regex between non_empty")


def filter_rows(df: DataFrame, field: str, op: str = "contains", value=None, low=None, high=None) -> DataFrame:
    return df.where(matches(field, op, value, low, high)) if field in df.columns else df


def validate_rows(df: DataFrame, field: str, required: bool = False, kind: str | None = None, pattern: str | None = None) -> DataFrame:
    """Drop rows whose field is blank (if required), not of the kind (int, float, str), or not like the pattern."""
    c, blank = F.col(field), C.is_blank(F.col(field))
    good = ~blank if required else F.lit(True)
    if kind in ("int", "float"):
        good = good & (blank | (C.cast_int(c) if kind == "int" else C.cast_float(c)).isNotNull())
    if pattern is not None and regex_is_safe(pattern):
        good = good & (blank | patterns.search(C.text(c), pattern))
    return df.where(good)


def regex_is_safe(pattern: str) -> bool:
    """False for patterns that do not compile or whose search can take more than linear time with every engine there is."""
    return patterns.usable(pattern)


def pattern_growth(df: DataFrame, field: str) -> DataFrame:
    """``<field>_growth``, ``<field>_power`` and ``<field>_engine`` of patterns in a column; null patterns have none."""
    kind = T.StructType([T.StructField("growth", T.StringType()), T.StructField("power", T.IntegerType()), T.StructField("engine", T.StringType())])

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        rows = [None if p is None else {**dict(zip(("growth", "power"), patterns.growth(p))), "engine": patterns.engine(p)} for p in values.to_pylist()]
        return pa.array(rows, pa.struct([("growth", pa.string()), ("power", pa.int32()), ("engine", pa.string())]))

    found = df.withColumn("__found", run(F.col(field).cast("string")))
    names = [c for c in df.columns if c not in {f"{field}_{n}" for n in kind.names}]
    return found.select(*names, *[F.col(f"__found.{n}").alias(f"{field}_{n}") for n in kind.names])


def has_private_use(df: DataFrame) -> dict[str, bool]:
    """For each text column, does some value hold private-use characters (fonts that hide text)? One aggregation."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")]
    if not names:
        return {}
    row = df.agg(*[F.coalesce(F.bool_or(F.col(c).rlike("[\\uE000-\\uF8FF]")), F.lit(False)).alias(c) for c in names]).first()
    return row.asDict()


def mostly(c: Column, many: str, few: str, reach: int = 20_000, least: int = 10) -> Column:
    """Does a text hold over ``least`` characters of ``many``, and over twice as many as of ``few``? (Script variants.)"""
    head = F.substring(C.text(c), 1, reach)
    a, b = (F.length(head) - F.length(F.translate(head, chars, "")) for chars in (many, few))
    return (a > 2 * b) & (a > least)


#: Words of a task's description that name no subject.
STOP_WORDS = ["抓取", "所有", "全部", "每个", "每年", "每日", "每天", "最新", "链接", "信息", "数据", "列表", "详情", "内容", "相关", "以及", "和", "的", "为", "请"]


def task_keywords(description: str) -> list[str]:
    """Stretches of four, three and two signs of a description without any stop word, longest first, each once."""
    plain = "".join(c for c in description if "\u4e00" <= c <= "\u9fa5" or c.isascii() and c.isalnum())
    windows = (plain[i : i + n] for n in (4, 3, 2) for i in range(len(plain) - n + 1))
    return list(dict.fromkeys(w for w in windows if not any(x in w for x in STOP_WORDS)))


def relevant(names: list[str], keywords: list[str]) -> Column:
    """Does a column name or value hold a keyword? No keyword: yes."""
    if not keywords:
        return F.lit(True)
    joined = F.concat_ws(" ", F.lit(" ".join(names)), *[C.text(F.col(n)) for n in names])
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(joined, k))


def route(url: Column, rules: list[tuple[str, str, str]], default: str = "") -> Column:
    """Name of the first rule (kind, value, name) that a URL meets; kinds: contains, startswith, regex."""
    out = F.when(F.lit(False), default)
    for kind, value, name in rules:
        test = {"contains": url.contains, "startswith": url.startswith, "regex": url.rlike}[kind](value)
        out = out.when(test, name)
    return out.otherwise(default)


def link_allowed(url: Column, allow: list[str] = (), deny: list[str] = ()) -> Column:
    """Patterns over path and query, or over the whole URL; a broken pattern is taken as plain text."""
    tail = F.regexp_replace(url, r"^[a-z]+://[^/]*", "")

    def hit(p: str) -> Column:
        try:
            re.compile(p)
        except re.error:
            return url.contains(p)
        return tail.rlike(p) | url.rlike(p)

    ok = F.lit(not allow)
    for p in allow:
        ok = ok | hit(p)
    for p in deny:
        ok = ok & ~hit(p)
    return ok


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Left join of (url) with (host, pattern, allow): the longest matching pattern decides, allow wins ties.

    Rules are a few lines a host; ``*`` stands for anything and a final ``$`` for the end of the path.
    """
    u = urls.withColumn("__host", C.host(F.col("url"))).withColumn("__path", F.regexp_replace("url", r"^[a-z]+://[^/]*", ""))
    u = u.withColumn("__path", F.when(F.col("__path") == "", "/").otherwise(F.col("__path")))
    quoted = F.regexp_replace("pattern", r"([.+?(){}\[\]^|\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"))
    r = rules.groupBy(F.col("host").alias("__host")).agg(F.collect_list(F.struct(F.length("pattern").alias("n"), F.col("allow"), regex.alias("re"))).alias("__rules"))
    best = F.array_max(F.transform(F.filter("__rules", lambda x: F.regexp_like("__path", x["re"])), lambda x: F.struct(x["n"], x["allow"])))
    return u.join(r, "__host", "left").withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("__host", "__path", "__rules")


def response_kind(status: Column, body: Column) -> Column:
    """What a captured response is: blocked, rate_limited, missing, server_error, challenge, empty_shell, ok."""
    low = F.lower(C.text(body))
    challenge = F.lit(False)
    for w in BLOCK_WORDS:
        challenge = challenge | low.contains(w)
    return (
        F.when(status.isin(401, 403), "blocked")
        .when(status == 429, "rate_limited")
        .when(status.isin(404, 410), "missing")
        .when(status >= 500, "server_error")
        .when(challenge & (F.length(low) < 20_000), "challenge")
        .when(is_empty_shell(body), "empty_shell")
        .otherwise("ok")
    )


def is_empty_shell(html: Column) -> Column:
    """Markup with scripts but next to no text of its own."""
    plain = F.regexp_replace(C.text(html), r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    shown = F.length(F.regexp_replace(F.regexp_replace(plain, "<[^>]*>", " "), r"\s+", ""))
    return (F.regexp_count(C.text(html), F.lit("(?i)<script")) > 0) & (shown < 50)


# mapping


def map_record(df: DataFrame, fields: Mapping[str, object], keep_raw: bool = False) -> DataFrame:
    """New columns from a mapping: a column name, or a dict with one of ``from``/``path`` (with ``default``), ``constant``, ``template``, ``concat``, and ``strip_tags``."""
    out = []
    for name, rule in fields.items():
        rule = {"from": rule} if isinstance(rule, str) else dict(rule)
        if "constant" in rule:
            c = F.lit(rule["constant"])
        elif "template" in rule:
            c = template(rule["template"], df.columns)
        elif "concat" in rule:
            c = F.concat(*[C.text(F.col(x)) if x in df.columns else F.lit(x) for x in rule["concat"]])
        else:
            source = rule.get("from", rule.get("path"))
            head, _, rest = source.partition(".")
            if source in df.columns:
                c = F.col(source)
            elif head in df.columns and rest:
                json = F.col(head)
                variant = json if isinstance(df.schema[head].dataType, T.VariantType) else F.try_parse_json(json.cast("string"))
                c = C.jpath_text(variant, rest, rule.get("default"))
            else:
                c = F.lit(rule.get("default"))
        if rule.get("strip_tags"):
            c = C.strip_tags(c.cast("string"))
        out.append(c.alias(name))
    raw = [F.col(c).alias(f"raw_{c}") for c in df.columns if f"raw_{c}" not in fields] if keep_raw else []
    return df.select(*out, *raw)


def template(pattern: str, names: list[str]) -> Column:
    """``{name}`` and ``{{name}}`` replaced by the column's text, NULL by the empty string; unknown names stay as they are."""
    parts, at = [F.lit("")], 0
    for m in re.finditer(r"\{\{(\w+)\}\}|\{(\w+)\}", pattern):
        parts += [F.lit(pattern[at : m.start()]), C.text(F.col(m[1] or m[2])) if (m[1] or m[2]) in names else F.lit(m[0])]
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Old names to new; a column that bears a new name already gives way."""
    mapping = {a: b for a, b in mapping.items() if a in df.columns and a != b}
    return df.drop(*[b for b in mapping.values() if b not in mapping]).withColumnsRenamed(mapping)


def add(df: DataFrame, field: str, value) -> DataFrame:
    return df.withColumn(field, F.lit(value))


def fill_default(df: DataFrame, field: str, value) -> DataFrame:
    if field not in df.columns:
        return df.withColumn(field, F.lit(value))
    c = F.col(field)
    return df.withColumn(field, F.when(c.isNull() | (c.cast("string") == ""), F.lit(value)).otherwise(c))


def cast(df: DataFrame, field: str, to: str) -> DataFrame:
    """int, float or str; what does not parse becomes NULL and is flagged in ``<field>__cast_error``."""
    c = F.col(field)
    new = {"int": C.cast_int, "float": C.cast_float, "str": lambda x: x.cast("string")}[to](c)
    return df.withColumn(f"{field}__cast_error", c.isNotNull() & new.isNull()).withColumn(field, new)


def regex_extract(df: DataFrame, field: str, pattern: str, group: int = 1, to: str | None = None) -> DataFrame:
    """The group of the first match into ``to``; without a match that column stays (NULL if new)."""
    to = to or f"{field}_提取"
    old = F.col(to).cast("string") if to in df.columns else F.lit(None).cast("string")
    s = C.text(F.col(field))
    group = group if regex_is_safe(pattern) and group <= re.compile(pattern).groups else 0
    return df.withColumn(to, F.coalesce(patterns.extract(s, pattern, group), old)) if regex_is_safe(pattern) else df


def nest(df: DataFrame, field: str, parts: Mapping[str, str]) -> DataFrame:
    """Columns put together as one struct ``field``; ``parts`` are its names and the columns they take, which go."""
    taken = [c for c in parts.values() if c != field]
    return df.withColumn(field, F.struct(*[F.col(c).alias(n) for n, c in parts.items()])).drop(*taken)


def regex_first(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, over line ends and in any case; '' without a match, the whole match for a group that is not there."""
    flags = re.IGNORECASE | re.DOTALL
    if not patterns.usable(pattern, flags):
        return F.lit("")
    return F.coalesce(patterns.extract(C.text(c), pattern, group if group <= re.compile(pattern).groups else 0, flags), F.lit(""))


def split_field(df: DataFrame, field: str, sep: str = ",", to: str | None = None) -> DataFrame:
    parts = F.transform(F.split(F.col(field).cast("string"), re.escape(sep or ",")), C.strip)
    return df.withColumn(to or field, F.filter(parts, lambda x: x != ""))


def transform(df: DataFrame, field: str, op: str, pattern: str = "%Y-%m-%d %H:%M:%S") -> DataFrame:
    c = F.col(field)
    new = {"upper": lambda: F.upper(c), "lower": lambda: F.lower(c), "unix_to_datetime": lambda: C.unix_to_datetime(c, pattern)}[op]()
    return df.withColumn(field, new)


def url_rewrite(c: Column, prefix: str = "", suffix: str = "", replace: list[tuple[str, str]] = ()) -> Column:
    """Prefix for relative URLs only, then suffix, then replacements."""
    out = F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit(prefix), c)) if prefix else c
    out = F.concat(out, F.lit(suffix)) if suffix else out
    for a, b in replace:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def dedup_names(names: list[str]) -> list[str]:
    """Blank names get ``col<n>``, repeated ones a number."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = (n or "").strip() or f"col{i + 1}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def fuzzy_names(headers: list[str], wanted: list[str]) -> dict[str, str]:
    """Headers to wanted names: equal, or at least two characters in common; the best score first."""
    scores = sorted(((100 if h == w else len(set(h) & set(w)), h, w) for h in headers for w in wanted), key=lambda x: (-x[0], x[1], x[2]))
    out: dict[str, str] = {}
    for score, h, w in scores:
        if score >= 2 and h not in out and w not in out.values():
            out[h] = w
    return out
