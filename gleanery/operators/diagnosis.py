"""What stands behind a captured response, by weighed evidence of its status, headers and body.

A table of rules says what each piece of evidence speaks for and how much: its kind, where it is looked for, a pattern, a weight. All rules are tried on every response, weights
are summed up by kind, and the heaviest kind of at least ``enough`` is the verdict, with the evidence that spoke for it; of equal ones the first in ``KINDS``. Rules are data: a
user's own are put beside or in place of these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import columns as C
from gleanery.functions import patterns

#: Kinds, the gravest first; those that block, and those that only tell how a page is made.
KINDS = ["session_expired", "rate_limit", "challenge", "access_denied", "server_error", "missing", "redirect", "app_shell", "ok"]
BLOCKING = KINDS[:4]
#: Where evidence is looked for: the status, a header (``header:<name>``), the whole body, its title and first headings, what stands outside scripts, inside scripts.
PLACES = ["status", "body", "title", "outside", "scripts"]
#: Words and forms of the pages that block readers or are made by scripts.
RULES: list[tuple[str, str, str, int]] = [
    ("session_expired", "status", "^419$", 10), ("rate_limit", "status", "^429$", 10), ("rate_limit", "header:retry-after", r"\d", 3),
    ("access_denied", "status", "^(401|403|468)$", 5), ("access_denied", "title", "(?i)访问被拒|拒绝访问|请求被拦截|access denied|已被拦截|访问受限|forbidden", 6), ("access_denied", "header:server", r"^[* ]+$", 1),
    ("challenge", "title", "(?i)安全验证|请完成验证|just a moment|verify you are human", 6), ("challenge", "outside", "(?i)please enable javascript", 5), ("challenge", "body", "(?i)<noscript[^>]*>[^<]*please enable javascript", 2),
    ("challenge", "scripts", "(?i)_0x[0-9a-f]+|eval\\(function|stoken|__js_challenge", 4), ("challenge", "status", "^(406|412)$", 5),
    ("server_error", "status", r"^5\d\d$", 9), ("missing", "status", "^(404|410)$", 9), ("redirect", "body", "(?i)<meta[^>]+http-equiv=.?refresh", 4), ("redirect", "status", r"^3\d\d$", 9),
    ("app_shell", "body", "(?i)<div[^>]+id=.?(app|root)[^>]*>\\s*</div>", 4), ("app_shell", "body", "(?i)__next_data__|data-v-app", 1), ("ok", "status", r"^2\d\d$", 4),
]


def faults(rules: Sequence[tuple[str, str, str, int]]) -> list[str]:
    """What is wrong with a table of rules."""
    out = []
    for i, (kind, place, pattern, _) in enumerate(rules, 1):
        if kind not in KINDS:
            out.append(f"rule {i}: unknown kind {kind!r}")
        if place not in PLACES and not place.startswith("header:"):
            out.append(f"rule {i}: unknown place {place!r}")
        if patterns.growth(pattern)[0] in ("exponential", "invalid"):
            out.append(f"rule {i}: the pattern {pattern!r} is broken or may take exponential time")
    return out


def _places(status: Column, headers: Column | None, body: Column, rules) -> dict[str, Column]:
    """The text of each place that the rules name."""
    text = C.text(body)
    scripted = r"(?is)<(script|noscript)\b[^>]*>.*?</\1\s*>"
    heads = F.concat(F.regexp_extract_all(text, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1)))
    out = {
        "status": C.text(status.cast("string")), "body": text, "title": F.regexp_replace(F.array_join(heads, " "), "<[^>]+>", " "), "outside": F.regexp_replace(text, scripted, " "),
        "scripts": F.array_join(F.regexp_extract_all(text, F.lit(r"(?is)<script[^>]*>(.*?)</script\s*>"), F.lit(1)), "\n"),
    }
    if headers is not None:
        lower = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"])))
        out |= {place: F.coalesce(F.try_element_at(lower, F.lit(place[7:])), F.lit("")) for _, place, *_ in rules if place.startswith("header:")}
    return out


def diagnose(df: DataFrame, status: str, body: str, headers: str | None = None, rules: Sequence[tuple[str, str, str, int]] = RULES, enough: int = 4) -> DataFrame:
    """The rows with ``kind`` (``other`` if nothing weighs enough), ``weight``, ``blocked`` and ``evidence`` (``place: what was found`` of the kind's rules)."""
    if wrong := faults(rules):
        raise ValueError("; ".join(wrong))
    places = _places(F.col(status), F.col(headers) if headers else None, F.col(body), rules)
    read = df.withColumn("__places", F.struct(*[v.alias(f"p{i}") for i, v in enumerate(places.values())]))
    at = {name: F.col(f"__places.p{i}") for i, name in enumerate(places)}
    hits = [
        F.struct(F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), F.concat(F.lit(f"{place}: "), F.substring(F.regexp_extract(at[place], f"({pattern})", 1), 1, 60)).alias("said"), at[place].rlike(pattern).alias("hit"))
        for kind, place, pattern, weight in rules
        if place in at
    ]
    read = read.withColumn("__hits", F.filter(F.array(*hits), lambda h: h["hit"])).drop("__places")
    weights = F.array(*[F.struct(F.aggregate(_of_kind(kind), F.lit(0), lambda a, h: a + h["weight"]).alias("weight"), F.lit(-i).alias("order"), F.lit(kind).alias("kind")) for i, kind in enumerate(KINDS)])
    best = F.array_max(weights)
    read = read.withColumn("__best", best)
    sure = F.col("__best.weight") >= enough
    names = [c for c in df.columns if c not in ("kind", "weight", "blocked", "evidence")]
    said = F.transform(F.filter("__hits", lambda h: h["kind"] == F.col("__best.kind")), lambda h: h["said"])
    return read.select(
        *names, F.when(sure, F.col("__best.kind")).otherwise("other").alias("kind"), F.col("__best.weight").alias("weight"), (sure & F.col("__best.kind").isin(BLOCKING)).alias("blocked"), F.when(sure, said).otherwise(F.array().cast("array<string>")).alias("evidence")
    )


def _of_kind(kind: str) -> Column:
    return F.filter("__hits", lambda h: h["kind"] == kind)
