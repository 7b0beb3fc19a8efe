"""Endpoints in script text: calls with method, path and parameter keys, resolved against base URLs, and front-end routes.

A script's clients (``api = axios.create({baseURL: "..."})``) are assignments and its calls (``api.get("/x", {...})``) uses; each call is resolved by a
join of both by script and name, with a default base of the script (``axios.defaults.baseURL = "..."``) for calls without a client of their own.
All is text matching inside the JVM, of whole scripts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Call names that are methods; words that are no parameter; endings of files that are no endpoint; what code leaves in a false path.
METHODS = "get|post|put|delete|request"
NO_PARAMETER = ["get", "post", "put", "delete", "then", "catch", "true", "false"]
RESIDUE = r"[=;{}()<>]"
FILE_END = r"\.[^/]*$"
#: Characters after a call in which its parameters stand, and how many of them are told.
REACH, MOST_KEYS = 200, 8
NAME = r"[A-Za-z_$][\w$]{0,40}"
TEXT = r"[\"']([^\"']{3,120})[\"']"


def page_scripts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, script, body): the inline scripts of pages, numbered from 0."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("script", "body")).where(F.trim("body") != "")


def _matches(body: Column, pattern: str, groups: dict[str, int]) -> Column:
    """Structs of the groups of all matches."""
    return F.arrays_zip(*[F.regexp_extract_all(body, F.lit(pattern), F.lit(g)).alias(name) for name, g in groups.items()])


def _plausible(path: Column) -> Column:
    return path.rlike(r"^(/|https?://|\$\{)") & ~path.rlike(RESIDUE) & (F.length(path) >= 4)


def bases(scripts: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """(keys, client, base): clients with a base URL; the default of a script has the client ''."""
    made = _matches(F.col(body), rf"({NAME})\s*=\s*{NAME}\.create\s*\(\s*\{{(?:(?!\.create\s*\()[\s\S]){{0,400}}?baseURL\s*:\s*{TEXT}", {"client": 1, "base": 2})
    default = F.transform(_matches(F.col(body), rf"\.baseURL\s*=\s*{TEXT}", {"base": 1}), lambda x: F.struct(F.lit("").alias("client"), x["base"].alias("base")))
    rows = scripts.select(*keys, F.posexplode(F.concat(made, default)).alias("__at", "b")).select(*keys, "__at", "b.client", "b.base")
    return rows.where(_plausible(F.col("base"))).groupBy(*keys, "client").agg(F.max_by("base", "__at").alias("base"))  # the last assignment holds


def calls(scripts: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """(keys, client, method, path, params): ``request`` and ``url:`` without a method have ``REQUEST`` and ``CFG``."""
    after = rf"(?=([\s\S]{{0,{REACH}}}))"
    kinds = {
        "call": _matches(F.col(body), rf"(?<![\w$])({NAME})\.({METHODS})\s*\(\s*{TEXT}{after}", {"client": 1, "method": 2, "path": 3, "rest": 4}),
        "fetch": _matches(F.col(body), rf"(?<![\w$.])fetch\s*\(\s*{TEXT}{after}", {"path": 1, "rest": 2}),
        "url": _matches(F.col(body), rf"(?<![\w$])url\s*:\s*{TEXT}{after}", {"path": 1, "rest": 2}),
    }
    named = {
        "call": lambda x: F.struct(x["client"].alias("client"), F.upper(x["method"]).alias("method"), x["path"].alias("path"), x["rest"].alias("rest")),
        "fetch": lambda x: F.struct(F.lit("").alias("client"), F.lit("GET").alias("method"), x["path"].alias("path"), x["rest"].alias("rest")),
        "url": lambda x: F.struct(F.lit("").alias("client"), F.lit("CFG").alias("method"), x["path"].alias("path"), x["rest"].alias("rest")),
    }
    alike = [F.transform(found, named[kind]) for kind, found in kinds.items()]
    rows = scripts.select(*keys, F.explode(F.concat(*alike)).alias("c")).select(*keys, "c.*")
    rows = rows.where(_plausible(F.col("path")) & ~F.regexp_replace("path", "[?#].*$", "").rlike(rf"/[^/]*{FILE_END}"))
    # the call's own text ends with its statement or at the next call
    own = F.regexp_replace("rest", rf"(?s)(?:;|\n|\)\s*\.|\)\s*,\s*{NAME}\s*[.=(]|{NAME}\.(?:{METHODS})\s*\(|fetch\s*\().*$", "")
    found = F.array_distinct(F.regexp_extract_all(own, F.lit(r"[\"']?([A-Za-z_][A-Za-z0-9_]{1,30})[\"']?\s*[:=](?!=)"), F.lit(1)))
    params = F.slice(F.filter(found, lambda p: ~F.lower(p).isin(NO_PARAMETER)), 1, MOST_KEYS)
    return rows.select(*keys, "client", "method", "path", params.alias("params"))


def endpoints(scripts: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """(method, url, params, n_scripts): each endpoint once, with the parameter keys of all its calls, sorted.

    A path is put behind its client's base, or the script's default; absolute URLs stand as they are.
    """
    known = bases(scripts, keys, body)
    own = known.where("client <> ''").withColumnRenamed("base", "__own")
    default = known.where("client = ''").drop("client").withColumnRenamed("base", "__default")
    joined = calls(scripts, keys, body).join(own, [*keys, "client"], "left").join(default, keys, "left")
    base = F.regexp_replace(F.coalesce("__own", "__default", F.lit("")), "/+$", "")
    url = F.when(F.col("path").startswith("/"), F.concat(base, "path")).otherwise(F.col("path"))
    rows = joined.select(*keys, "method", url.alias("url"), "params")
    each = rows.groupBy("method", "url", *keys).agg(F.flatten(F.collect_set("params")).alias("p"))  # a script's calls of one endpoint
    exploded = each.select("method", "url", *keys, F.explode_outer("p").alias("p"))
    return exploded.groupBy("method", "url").agg(F.array_sort(F.collect_set("p")).alias("params"), F.count_distinct(F.struct(*keys)).alias("n_scripts"))


def routes(scripts: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """(route, n_scripts): paths of pages in front-end routers."""
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(r"path\s*:\s*[\"'](/[A-Za-z0-9_\-./:]*)[\"']"), F.lit(1)))
    rows = scripts.select(*keys, F.explode(found).alias("route")).where(~F.col("route").rlike(r"\.(js|css|png|json)$"))
    return rows.groupBy("route").agg(F.count("*").alias("n_scripts"))
