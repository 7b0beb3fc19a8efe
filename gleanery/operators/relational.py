"""Deduplication, joins, differences, reachability and set similarity over DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import columns as C
from gleanery.operators.health import numbered
from gleanery.session import cut_lineage, salted_join


def _missing(keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull() | (F.col(k).cast("string") == "")
    return out


def dedup(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order; keys compare as text, rows with a missing part all stay.

    Two aggregations by key would do for hashes alone; the first row itself is found by ``min_by`` over a
    struct, which sums up before the shuffle, so a key that holds a third of the rows is no hot spot.
    """
    missing = _missing(keys)
    texts = [F.col(k).cast("string").alias(f"__k{i}") for i, k in enumerate(keys)]
    first = df.where(~missing).groupBy(*texts).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("__r"))
    return first.select("__r.*").unionByName(df.where(missing))


def dedup_content(df: DataFrame, fields: list[str], order: list) -> DataFrame:
    return dedup(df.withColumn("__hash", C.content_hash(fields)), ["__hash"], order).drop("__hash")


def duplicate_rate(df: DataFrame, fields: list[str]) -> DataFrame:
    rows = df.groupBy(C.content_hash(fields).alias("h")).agg(F.count("*").alias("n"))
    total, distinct = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return rows.agg(
        total.cast("bigint").alias("total"),
        distinct.cast("bigint").alias("distinct_rows"),
        (total - distinct).cast("bigint").alias("duplicates"),
        F.round(F.coalesce((total - distinct) / total, F.lit(0.0)), 6).alias("dup_rate"),
    )


def merge_consecutive(df: DataFrame, group: list[str], order: list, same: list[str], collect: str) -> DataFrame:
    """Runs of neighbours with equal ``same`` columns become one row with the distinct collected values (gaps and islands)."""
    w = W.partitionBy(*group).orderBy(*order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    runs = df.withColumn("__new", (new | (F.row_number().over(w) == 1)).cast("int")).withColumn("run", F.sum("__new").over(w))
    return runs.groupBy(*group, "run", *same).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set(collect)).alias(f"{collect}_set"))


def page_repeats(df: DataFrame, group: list[str], page: str, signature: Column) -> DataFrame:
    """Pages whose signature equals that of the page before.

    Rows are numbered by ranges of (group, page) and meet the row before by that number, so a large group is many tasks' work.
    """
    rows = numbered(df.withColumn("__sig", signature), [*map(F.col, group), F.col(page)], "__at")
    before = rows.select((F.col("__at") + 1).alias("__at"), F.col("__sig").alias("__before"), F.struct(*group).alias("__group"))
    same = F.coalesce((F.col("__sig") == F.col("__before")) & F.struct(*group).eqNullSafe(F.col("__group")), F.lit(False))
    return rows.join(before, "__at", "left").withColumn("repeated", same).drop("__at", "__sig", "__before", "__group")


def enrich(rows: DataFrame, details: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Left join; a blank detail value never overwrites what the row has."""
    d = details.select(F.col(on), *[F.col(f).alias(f"__{f}") for f in fields])
    out = rows.join(d, on, "left")
    for f in fields:
        new = F.when(~C.is_blank(F.col(f"__{f}")), F.col(f"__{f}"))
        out = out.withColumn(f, F.coalesce(new, F.col(f)) if f in rows.columns else F.coalesce(new, F.lit("")))
    return out.drop(*[f"__{f}" for f in fields])


def resume_merge(new: DataFrame, old: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Old values fill only blank new ones."""
    o = old.select(F.col(on), *[F.col(f).alias(f"__{f}") for f in fields])
    out = new.join(o, on, "left")
    for f in fields:
        out = out.withColumn(f, F.when(C.is_blank(F.col(f)), F.col(f"__{f}")).otherwise(F.col(f)))
    return out.drop(*[f"__{f}" for f in fields])


def resume_export(new: DataFrame, old: DataFrame, on: str) -> DataFrame:
    """New rows, and the old ones whose key did not come again."""
    return new.unionByName(old.join(new.select(on), on, "left_anti"), allowMissingColumns=True)


def fuller_version(old: DataFrame, new: DataFrame, key: str, full: Column) -> DataFrame:
    """All rows of one version of each key: of the one with more rows for which ``full`` holds, of the old one where they are even."""
    def marked(df, version):
        return df.withColumn("__v", F.lit(version)), df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__k")).agg(F.count_if(full).alias("n"), F.lit(version).alias("v"))

    (a, had), (b, has) = marked(old, 0), marked(new, 1)
    best = had.unionByName(has).groupBy("__k").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("__best"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__k", F.coalesce(F.col(key).cast("string"), F.lit("")))
    return both.join(best, "__k").where("__v = __best").drop("__k", "__v", "__best")


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose record key is not in ``seen`` (column ``key``); rows without a key stay."""
    keyed = df.withColumn("__key", C.record_key(keys))
    fresh = keyed.where(F.col("__key").isNotNull()).join(seen.select(F.col("key").alias("__key")), "__key", "left_anti")
    return fresh.unionByName(keyed.where(F.col("__key").isNull())).drop("__key")


def snapshot_diff(current: DataFrame, old: DataFrame, key: str, least_share: float = 0.1) -> DataFrame:
    """(key, change) for added and removed keys; nothing if the current snapshot is empty or below the share of the old one."""
    a, b = current.select(key).distinct(), old.select(key).distinct()
    n = a.count()
    if n == 0 or n < least_share * b.count():
        return a.limit(0).withColumn("change", F.lit("added"))
    return a.join(b, key, "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("removed")))


def in_window(rows: DataFrame, universe: DataFrame, code: str, year: str, first: str, last: str) -> DataFrame:
    """Rows with ``inside``: does some window of the same code hold the year? An equi-join with a range test."""
    keys = rows.select(code, year).distinct()
    u = universe.select(F.col(code).alias("__c"), F.col(first).alias("__a"), F.col(last).alias("__b"))
    met = keys.join(u, (F.col(code) == F.col("__c")) & F.col(year).between(F.col("__a"), F.col("__b")), "left_semi")
    found = met.select(F.col(code).alias("__code"), F.col(year).alias("__year"), F.lit(True).alias("inside"))
    out = rows.join(found, (F.col(code) == F.col("__code")) & (F.col(year) == F.col("__year")), "left")
    return out.select(*rows.columns, F.coalesce("inside", F.lit(False)).alias("inside"))


def expand_universe(universe: DataFrame, code: str, first: str, last: str, low: int, high: int) -> DataFrame:
    """(code, year) of each window clipped to low..high."""
    a, b = F.greatest(F.col(first), F.lit(low)), F.least(F.col(last), F.lit(high))
    return universe.where(a <= b).select(code, F.explode(F.sequence(a, b)).alias("year"))


def coverage_gaps(expected: DataFrame, have: DataFrame, on: list[str], known: DataFrame | None = None) -> DataFrame:
    out = expected.join(have.select(*on).distinct(), on, "left_anti")
    return out.join(known.select(*on).distinct(), on, "left_anti") if known is not None else out


def last_write(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key; found by ``max_by``, which sums up before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("__r")).select("__r.*")


def coalesce_sources(base: DataFrame, sources: list[DataFrame], on: str, fields: list[str]) -> DataFrame:
    """Left joins in order; the first source that has a value that is not blank gives it. ``filled_by``: which (0 first)."""
    out = base.select(on)
    for i, s in enumerate(sources):
        out = out.join(s.select(F.col(on), *[F.col(f).alias(f"__{i}_{f}") for f in fields]), on, "left")
    cols = []
    for f in fields:
        names = [f"__{i}_{f}" for i in range(len(sources)) if f"__{i}_{f}" in out.columns]
        cols.append(F.coalesce(*[F.when(~C.is_blank(F.col(n)), F.col(n)) for n in names]).alias(f))
    filled = F.lit(None).cast("int")
    for i in reversed(range(len(sources))):
        some = F.lit(False)
        for f in fields:
            some = some | ~C.is_blank(F.col(f"__{i}_{f}"))
        filled = F.when(some, F.lit(i)).otherwise(filled)
    return out.select(on, *cols, filled.alias("filled_by"))


def best_candidate(items: DataFrame, key: str, rank: Column, order: list) -> DataFrame:
    """The candidate of the least rank for each key, ties by order."""
    return items.withColumn("__rank", rank).groupBy(key).agg(F.min_by(F.struct(*items.columns), F.struct("__rank", *order)).alias("__r")).select("__r.*")


def correlate_values(params: DataFrame, fields: DataFrame) -> DataFrame:
    """(name, value) params with the (step, field, value) that give them: equal value first, then equal name."""
    same = params.join(fields.select("step", "field", "value"), "value").select("name", "step", "field", F.lit(0).alias("how"))

    def plain(c):
        return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")

    named = params.select("name", plain(F.col("name")).alias("k")).join(fields.select("step", "field", plain(F.col("field")).alias("k")), "k").select("name", "step", "field", F.lit(1).alias("how"))
    found = same.unionByName(named)
    return found.groupBy("name").agg(F.min(F.struct("how", "step", "field")).alias("b")).select("name", "b.step", "b.field", F.when(F.col("b.how") == 0, "value").otherwise("name").alias("how"))


def similar_sets(sets: DataFrame, key: str, tokens: str, share: float = 0.9, few: int = 2) -> DataFrame:
    """Pairs (a < b) whose token sets overlap in at least ``share`` of the larger one. Exact: candidates are verified whole.

    Equal sets are one class, named by their least key and joined back by the caller if wanted, so copies give no pairs.
    Let the larger of two sets have n tokens, of which ``need = ceil(share * n)`` have to be common. Where
    ``n - need`` is at most ``few``, the two meet at each common subset of ``need`` tokens: each set gives what is left when so many tokens are
    taken out, so only sets that are alike meet, however common their tokens are. Of larger sets at most ``d = 2 * (n - need)`` tokens are in one of the two alone; all
    tokens are dealt to ``d + 1`` parts by a hash, so at least one part is the same in both, and with ``d + 2`` parts at least two are. Sets meet where
    one part is the same, or, where so few tokens are about that this brings many together, where two are.
    """
    classes = cut_lineage(sets.groupBy(F.array_sort(F.array_distinct(tokens)).alias("t")).agg(F.min(key).alias("k")).where(F.size("t") > 0))
    need = lambda n: math.ceil(share * n - 1e-9)
    longest = 1
    while longest + 1 - need(longest + 1) <= few and longest < 1000:
        longest += 1
    plans = set()
    for n in range(1, longest + 1):
        plans.add((n, need(n), True))
        for m in range(n, longest + 1):
            if need(m) <= n:
                plans.add((n, need(m), False))
    plan = F.broadcast(classes.sparkSession.createDataFrame(sorted(plans), "__n int, need int, larger boolean"))  # three rows a size up to ``longest``
    parts = classes.join(plan, F.size("t") == F.col("__n")).select("k", "need", "larger", F.explode(_without("t", F.col("__n") - F.col("need"), few)).alias("s"))
    parts = parts.select("k", "need", "larger", F.xxhash64("s").alias("s"))
    small, large = parts.where("not larger").select("need", "s", F.col("k").alias("k2")), parts.where("larger").drop("larger")
    met = large.join(small, ["need", "s"]).where("k <> k2").select("k", "k2")

    large_pairs = _meet_in_parts(classes.where(F.size("t") >= need(longest + 1)), share, need, need(longest + 1))
    pairs = met if large_pairs is None else met.unionByName(large_pairs)
    pairs = pairs.select(F.least("k", "k2").alias("k"), F.greatest("k", "k2").alias("k2")).distinct()
    full = pairs.join(classes, "k").join(classes.select(F.col("k").alias("k2"), F.col("t").alias("t2")), "k2")
    common = F.size(F.array_intersect("t", "t2"))
    return full.where(common >= share * F.greatest(F.size("t"), F.size("t2"))).select(F.col("k").alias("a"), F.col("k2").alias("b"), common.cast("bigint").alias("overlap"))


#: Sets that one meeting of parts may bring to each on average; parts up to which pairs of them are formed.
MET, PAIRED = 20, 48


def _meet_in_parts(classes: DataFrame, share: float, need, lowest: int) -> DataFrame | None:
    """(k, k2): pairs of sets (k, t) of at least ``lowest`` tokens that may overlap in ``share`` of the larger.

    Sizes fall into bands, each as wide as the sizes of similar sets can differ, so a set meets those of its own band and of the next, dealt to as many
    parts as the larger one's band asks for.
    """
    largest = classes.agg(F.max(F.size("t")).alias("n")).first()["n"]
    if largest is None:
        return None
    edges = [lowest]
    while edges[-1] <= largest:
        edges.append(math.floor(edges[-1] / share + 1e-9) + 1)
    apart = [max(2 * (n - need(n)) for n in range(a, b)) for a, b in zip(edges, edges[1:])]
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.size("t"))) - 1
    both = F.filter(F.array(place, place + 1), lambda b: b < len(apart))
    rows = classes.select("k", "t", F.explode(both).alias("band"))

    def parts(together: int) -> DataFrame:
        number = F.element_at(F.array(*[F.lit(d + together) for d in apart]), F.col("band") + 1)
        hashed = F.transform("t", lambda x: F.xxhash64(x))
        dealt = rows.select("k", "band", number.alias("n"), hashed.alias("h"))
        of_part = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.aggregate(F.filter("h", lambda x: F.pmod(x, F.col("n")) == p), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x)))
        dealt = dealt.select("k", "band", of_part.alias("s"))
        if together == 1:
            keys = F.transform("s", lambda x, p: F.xxhash64("band", p, x))
        else:
            keys = F.flatten(F.transform("s", lambda x, p: F.transform(F.slice("s", p + 2, F.size("s")), lambda y, q: F.xxhash64("band", p, q, x, y))))
        return dealt.select("k", F.explode(keys).alias("key"))

    met = parts(1)
    groups = met.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("pairs"), F.sum("n").alias("rows")).first()
    if groups["pairs"] and groups["pairs"] > MET * groups["rows"] and max(apart) + 2 <= PAIRED:
        met = parts(2)
    other = met.select(F.col("k").alias("k2"), "key")
    return met.join(other, "key").where("k < k2").select("k", "k2").distinct()


def _without(tokens: str, out: Column, most: int) -> Column:
    """What is left of an array when ``out`` elements (at most ``most``, up to 2) are taken away, each way once."""
    if most > 2:
        raise ValueError("up to two elements can be taken away")
    places = F.sequence(F.lit(0), F.size(tokens) - 1)
    one = F.transform(places, lambda i: F.filter(tokens, lambda x, p: p != i))
    pairs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.filter(tokens, lambda x, p: (p != i) & (p != j)))))
    return F.when(out == 0, F.array(F.col(tokens))).when(out == 1, one).otherwise(pairs)


def verbatim(clauses: DataFrame, documents: DataFrame, key: str, clause: str, text: str) -> DataFrame:
    """Is each clause a substring of its document? An equi-join on the key, then a test."""
    d = documents.select(key, F.col(text).alias("__text"))
    return clauses.join(d, key, "left").withColumn("found", F.coalesce(F.col("__text").contains(F.col(clause)), F.lit(False))).drop("__text")


def cartesian(parts: list[DataFrame]) -> DataFrame:
    """All combinations of small parameter tables, which are a stated list of values."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def union_merge(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns that a part lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def ordered_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Distinct keys in the order of first appearance: (key, part, pos)."""
    rows = union_merge([p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    return rows.groupBy(key).agg(F.min(F.struct("part", "pos")).alias("b")).select(key, "b.part", "b.pos")


def flatten_replies(df: DataFrame, key: str, replies: str, columns: list[str]) -> DataFrame:
    """Comments and their nested replies as rows with ``parent`` and ``level``."""
    top = df.select(F.col(key).alias("id"), F.lit(None).cast(df.schema[key].dataType).alias("parent"), F.lit(0).alias("level"), *columns)
    nested = df.select(F.col(key).alias("parent"), F.explode(replies).alias("r")).select(F.col(f"r.{key}").alias("id"), "parent", F.lit(1).alias("level"), *[F.col(f"r.{c}").alias(c) for c in columns])
    return top.unionByName(nested)


def reachable_nodes(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) by breadth-first search over (src, dst): semi-naive rounds with an anti-join, cut each round."""
    seen = cut_lineage(seeds.select(F.col("node"), F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in range(1, max_depth + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = cut_lineage(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int, allow: list[str] = (), deny: list[str] = (), same_host: bool = False, max_pages: int | None = None) -> DataFrame:
    """``reachable_nodes`` over links (src, dst) of URLs that patterns allow, if asked only to hosts of the seeds.

    ``max_pages`` is the crawl's own limit: the first pages by depth, then by URL.
    """
    from gleanery.operators.rows import link_allowed

    links = edges.where(link_allowed(F.col("dst"), list(allow), list(deny)))
    if same_host:
        hosts = seeds.select(C.host(F.col("node")).alias("__host")).distinct()
        links = links.withColumn("__host", C.host(F.col("dst"))).join(hosts, "__host", "left_semi").drop("__host")
    found = reachable_nodes(links, seeds, max_depth)
    return found if max_pages is None else found.orderBy("depth", "node").limit(max_pages)


def next_pages(links: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(node, depth): the chains of next links (src, dst) from the seeds, up to ``most`` pages after each; a page that comes again ends a chain."""
    return reachable_nodes(links.where("dst is not null and dst <> '' and dst <> src"), seeds, most)


def fallback_rows(pages: DataFrame, primary: DataFrame, secondary: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Primary rows that hold a value, and the secondary rows of pages without one."""
    some = F.lit(False)
    for f in fields:
        some = some | ~C.is_blank(F.col(f))
    good = primary.where(some)
    rest = pages.select(key).join(good.select(key).distinct(), key, "left_anti")
    return good.select(key, *fields).unionByName(secondary.join(rest, key, "left_semi").select(key, *fields))


def ready_keys(keys: DataFrame, ledger: DataFrame, key: str, now: int, window: int) -> DataFrame:
    """Keys whose last touch in the ledger (key, last_ts) is older than the window, or never was."""
    last = ledger.groupBy(key).agg(F.max("last_ts").alias("last_ts"))
    out = keys.join(last, key, "left")
    return out.where(F.col("last_ts").isNull() | (F.lit(now) - F.col("last_ts") >= window))
