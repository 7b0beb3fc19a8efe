"""What a chain of document filters removes, in every order of the filters.

Each document gets a mask with a bit for each filter that it fails, and documents are counted by part and mask, so all that
follows works on at most 32 cells a part however many documents there are. The cells are unpivoted against the 120
orders and their five steps; a running bit-or window over the steps of one cell and order tells what failed earlier; conditional
sums by step give what each filter removes there, and a window over one filter's rows sums its removals over all orders.

Filters (words are runs of characters other than space and U+0009 to U+000D, with case): A under 200 words; B distinct
words under half of the words; C over 3 % of the code points are A to Z; D any of ``#$%&*|``; E the same text as a row
with a smaller id, whether that row is removed or not.

Equal texts are found by SHA-256: the smallest id of each text is counted before the shuffle, and only texts with several ids are
joined back, broadcast if they are few, else with a salt, so a text with a third of all rows is no hot key.

Defined cases: null text counts as empty, and equals empty text; a null part and '' are one; a null id is smaller than none and none is smaller
than it; rows with one id and one text are no copies of each other; a document counts as labelled 1 if any label row of its id says so; labels of
null ids count for no row; repeated rows count each; an empty table gives an empty result. Bytes that are not UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import long, text_map
from gleanery.session import cut_lineage, salted_join

FILTERS = "ABCDE"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
#: Rows of the smaller side up to which a join broadcasts it.
FEW = 200_000


def failures(texts: list[str | None]) -> dict[str, list]:
    """The bits of filters A to D, and the text's digest."""
    out: dict[str, list] = {"bits": [], "text_key": []}
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        capitals = len(raw) - len(raw.translate(None, CAPITALS))
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(t or ""), len(raw.translate(None, MARKS)) < len(raw)]
        out["bits"].append(sum(f << i for i, f in enumerate(fails)))
        out["text_key"].append(hashlib.sha256(raw).digest())
    return out


def _attach(big: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Left join with one row a key."""
    few = small.limit(FEW + 1).count() <= FEW
    return big.join(F.broadcast(small), on, "left") if few else salted_join(big, small, on, how="left")


def masks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``part``, ``mask``, ``good`` and ``toxic`` (0 or 1) of each document."""
    source = docs.select(docs[id_col].alias("__id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[text_col].alias("__body"))
    new = T.StructType([long("bits"), T.StructField("text_key", T.BinaryType())])
    measured = cut_lineage(text_map(source, "__body", lambda: failures, new, ["__id", "part"]))
    ids = measured.groupBy("text_key").agg(F.min("__id").alias("__least"), F.max("__id").alias("__most"))
    copied = cut_lineage(ids.where("__least < __most").select("text_key", "__least"))
    marks = labels.select(labels["doc_id"].alias("__id"), labels["quality"].alias("__q"), labels["toxic"].alias("__t")).where("__id is not null and (__q = 1 or __t = 1)")
    one = cut_lineage(marks.groupBy("__id").agg(F.max(F.coalesce((F.col("__q") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("__t") == 1).cast("long"), F.lit(0))).alias("toxic")))
    rows = _attach(_attach(measured, copied, "text_key"), one, "__id")
    again = F.coalesce(F.col("__least") < F.col("__id"), F.lit(False))
    return rows.select(
        "part",
        (F.col("bits") + F.when(again, 1 << FILTERS.index("E")).otherwise(0)).cast("long").alias("mask"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")],
    )


def audit(cells: DataFrame) -> DataFrame:
    """All steps of all orders from cells (part, mask, n, good, toxic)."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    long_form = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = F.create_map(*[x for i, f in enumerate(FILTERS) for x in (F.lit(f), F.lit(1 << i).cast("long"))])
    long_form = long_form.withColumn("filter", F.expr("substring(filter_order, step, 1)")).withColumn("bit", bits[F.col("filter")])
    long_form = long_form.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    sofar = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long_form = long_form.withColumn("earlier", F.coalesce(F.bit_or("fails").over(sofar), F.lit(0).cast("long")))
    here, gone = F.col("fails") != 0, F.col("earlier") != 0

    def total(when, what="n"):
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")

    steps = long_form.groupBy("part", "filter_order", "step", "filter").agg(
        total(~here & ~gone).alias("kept"),
        total(here & ~gone).alias("removed"),
        total(here & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here & ~gone, "good").alias("good_lost"),
        total(here & ~gone, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step; counts are of the part's documents."""
    rows = masks(docs, labels, id_col, text_col, part_col)
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return audit(cut_lineage(cells))
