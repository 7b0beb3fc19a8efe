"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source has a weight and a budget, its target. A source's documents stand in a queue, shuffled by a hash; a source that is to be read
more than once stands there again, shuffled anew. A document's virtual finish time is the words of its queue up to and with it, divided by the
source's target. All queues are range-sorted by that time into one and cut where the total budget is reached, so that every source has had
its share of what lies before the cut.

Documents longer than a thousandth of their source's target queue as packets of that size, as packets do on a line: one long document then
shifts its source by no more than a packet, and the document at the cut is taken in part. There are at most 1,000 packets and
one for each document in a pass over a source.

Running totals over all rows (``running_totals``) range-sort the rows, sum each range and add the sums before it, so no key, however large,
is one task's work. A source's row is broadcast if sources are few, else joined with a salt.

Targets: ``share`` times all words, dealt by weight; no source gets more than ``most_times`` its words, and what it leaves is dealt to the others by weight
until none is above. Each round reads three sums of the table of sources.

Defined cases: null text has no words; a null source is a source, after all others; documents without words are taken with none; rows with one id
are documents each, of which equal ones are alike, so which of them is taken at the cut does not matter; a null id is an id; an empty table gives an
empty result; sources without words have target 0. Result columns alone are returned, so no other column can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import cut_lineage, salted_join

#: Packets that a source's target is divided into.
PACKETS = 1000


def count_words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D, without an array of them."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]++", "")).cast("long")


def running_totals(rows: DataFrame, order: list[Column | str], value: str, into: str) -> DataFrame:
    """The rows and the sum of ``value`` up to and with each in the order of all rows."""
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))  # a row for each range
    before = sums.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(F.broadcast(before), "__range").select(*rows.columns, (F.col("__before") + F.sum(value).over(inside)).alias(into))


def targets(sources: DataFrame, weights: list[int], share: float, most_times: int) -> DataFrame:
    """Sources (source, source_size) with ``number`` (from 1, in order), ``weight``, ``target`` and ``all_words``, the budget."""
    numbered = running_totals(sources.withColumn("__one", F.lit(1).cast("long")), [F.col("source").isNull(), F.col("source")], "__one", "number").drop("__one")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    known = cut_lineage(numbered.withColumn("weight", F.element_at(cycle, ((F.col("number") - 1) % len(weights) + 1).cast("int"))))
    words, weight = known.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = int(share * (words or 0))
    limit = most_times * F.col("source_size")
    level, capped = budget / (weight or 1), 0
    while True:
        above = F.col("weight") * F.lit(level) > limit
        n, held, free = known.agg(F.count(F.when(above, 1)), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = (budget - held) / free, n
    above = F.col("weight") * F.lit(level) > limit
    return known.select("*", F.when(above, limit.cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"), F.lit(budget).cast("long").alias("all_words"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: list[int] | None = None,
    share: float = 1.0,
    most_times: int = 3,
    seed: int = 17,
) -> DataFrame:
    """One row for each document: the id, ``size``, ``source_size``, ``target`` of its source, and ``taken``, the words that the mix takes of it."""
    sized = cut_lineage(
        docs.select(
            docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), count_words(docs[text_col]).alias("size"), F.monotonically_increasing_id().alias("row")
        )
    )
    sources = targets(cut_lineage(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), weights or [5, 2, 1], share, most_times)
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most_times), F.floor(F.col("target") / F.col("source_size")) + 1)).otherwise(1).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("queued", F.col("passes") * F.col("source_size"))
    sources = running_totals(sources, ["number"], "queued", "__upto").withColumn("before", F.col("__upto") - F.col("queued"))
    sources = sources.select(F.col("source").alias("__name"), "number", "source_size", "target", "all_words", "passes", "before", F.greatest(F.lit(1).cast("long"), F.floor(F.col("target") / PACKETS)).alias("packet"))
    sources = cut_lineage(sources.withColumn("key", F.coalesce(F.concat(F.lit("="), "__name"), F.lit("-"))).drop("__name"))
    named = sized.select("id", "size", "row", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("key"))
    joined = named.join(F.broadcast(sources), "key") if sources.count() <= 200_000 else salted_join(named, sources, "key")

    queued = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))).alias("again")).drop("key")
    spelled = F.concat_ws("/", F.lit(str(seed)), F.col("again").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("-")))
    queued = queued.withColumn("place", F.conv(F.substring(F.md5(spelled), 1, 15), 16, 10).cast("long"))
    queue = ["number", "again", "place", "id", "size", "row"]
    queued = running_totals(queued, queue, "size", "upto")

    last = F.greatest(F.ceil(F.col("size") / F.col("packet")) - 1, F.lit(0)).cast("long")
    packets = queued.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    packets = packets.withColumn("words", F.least(F.col("packet"), F.col("size") - F.col("part") * F.col("packet")))
    done = F.col("upto") - F.col("before") - F.col("size") + F.col("part") * F.col("packet") + F.col("words")
    packets = packets.withColumn("finish", F.when(F.col("target") > 0, done / F.col("target")).otherwise(0.0))
    line = running_totals(packets.drop("upto", "before", "passes", "packet"), ["finish", *queue, "part"], "words", "total")
    left = F.col("all_words") - (F.col("total") - F.col("words"))
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), left))
    out = line.groupBy("row", "id", "size", "source_size", "target").agg(F.sum(taken).alias("taken"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")
