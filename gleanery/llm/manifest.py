"""A Merkle manifest of documents: radix ranks, then a trie over the ranks' digits.

A document's leaf is the SHA-256 of its fields. Inside a source the leaves ascend by id, and every ``FANOUT``
consecutive nodes (the last run may have fewer, even one) become one, until one is left: the subroot. Subroots,
ordered by source, give the root likewise. A digest is hashed as its 64 lowercase hex digits.

*Ranks without a global sort* (``radix_ranks``). A row's key is bytes; rows are counted by group and all up to the first
byte in which a group's keys differ, and a running sum over the counts of siblings (256 at most) gives each bucket the rank
of its first row. Buckets of more than ``most`` rows are counted again up to the next byte in which their keys differ, and so on, so all that
is ever sorted is one small bucket. A document's key is its id (null first), 64 bits of its leaf and its row number, so a
bucket of rows with one id, however many, splits further.

*The trie.* Rank ``r`` in base ``FANOUT`` spells the way from the subroot to the leaf: ``r // FANOUT**l`` names its node on
level ``l``, and nodes with the same prefix reduce to their parent. A task reduces blocks of ``FANOUT**LEVELS`` neighbours, that is
``LEVELS`` levels at a time; then the blocks' nodes are dealt anew. On the way down each block gets its siblings above as
one more row ahead of its own, so no row carries them through a shuffle, and each leaf ends with all its siblings.

Defined cases: null fields are hashed as ``-``; null ids come first and are never tampered with; rows with one id ascend by leaf,
and equal rows are leaves each, in any order; null and '' are two sources, null before all others; an empty table gives an
empty result; a lone leaf is its own subroot, a lone subroot the root, and the proof of both is the hash of nothing.
Bytes that are not UTF-8 are hashed as they are. Result columns alone are returned, so no other column can clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import cut_lineage, join_small, salted_join

FANOUT = 3
#: Levels of the trie that a task reduces at once: blocks of 729.
LEVELS = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value as text, a colon and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def leaves(docs: DataFrame, fields: list[str], id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(doc_id, source_key, digest, other, key): ``other`` is the leaf with the text tampered with, null where it is not."""
    values = {c: docs[c] for c in fields}
    broken = dict(values) | {text_col: F.replace(docs[text_col], F.lit("\n"), F.lit(""))}
    hit = (F.crc32(docs[id_col].cast("string")) % 2 == 0) & F.contains(docs[text_col], F.lit("\n"))
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.when(docs[source_col].isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), docs[source_col].cast("string").cast("binary"))).alias("source_key"),
        leaf(list(values.values())).alias("digest"),
        F.when(hit, leaf(list(broken.values()))).alias("other"),
        F.monotonically_increasing_id().alias("row"),
    )
    ident = F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))  # unsigned order
    spelled = F.when(F.col("doc_id").isNull(), F.lit("00" * 9)).otherwise(F.concat(F.lit("01"), F.lpad(F.hex(ident), 16, "0")))
    key = F.unhex(F.concat(spelled, F.hex(F.substring("digest", 1, 8)), F.lpad(F.hex("row"), 16, "0")))
    return cut_lineage(rows.select("doc_id", "source_key", "digest", "other", key.alias("key")))


def first_difference(one: str, other: str) -> Column:
    """The place, from 1, of the first byte in which two byte columns differ; null if they are equal."""
    return F.expr(f"array_min(filter(sequence(1, greatest(length({one}), length({other}), 1)), i -> substring({one}, i, 1) <> substring({other}, i, 1)))")


def radix_ranks(rows: DataFrame, group: str, key: str, most: int = 4096) -> DataFrame:
    """The rows and ``rank``: each row's place, from 0, among the rows of its group by the bytes of its key.

    Keys differ inside a group and no column is null. A round takes the first byte in which the keys of a bucket differ.
    """
    active, placed = rows.withColumn("__base", F.lit(0).cast("long")), []
    while active is not None:
        ends = active.groupBy(group, "__base").agg(F.min(key).alias("__low"), F.max(key).alias("__high"))
        take = ends.select(first_difference("__low", "__high").alias("at")).agg(F.min("at")).first()[0] or 1
        active = active.withColumn("__prefix", F.substring(key, 1, take))
        counted = active.groupBy(group, "__base", "__prefix").agg(F.count("*").alias("__count"))
        siblings = Window.partitionBy(group, "__base").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
        buckets = cut_lineage(counted.withColumn("__next", F.col("__base") + F.coalesce(F.sum("__count").over(siblings), F.lit(0))))
        joined = join_small(active, buckets, [group, "__base", "__prefix"], "inner").drop("__base", "__prefix").withColumnRenamed("__next", "__base")
        last = buckets.where(F.col("__count") > most).isEmpty()
        joined = joined if last else cut_lineage(joined)
        placed.append(joined.where(F.col("__count") <= most).drop("__count"))
        active = None if last else joined.where(F.col("__count") > most).drop("__count")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    inside = Window.partitionBy(group, "__base").orderBy(key)
    return out.withColumn("rank", F.col("__base") + F.row_number().over(inside) - 1).drop("__base")


def height(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def above(n: int, levels: int) -> int:
    for _ in range(levels):
        n = -(-n // FANOUT)
    return n


def combine(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The block's nodes on each level, its own first."""
    out = [nodes]
    for _ in range(levels):
        nodes = [combine(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        out.append(nodes)
    return out


def siblings(levels: list[list[str]], place: int) -> str:
    """The others of the run on each level, left to right, of the node at that place of the block."""
    out = []
    for nodes in levels[:-1]:
        run = place - place % FANOUT
        out += [x for i, x in enumerate(nodes[run : run + FANOUT], run) if i != place]
        place //= FANOUT
    return "".join(out)


def fold(digest: str, others: str, ways: list[tuple[int, int]]) -> str:
    """The root from a leaf and its siblings; each way is the place among n nodes of one tree, leaf tree first."""
    at = 0
    for place, n in ways:
        while n > 1:
            own = place % FANOUT
            count = min(FANOUT, n - (place - own)) - 1
            left, right = at + 64 * own, at + 64 * count
            digest = hashlib.sha256((others[at:left] + digest + others[left:right]).encode()).hexdigest()
            at, place, n = right, place // FANOUT, -(-n // FANOUT)
    return digest


def whole_blocks(batches, names: list[str]):
    """Lists of rows with equal first two columns, out of batches that are sorted by them; at most a block is held."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if rows and rows[0][:2] != row[:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def table_of(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[] for _ in names], kinds)], names)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a block together, in order."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")


def with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {FANOUT**LEVELS}"))


def reduce_blocks(nodes: DataFrame) -> DataFrame:
    """(grp, idx, n, digest) of the nodes ``LEVELS`` levels up, or less where a group's tree ends below."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        out = []
        for rows in whole_blocks(batches, ["grp", "block", "n", "digest"]):
            grp, block, n, _ = rows[0]
            levels = min(LEVELS, height(n))
            out.append((grp, block, above(n, levels), bytes.fromhex(climb([r[3].hex() for r in rows], levels)[-1][0])))
            if len(out) == 1000:
                yield table_of(["grp", "idx", "n", "digest"], kinds, out)
                out = []
        yield table_of(["grp", "idx", "n", "digest"], kinds, out)

    rows = dealt(with_block(nodes.select("grp", "idx", "n", "digest")))
    return cut_lineage(rows.mapInArrow(run, "grp long, idx long, n long, digest binary"))


def towers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and all tables of nodes above them, ``LEVELS`` levels apart; the last has one row for each group."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    for _ in range(-(-height(largest) // LEVELS)):
        out.append(reduce_blocks(out[-1]))
    return out


def descend(nodes: DataFrame, upper: DataFrame, finish, schema: str) -> DataFrame:
    """Rows of ``finish(siblings, crown, idx, n, digest, other, doc_id, grp)`` for each node. ``upper`` has (grp, idx, path, crown) of each block."""
    blank = {"n": "long", "digest": "binary", "other": "binary", "doc_id": "long"}
    heads = upper.select("grp", F.lit(-1).cast("long").alias("idx"), *[F.lit(None).cast(t).alias(c) for c, t in blank.items()], "path", "crown", F.col("idx").alias("block"))
    own = with_block(nodes).select("grp", "idx", *blank, F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("crown"), "block")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        out = []
        for head, *rows in whole_blocks(batches, ["grp", "block", "idx", *blank, "path", "crown"]):
            path, crown = head[-2:]
            levels = climb([r[4].hex() for r in rows], min(LEVELS, height(rows[0][3])))
            for place, (grp, _, idx, n, digest, other, doc_id, _, _) in enumerate(rows):
                out.append(finish(siblings(levels, place) + path, crown, idx, n, digest.hex(), other and other.hex(), doc_id, grp))
            if len(out) >= 1000:
                yield table_of(names, kinds, out)
                out = []
        yield table_of(names, kinds, out)

    return dealt(own.unionByName(heads)).mapInArrow(run, schema)


def paths(tables: list[DataFrame], crowns: DataFrame, finish, schema: str) -> DataFrame:
    """``finish`` for each row of the lowest table, with the siblings of all levels. ``crowns`` has (grp, idx, path, crown) of the highest."""

    def step(others, crown, idx, n, digest, other, doc_id, grp):
        return grp, idx, others, crown

    for nodes in reversed(tables[1:-1]):
        filled = nodes.select("*", F.lit(None).cast("binary").alias("other"), F.lit(None).cast("long").alias("doc_id"))
        crowns = cut_lineage(descend(filled, crowns, step, "grp long, idx long, path string, crown string"))
    return descend(tables[0], crowns, finish, schema)


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: list[str] | None = None, most: int = 4096) -> DataFrame:
    """One row for each document: its leaf, subroot, root and proof, and what the proof makes of the tampered leaf.

    ``fields`` are the columns that are hashed, ``text_col`` among them; ids are integers.
    """
    rows = leaves(docs, fields or FIELDS, id_col, source_col, text_col)
    sources = radix_ranks(rows.groupBy("source_key").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), "all", "source_key", most)
    sources = cut_lineage(sources.select("source_key", "n", F.col("rank").alias("grp")))
    count = sources.count()
    # one source may hold much of all rows: broadcast if sources are few, else with a salt
    joined = rows.join(F.broadcast(sources), "source_key") if count <= 200_000 else salted_join(rows, sources, "source_key")
    ranked = radix_ranks(joined.select("grp", "n", "doc_id", "digest", "other", "key"), "grp", "key", most)
    nodes = cut_lineage(ranked.select("grp", F.col("rank").alias("idx"), "n", "digest", "other", F.col("doc_id").cast("long").alias("doc_id")))

    trees = towers(nodes)
    subroots = trees[-1].select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), F.lit(count).cast("long").alias("n"), "digest")
    crowning = towers(subroots)
    root = crowning[-1].select("grp", "idx", F.lit("").alias("path"), F.lower(F.hex("digest")).alias("crown"))
    bare = subroots.select("*", F.lit(None).cast("binary").alias("other"), F.lit(None).cast("long").alias("doc_id"))

    def crown(others, top, idx, n, digest, other, doc_id, grp):
        return idx, 0, others, digest + top

    def proof(others, crown, idx, n, digest, other, doc_id, grp):
        folded = fold(other or digest, others, [(idx, n), (grp, count)])
        return doc_id, digest, crown[:64], crown[64:], hashlib.sha256(others.encode()).hexdigest(), folded, folded == crown[64:]

    tops = cut_lineage(paths([bare, *crowning[1:]] if len(crowning) > 1 else [bare], root, crown, "grp long, idx long, path string, crown string"))
    out = paths(trees, tops, proof, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
