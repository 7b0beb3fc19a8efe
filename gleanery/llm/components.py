"""Connected components of an edge table: forests inside tasks, alternating with star steps between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import cut_lineage, salted_join

#: Edges that a task joins at a time.
PIECE = 100_000


class Joined:
    """Sets that grow together."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        """Were they apart before?"""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _joined(edges: DataFrame, piece: int) -> DataFrame:
    """The edges (u > v) of each task, ``piece`` at a time, as a forest of stars: each node but the smallest of its tree gives one edge to that.

    The last node of a piece goes on to the next one, so that of sorted rows all edges of one ``u`` are joined.
    """

    def run(batches):
        held, size = [], 0

        def flush(last):
            nonlocal held, size
            joined = Joined()
            pairs = np.concatenate(held)
            for a, b in pairs.tolist():
                joined.join(a, b)
            goes_on = int(pairs[-1, 0])
            nodes = [x for x in joined.parent if last or x != goes_on]
            held, size = [np.array([[goes_on, joined.root(goes_on)]], np.int64)], 1
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([joined.root(x) for x in nodes], pa.int64())], ["u", "v"])

        for b in batches:
            if b.num_rows:
                held.append(np.column_stack([b.column("u").to_numpy(), b.column("v").to_numpy()]))
                size += b.num_rows
            if size > piece:
                yield flush(False)
        if size:
            yield flush(True)

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, max_rounds: int = 50, few: int = 200_000, piece: int = PIECE) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of an edge (``u``, ``v``: long).

    A round joins what the edges of a task link, deals the edges by their larger end and joins again (a node comes once from
    each piece, so none is crowded); then the edges whose smaller end has a smaller neighbour move to the smallest one. The
    nodes between, which are not yet the leaf or the centre of a star, are counted: up to ``few`` are broadcast, more are joined
    with salts, so a hub's edges are dealt to several tasks. Each round is written to the checkpoint folder; rounds grow with
    the logarithm of the diameter. Edges with a null end and loops are left out; repeated edges do no harm.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for _ in range(max_rounds):
        now = cut_lineage(_joined(_joined(now, piece).repartition("u").sortWithinPartitions("u"), piece))
        both = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("e"))
        near = cut_lineage(both.groupBy("e.node").agg(F.min("e.other").alias("least"), F.max("e.other").alias("most")))
        between = near.where("least < node and least <> most").select(F.col("node").alias("v"), "least")
        number = between.count()
        if not number:
            return near.select("node", F.least("node", "least").alias("root"))
        moved = now.join(F.broadcast(between), "v", "left") if number <= few else salted_join(now, between, "v", how="left")
        now = moved.select("u", F.coalesce("least", "v").alias("v"))
    raise RuntimeError("components did not settle")
