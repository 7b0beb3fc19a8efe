"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models, one of target documents and one of all others, share one vocabulary:
all words of all documents. Both have the same order and smoothing, and the larger model's counts are
scaled to the smaller's number of tokens, so that they are matched. A document's score is the mean
over its tokens of ``loss under target - loss under background``; low scores look like the target.

All documents, words and bigrams are counted; nothing is bounded by a vocabulary or by buckets that
share a count. Words and bigrams are known by 64-bit hashes; of n kinds about ``n**2 / 2**65`` pairs
share one. The work goes in three steps over the texts:

1. A sample of about ``SAMPLE`` bytes names the bigrams that are worth broadcasting. It decides where a
   bigram is counted, never how: each count is that of all documents.
2. All words are counted, by ranges of the hash (``buckets``, as many as the texts' bytes ask for);
   those that come to 1 in ``HOT_WORDS`` of the tokens that so many bytes hold at about six a token, at most
   three times ``HOT_WORDS`` of them, are broadcast with the bigrams of step 1.
3. A task deals the other bigrams of about ``CHUNK`` tokens, summed by document, to the buckets: one
   row a bucket, sorted by hash and compressed. A bigram with a rare second word goes to that word, so
   the bucket has both counts; what is left is too rare to fill a bucket. Each bucket returns its sums
   by document to the chunk, where they meet the part of the broadcast words.

Words are runs of characters other than space and U+0009 to U+000D, in lower case; before the first
word of a document stands a begin mark.

Defined cases: null text counts as empty; a document without words has 0 tokens and null losses; rows
with a null id are background; repeated rows are counted and scored each; without target or background
documents that model is uniform over the vocabulary; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleanery.llm.common import double, long, slices, strings

#: One in so many tokens makes a word or a bigram a broadcast one.
HOT_WORDS, HOT_PAIRS = 1 << 17, 1 << 16
#: Tokens, at six bytes each, that a task deals at once; bytes of text to a bucket and in the sample.
CHUNK, BUCKET, SAMPLE = 800_000, 6 << 20, 16 << 20
#: Hash of the begin mark; factors of a bigram's words.
BEGIN, FIRST, SECOND = np.uint64(1), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Chunk:
    """Documents together: their models (``k_of``) and ids, the number of words of each; of all words the place in the table of
    different words, the hash, and whether it is the first of a document; of each with the word before it one hash."""

    def __init__(self, k_of: np.ndarray, ids: list, texts: list[pa.Array]):
        lists = pc.ascii_split_whitespace(pa.chunked_array(texts, pa.string()).combine_chunks())
        words, parents = lists.flatten(), pc.list_parent_indices(lists)
        full = pc.not_equal(words, "")
        named = words.filter(full).dictionary_encode()
        self.k_of, self.ids = k_of, ids
        self.doc = parents.filter(full).to_numpy().astype(np.uint32)
        self.sizes = np.bincount(self.doc, minlength=len(k_of))
        self.number = named.indices.to_numpy()
        self.table = pd.util.hash_array(named.dictionary.to_numpy(zero_copy_only=False), categorize=False)
        self.words = self.table[self.number]
        self.first = np.r_[True, self.doc[1:] != self.doc[:-1]][: len(self.doc)]
        self.before = np.where(self.first, BEGIN, np.r_[BEGIN, self.words[:-1]][: len(self.words)])
        self.pairs = self.before * FIRST + self.words * SECOND


def lowered(column: pa.Array) -> pa.Array:
    """Texts in lower case; null is empty, and bytes that are not UTF-8 come as U+FFFD."""
    try:
        return pc.utf8_lower(column.fill_null(""))
    except pa.ArrowInvalid:
        return pc.utf8_lower(pa.array([t or "" for t in strings(column)], pa.string()))


def chunks(batches) -> Iterator[Chunk]:
    """Chunks of about ``CHUNK`` tokens of rows with columns t, x and, if asked, id."""
    texts, ids, marks, size = [], [], [], 0
    for part in slices(batches):
        low = lowered(part.column("x"))
        texts.append(low)
        marks.append(part.column("t").to_numpy(zero_copy_only=False).astype(np.int64))
        ids += part.column("id").to_pylist() if "id" in part.schema.names else []
        size += (pc.sum(pc.binary_length(low)).as_py() or 0) // 6
        if size >= CHUNK:
            yield Chunk(np.concatenate(marks), ids, texts)
            texts, ids, marks, size = [], [], [], 0
            pa.default_memory_pool().release_unused()
    if texts:
        yield Chunk(np.concatenate(marks), ids, texts)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of sorted hashes begins, and the end."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of one rank side by side, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def spread_out(data: bytes, kind) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.decompress(data), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _rows(names: list[str], columns: list, schema: pa.Schema | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) if schema else pa.array(c) for n, c in zip(names, columns)], names)


def by_bucket(batches) -> Iterator[tuple[int, list]]:
    """Whole buckets, in a partition sorted by its first column: the value and its rows as dicts."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if rows and r[b.schema.names[0]] != now:
                yield now, rows
                rows = []
            now = r[b.schema.names[0]]
            rows.append(r)
    if rows:
        yield now, rows


class Frequent:
    """Counts, scaled, of the broadcast words and bigrams (sorted by hash); ``[k]`` of target (1) and background (0)."""

    def __init__(self, words, single, pairs, both, totals, kinds: int, smoothing: float = 0.5, weight: float = 4.0):
        self.scale = totals.min() / totals if totals.min() > 0 else np.ones(2)
        self.words, self.single, self.pairs, self.both = words, single * self.scale[:, None], pairs, both * self.scale[:, None]
        self.smoothing, self.weight = smoothing, weight
        self.whole = totals * self.scale + smoothing * max(kinds, 1)

    def plain(self, k: int, counts: np.ndarray) -> np.ndarray:
        return (counts + self.smoothing) / self.whole[k]

    def joint(self, k: int, both: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Loss of a word after another but for the context's part."""
        return -np.log(both + self.weight * self.plain(k, single))

    def context(self, k: int, single: np.ndarray) -> np.ndarray:
        return np.log(single + self.weight)


def likely_pairs(source: DataFrame, size: int) -> np.ndarray:
    """Hashes of bigrams that come to 1 in ``HOT_PAIRS`` of the tokens of a sample, at most ``HOT_PAIRS`` of them."""
    million = 1_000_000
    share = min(million, million * SAMPLE // max(size, 1) + 1)
    sample = source.where(F.pmod(F.xxhash64("id", "x"), F.lit(million)) < share).select("t", "x")

    def count(batches):
        for c in chunks(batches):
            keys, n = np.unique(c.pairs, return_counts=True)
            yield _rows(["key", "n"], [keys[n > 1].view(np.int64), n[n > 1]])
            yield _rows(["key", "n"], [pa.array([None], pa.int64()), [len(c.words)]])

    counted = sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    keys, n = counted["key"].to_pandas(), counted["n"].to_numpy()
    total = n[keys.isna().to_numpy()].sum()
    hot = keys.notna().to_numpy() & (n * HOT_PAIRS >= total)
    return np.sort(counted["key"].filter(pa.array(hot)).to_numpy().view(np.uint64))


def frequent(source: DataFrame, size: int, buckets: int) -> Frequent:
    """From rows (id, t, x) the frequent words and bigrams, with exact counts."""
    pairs = likely_pairs(source, size)
    enough = max(1, size // (6 * HOT_WORDS))
    names = ["bucket", "kind", "keys", "n"]

    def count(batches):
        """Kinds: 0 and 1 words of each model, 2 and 3 chosen bigrams, with the begin mark for the documents that have words."""
        both, begins = np.zeros((2, len(pairs)), np.int64), np.zeros(2, np.int64)
        for c in chunks(batches):
            at, there = find(pairs, c.pairs)
            k_word, order = c.k_of[c.doc], np.argsort(c.table)
            begins += np.bincount(c.k_of[c.sizes > 0], minlength=2)
            for k in (0, 1):
                both[k] += np.bincount(at[there & (k_word == k)], minlength=len(pairs))
                n = np.bincount(c.number[k_word == k], minlength=len(c.table))[order]
                yield from deal(k, c.table[order][n > 0], n[n > 0])
        for k in (0, 1):
            at = np.flatnonzero(both[k])
            yield from deal(2 + k, np.r_[BEGIN, pairs[at]], np.r_[begins[k], both[k][at]])

    def deal(kind, keys, n):
        edges = cuts(keys, buckets)
        full = np.flatnonzero(np.diff(edges))
        parts = [(_steps(keys[edges[b] : edges[b + 1]]), n[edges[b] : edges[b + 1]]) for b in full]
        yield _rows(names, [full.astype(np.int32), np.full(len(full), kind, np.int32), pa.array([squeeze(a) for a, _ in parts], pa.binary()), pa.array([squeeze(b) for _, b in parts], pa.binary())])

    def meet(batches):
        """(kind, key, n): frequent words, all chosen bigrams; kind 4 the number of words in a bucket, 5 and 6 each model's tokens."""
        for _, rows in by_bucket(batches):
            found = []
            for kind in range(4):
                mine = [r for r in rows if r["kind"] == kind]
                keys = np.concatenate([np.cumsum(spread_out(r["keys"], np.uint64), dtype=np.uint64) for r in mine]) if mine else np.zeros(0, np.uint64)
                n = np.concatenate([spread_out(r["n"], np.int64) for r in mine]) if mine else np.zeros(0, np.int64)
                keys, which = np.unique(keys, return_inverse=True)
                found.append((keys, np.bincount(which, n, len(keys)).astype(np.int64)))
            words = np.unique(np.concatenate([k for k, _ in found[:2]]))
            sums = np.zeros((2, len(words)), np.int64)
            for k in (0, 1):
                sums[k, np.searchsorted(words, found[k][0])] = found[k][1]
            hot = sums.sum(0) >= enough
            out = [(k, words[hot], sums[k][hot]) for k in (0, 1)] + [(2 + k, *found[2 + k]) for k in (0, 1)]
            out += [(4, np.zeros(1, np.uint64), np.array([len(words)])), *[(5 + k, np.zeros(1, np.uint64), sums[k].sum(keepdims=True)) for k in (0, 1)]]
            for kind, keys, n in out:
                yield _rows(["kind", "key", "n"], [np.full(len(keys), kind, np.int32), keys.view(np.int64), n])

    dealt = source.select("t", "x").mapInArrow(count, "bucket int, kind int, keys binary, n binary").repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(meet, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()  # at most 3 HOT_WORDS and HOT_PAIRS
    kind, key, n = found["kind"].to_numpy(), found["key"].to_numpy().view(np.uint64), found["n"].to_numpy().astype(float)

    def counts(table: np.ndarray, base: int) -> np.ndarray:
        out = np.zeros((2, len(table)))
        for k in (0, 1):
            at, there = find(table, key[kind == base + k])
            out[k, at[there]] = n[kind == base + k][there]
        return out

    words = np.unique(np.r_[key[kind < 2], BEGIN])
    single, begins = counts(words, 0), counts(np.array([BEGIN]), 2)
    single[:, np.searchsorted(words, BEGIN)] = begins[:, 0]
    totals = np.array([n[kind == 5].sum(), n[kind == 6].sum()])
    return Frequent(words, single, pairs, counts(pairs, 2), totals, int(n[kind == 4].sum()))


#: What ``deal`` sends to a bucket, in order, and how it is kept; the steps between sorted hashes instead of the hashes.
PARTS = [("pair", "<u8"), ("pair_doc", "<u4"), ("pair_n", "<u4"), ("pair_word", "<u4"), ("rare", "<u8"), ("rare_pair", "<u8"), ("rare_doc", "<u4"), ("rare_n", "<u4"), ("lead", "<u8"), ("lead_doc", "<u4"), ("lead_n", "<u4")]


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a row differs from the one before, and how many rows each run has."""
    size = len(columns[0])
    new = np.ones(size, bool)
    if size:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return at, np.diff(np.r_[at, size])


def deal_chunk(c: Chunk, m: Frequent) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What a chunk's documents get from the broadcast counts (target, background), and the columns of ``PARTS``."""
    sizes, words, before, pairs, doc = c.sizes, c.words, c.before, c.pairs, c.doc
    (w, known), (b, met) = find(m.words, c.table), find(m.pairs, pairs)
    w, known = w[c.number], known[c.number]
    met &= known
    v = np.where(c.first, np.searchsorted(m.words, BEGIN), np.r_[0, w[:-1]][: len(w)])
    led = c.first | np.r_[True, known[:-1]][: len(w)]
    losses = []
    for i in (1, 0):
        loss = np.bincount(doc[met], m.joint(i, m.both[i][b[met]], m.single[i][w[met]]), len(sizes)).astype(float)
        losses.append(loss + np.bincount(doc[led], m.context(i, m.single[i][v[led]]), len(sizes)))
    mark = doc << 1 | c.k_of[doc].astype(np.uint32)  # the document and its model
    pick = known & ~met
    order = np.argsort(pairs[pick], kind="stable")
    key, mine, word = pairs[pick][order], mark[pick][order], w[pick][order].astype(np.uint32)
    at, n = runs(key, mine)
    parts = [key[at], mine[at], n.astype(np.uint32), word[at]]
    pick = ~known
    order = np.lexsort((pairs[pick], words[pick]))
    place, key, mine = words[pick][order], pairs[pick][order], mark[pick][order]
    at, n = runs(place, key, mine)
    parts += [place[at], key[at], mine[at], n.astype(np.uint32)]
    pick = ~led
    order = np.argsort(before[pick], kind="stable")
    place, mine = before[pick][order], mark[pick][order]
    at, n = runs(place, mine)
    return losses, [*parts, place[at], mine[at], n.astype(np.uint32)]


def gather(rows: list[list[bytes]], m: Frequent) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of a bucket's rows (``PARTS``): its documents, and their losses under target and background."""
    held: dict[str, list] = {name: [] for name, _ in PARTS}
    for number, parts in enumerate(rows):
        for (name, kind), data in zip(PARTS, parts):
            values = spread_out(data, kind)
            if name in ("pair", "rare", "lead"):
                values = np.cumsum(values, dtype=np.uint64)
            held[name].append(values.astype(np.uint64) | np.uint64(number << 33) if name.endswith("_doc") else values)
    c = {name: np.concatenate(x) for name, x in held.items()}
    pair, rare = (np.unique(c[x], return_inverse=True)[1] for x in ("pair", "rare_pair"))
    places, place = np.unique(c["rare"], return_inverse=True)
    lead = np.searchsorted(places, c["lead"])
    docs, which = np.unique(np.concatenate([c["pair_doc"], c["rare_doc"], c["lead_doc"]]), return_inverse=True)
    sums = []
    for i in (1, 0):
        mine = {x: c[f"{x}_n"] * (c[f"{x}_doc"] & np.uint64(1) == i) * m.scale[i] for x in ("pair", "rare")}
        single = np.bincount(place, mine["rare"], len(places))
        losses = [
            c["pair_n"] * m.joint(i, np.bincount(pair, mine["pair"])[pair], m.single[i][c["pair_word"]]),
            c["rare_n"] * m.joint(i, np.bincount(rare, mine["rare"])[rare], single[place]),
            c["lead_n"] * m.context(i, single[lead]),
        ]
        sums.append(np.bincount(which, np.concatenate(losses), len(docs)).astype(np.float32))
    edges = np.searchsorted(docs >> np.uint64(33), np.arange(len(rows) + 1, dtype=np.uint64))
    number = (docs >> np.uint64(1)).astype(np.uint32)
    return [(number[a:b], sums[0][a:b], sums[1][a:b]) for a, b in zip(edges, edges[1:])]


def score_all(source: DataFrame, id_col: str) -> DataFrame:
    """Of rows (id, t, x) the id, ``n_tokens``, ``target_loss``, ``background_loss`` and ``score``."""
    size = source.agg(F.sum(F.octet_length("x")).alias("n")).first()["n"] or 0
    buckets = size // BUCKET + 1
    shared = source.sparkSession.sparkContext.broadcast(frequent(source, size, buckets))  # bounded by HOT_WORDS and HOT_PAIRS
    key = source.schema["id"].dataType
    moved = T.StructType([T.StructField("bucket", T.IntegerType()), long("chunk"), T.StructField("parts", T.ArrayType(T.BinaryType())), T.StructField("ids", T.ArrayType(key))])
    result = T.StructType([T.StructField(id_col, key), long("n_tokens"), double("target_loss"), double("background_loss"), double("score")])

    def deal(batches):
        m, task, out = shared.value, TaskContext.get().partitionId(), to_arrow_schema(moved)
        for number, c in enumerate(chunks(batches)):
            chunk = task << 24 | number
            losses, parts = deal_chunk(c, m)
            edges = [cuts(parts[i], buckets) for i in (0, 4, 8) for _ in range(4 if i < 8 else 3)]
            for b in range(buckets):
                mine = [p[e[b] : e[b + 1]] for p, e in zip(parts, edges)]
                if any(map(len, mine)):
                    yield _rows(out.names, [[b], [chunk], [[squeeze(_steps(p) if i in (0, 4, 8) else p) for i, p in enumerate(mine)]], [None]], out)
            yield _rows(out.names, [[chunk % buckets], [chunk], [[squeeze(c.sizes), *map(squeeze, losses)]], [c.ids]], out)

    def meet(batches):
        m, out = shared.value, to_arrow_schema(moved)
        for b, rows in by_bucket(batches):
            for r in rows:
                if r["ids"] is not None:  # what the chunk keeps of its documents
                    yield _rows(out.names, [[b], [r["chunk"]], [r["parts"]], [r["ids"]]], out)
            rows = [r for r in rows if r["ids"] is None]
            for r, sums in zip(rows, gather([r["parts"] for r in rows], m) if rows else []):
                yield _rows(out.names, [[b], [r["chunk"]], [list(map(squeeze, sums))], [None]], out)

    def finish(batches):
        out = to_arrow_schema(result)
        for _, rows in by_bucket(batches):
            own = next(r for r in rows if r["ids"] is not None)
            sizes, target, background = (spread_out(x, kind).copy() for x, kind in zip(own["parts"], (np.int64, float, float)))
            for r in rows:
                if r["ids"] is None:
                    docs, *sums = (spread_out(x, kind) for x, kind in zip(r["parts"], (np.uint32, np.float32, np.float32)))
                    target[docs] += sums[0]
                    background[docs] += sums[1]
            empty = sizes == 0
            target, background = (np.round(x / np.maximum(sizes, 1), 6) for x in (target, background))
            score = np.round(target - background, 6)
            yield pa.RecordBatch.from_arrays([pa.array(own["ids"], out.field(0).type), pa.array(sizes), *[pa.array(x, mask=empty) for x in (target, background, score)]], schema=out)

    dealt = source.mapInArrow(deal, moved).repartition("bucket").sortWithinPartitions("bucket")
    met = dealt.mapInArrow(meet, moved).select("chunk", "parts", "ids").repartition("chunk").sortWithinPartitions("chunk")
    return met.mapInArrow(finish, result)


def cross_entropy_difference(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 200_000
) -> DataFrame:
    """Score all documents; the target is those with a label row whose ``label_col`` is 1.

    Up to ``max_rows`` target ids are broadcast; of more the join is a shuffle, after which rows are sorted, so that a task that
    runs again deals the same chunks.
    """
    good = labels.where(labels[label_col] == 1).select(labels[id_col].alias("id")).where("id is not null").distinct().withColumn("target", F.lit(True))
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("x"))
    few = good.limit(max_rows + 1).count() <= max_rows
    marked = source.join(F.broadcast(good) if few else good, "id", "left").select("id", F.coalesce("target", F.lit(False)).alias("t"), "x")
    return score_all(marked if few else marked.sortWithinPartitions("id", "x"), id_col)
