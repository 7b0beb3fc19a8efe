"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are dealt into zones with thresholds so that two fingerprints that differ in at
most four bits are within the threshold of at least one zone (``proves`` checks that for each layout).
In a zone the anchors are a covering code, with covering radius 1 (the perfect (15, 11) Hamming code on
15 bits and all words on the others) where the threshold is 1, and all words, with radius 0, where it is 0.
A fingerprint has one home anchor within the covering radius and is replicated to every anchor within
the radius plus the zone's threshold, so two close fingerprints meet at the home anchor of either. Each
anchor compares its homes with all that came to it; every link found is exact. Copies of one fingerprint
are one row here, so a group of copies costs nothing.

The layout follows the number n of distinct fingerprints, and links are the same under each:

==============  ====================================================  ==========  =========================
n up to         zones                                                 rows each   met at anchors, each
==============  ====================================================  ==========  =========================
``2**24``       24, 24 and 16 bits, thresholds 1, 1 and 0             about 39    about ``n / 2**14``
``2**30``       6 blocks, all 15 pairs of them, threshold 0           15          about ``n / 2**17``
beyond          8 blocks, all 70 fours of them, threshold 0           70          about ``n / 2**26``
==============  ====================================================  ==========  =========================

An anchor with more than ``CROWD`` rows walks its links as a forest instead of comparing all its homes, so it
never gives all pairs; the components are the same.

Wide fingerprints (``drop_similar``) are for similarities of whole texts, where many bits differ: 512 bits over
the different shingles, whose share of differing bits estimates their Jaccard similarity. No layout of few zones proves links there.
``wide_zones`` draws zones of random bits, as many as bring a pair of just that similarity together with probability ``recall``. In a zone the anchors
are the words of the (15, 11) Hamming code on 15 of its bits (covering radius 1, threshold 0, so each fingerprint goes to the one anchor within
the radius) with all words on the others, of which there are more with the logarithm of n, so that few fingerprints that are not alike meet.
What an anchor proposes is only a candidate, told by ``SKETCH`` bits with a margin of over three standard deviations: every link is then
verified by the exact Jaccard similarity of the two texts' sets of shingles. An anchor proposes a forest of the closest pairs, not all of them, and it does so in
two rounds: what the first ``EARLY`` zones propose is verified and joined, and the other zones propose pairs of what that left apart. So a group of near copies gives a few
pairs a text, and a text that is linked to any other of its group has many chances to be found.

Words are runs of characters other than space and U+0009 to U+000D, of the text with A to Z in lower case.

Defined cases: null text counts as empty; texts without a word have fingerprint zero and are linked like
others; rows with a null id take part, and ``component_id`` is the smallest id that is not null, null
if there is none; repeated rows give a row each; an empty table gives an empty result. Components that do not settle in
50 rounds raise an error (rounds grow with the logarithm of the longest chain of links).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import long, slices, text_map
from gleanery.llm.components import Joined, connected_components
from gleanery.session import cut_lineage, salted_join

#: A zone is its blocks of bits (shift, width) and a threshold; those with a threshold use the Hamming code on their low 15 bits.
Zone = tuple[tuple[tuple[int, int], ...], int]
#: Rows at an anchor beyond which it walks a forest.
CROWD = 256


def blocks(widths: list[int], chosen: int, threshold: int = 0) -> list[Zone]:
    """Zones of all choices of so many blocks."""
    placed = [(sum(widths[:i]), w) for i, w in enumerate(widths)]
    return [(c, threshold) for c in combinations(placed, chosen)]


LAYOUTS: list[tuple[int, list[Zone]]] = [
    (1 << 24, [(((0, 24),), 1), (((24, 24),), 1), (((48, 16),), 0)]),
    (1 << 30, blocks([11, 11, 11, 11, 10, 10], 2)),
    (1 << 62, blocks([8] * 8, 4)),
]


def proves(zones: list[Zone], bits: int = 4) -> bool:
    """Is any set of so many places within the threshold of some zone? Only their number in each block matters."""
    parts = sorted({b for z, _ in zones for b in z})
    return all(any(sum(at.count(b) for b in z) <= t for z, t in zones) for at in combinations_with_replacement(parts, bits))


def layout(n: int) -> list[Zone]:
    return next(zones for most, zones in LAYOUTS if n <= most)


def shingles(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of all shingles in order, of the whole text if it has fewer words; none without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts]) - 1
    if len(parts) <= words:
        spans = [(0, len(joined))]
    else:
        spans = zip([0, *(ends[: len(parts) - words] + 1).tolist()], ends[words - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, max(1, len(parts) - words + 1))


def majority(hashes: np.ndarray) -> bytes:
    """The bits set in over half of the rows of big-endian hashes."""
    counts = np.zeros(8 * hashes.shape[1] * hashes.itemsize, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles, repeats included; zero without words."""
    return int.from_bytes(majority(shingles(text, words, seed).astype(">u8")[:, None]), "big", signed=True)


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, words: int = 4, seed: int = 42) -> DataFrame:
    """The kept columns and ``fp`` (long)."""

    def make():
        return lambda texts: {"fp": [fingerprint(t, words, seed) for t in texts]}

    return text_map(docs, text_col, make, T.StructType([long("fp")]), keep)


def hamming_masks(extra: int = 9) -> list[list[int]]:
    """For each syndrome: what to flip to reach the home anchor, then all other anchors within two flips.

    The syndrome is the exclusive or of the places (1 to 15) of the set low bits; a word is in the code
    if it is zero, so any flips with the word's syndrome lead to an anchor.
    """
    out = []
    for s in range(16):
        low = {0: [0] if s == 0 else [], 1: [1 << (s - 1)] if s else []}
        low[2] = [1 << (i - 1) | 1 << (j - 1) for i in range(1, 16) for j in range(i + 1, 16) if i ^ j == s]
        high = {0: [0], 1: [1 << (15 + i) for i in range(extra)]}
        high[2] = [a | b for n, a in enumerate(high[1]) for b in high[1][n + 1 :]]
        out.append([a | b for na in range(3) for nb in range(3 - na) for a in low[na] for b in high[nb]])
    return out


def syndrome(zone: Column) -> Column:
    parts = []
    for bit in range(4):
        mask = sum(1 << (i - 1) for i in range(1, 16) if i >> bit & 1)
        parts.append(F.bit_count(zone.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << bit))
    return parts[0] + parts[1] + parts[2] + parts[3]


def anchored(distinct: DataFrame, zones: list[Zone]) -> DataFrame:
    """(key, fp): key is zone and anchor, doubled, and one more for rows that are not at home there."""
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in hamming_masks()])
    sets = []
    for number, (parts, threshold) in enumerate(zones):
        zone, width = F.lit(0).cast("long"), 0
        for shift, bits in parts:
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
            zone, width = zone.bitwiseOR(F.shiftleft(part, width)), width + bits
        base = F.lit(number << 40).cast("long")
        if threshold:
            keys = F.transform(
                F.element_at(table, (syndrome(zone) + 1).cast("int")), lambda m, i: (base + zone.bitwiseXOR(m)) * 2 + F.when(i == 0, 0).otherwise(1)
            )
        else:
            keys = F.array((base + zone) * 2)
        sets.append(keys)
    return distinct.select("fp", F.explode(F.concat(*sets)).alias("key"))


def apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    return np.bitwise_count(one ^ many) if many.ndim == 1 else np.bitwise_count(one ^ many).sum(1, dtype=np.int64)


def forest(fps: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of links that span what is linked among the fingerprints of one anchor; each is reached once."""
    rest, out = np.arange(len(fps)), []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = apart(fps[one], fps[rest]) <= most
            if near.any():
                found = rest[near]
                out.append(np.stack([np.full(len(found), one), found], 1))
                front += list(found)
                rest = rest[~near]
    return out


def compare(keys: np.ndarray, fps: np.ndarray, most: int, crowd: int = CROWD) -> Iterator[np.ndarray]:
    """Places of links between the homes of each anchor and all at it, some at a time. Rows are sorted by key; anchors are whole."""
    anchors = keys >> 1
    starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    homes = np.add.reduceat((keys & 1 == 0).astype(np.int64), starts)
    for at in np.flatnonzero((sizes > crowd) & (homes > 0)):
        for tree in forest(fps[starts[at] : starts[at] + sizes[at]], most):
            yield starts[at] + tree
    small = (sizes <= crowd) & (sizes > 1) & (homes > 0)
    starts, sizes, homes = starts[small], sizes[small], homes[small]
    left = np.repeat(starts, homes) + np.arange(homes.sum()) - np.repeat(np.cumsum(homes) - homes, homes)
    widths, begins = np.repeat(sizes, homes), np.repeat(starts, homes)
    step = max(1, 250_000 // (crowd * fps[:1].size or 1))
    for at in range(0, len(left), step):
        a, w, b = left[at : at + step], widths[at : at + step], begins[at : at + step]
        i = np.repeat(a, w)
        j = np.repeat(b, w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        near = (apart(fps[i], fps[j]) <= most) & (i != j)
        yield np.stack([i[near], j[near]], 1)


def span(links: np.ndarray) -> np.ndarray:
    """Of the links a task found, those that join what was not joined yet."""
    joined = Joined()
    return links[np.array([joined.join(a, b) for a, b in links.tolist()], bool)]


def closest(pairs: np.ndarray) -> np.ndarray:
    """Of rows (u, v, bits, group of u, group of v) those that join groups that were apart, the closest first."""
    joined = Joined()
    order = np.argsort(pairs[:, 2], kind="stable")
    return pairs[order][np.array([joined.join(a, b) for a, b in pairs[order][:, 3:].tolist()], bool)]


def nearest_forest(fps: np.ndarray, groups: np.ndarray, most: int) -> np.ndarray:
    """Places of the closest pairs within ``most`` bits that join the rows' groups, tree by tree; one row is compared with all others at a time."""
    n, out = len(fps), []
    rest = np.ones(n, bool)
    best, partner = np.full(n, most + 1), np.zeros(n, np.int64)
    for _ in range(n):
        left = np.flatnonzero(rest)
        at = left[np.argmin(best[left])]
        if 0 <= best[at] <= most and groups[partner[at]] != groups[at]:
            out.append((partner[at], at))
        rest[at] = False
        left = np.flatnonzero(rest)
        bits = np.where(groups[left] == groups[at], -1, apart(fps[at], fps[left]))
        nearer = bits < best[left]
        best[left[nearer]], partner[left[nearer]] = bits[nearer], at
    return np.array(out, np.int64).reshape(-1, 2)


def proposed(keys: np.ndarray, fps: np.ndarray, groups: np.ndarray, most: int, crowd: int = CROWD) -> Iterator[np.ndarray]:
    """Places of candidate pairs of anchors, all rows being at home: small anchors' pairs within ``most`` bits, crowded ones' closest pairs."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for at, size in zip(starts[sizes > crowd], sizes[sizes > crowd]):
        yield at + nearest_forest(fps[at : at + size], groups[at : at + size], most)
    at = np.flatnonzero(np.repeat(sizes <= crowd, sizes))
    if len(at):
        for found in compare(keys[at], fps[at], most, crowd):
            yield at[found]


def _meet(rows: DataFrame, threshold: int) -> DataFrame:
    """(u, v) from rows (key, fp, and of wide fingerprints some of their bytes and a group) that are dealt and sorted by key."""
    wide = "wide" in rows.columns

    def run(batches):
        held: list[list[np.ndarray]] = [[], [], [], []]
        buffered, found, none = 0, [], np.zeros((0, 5 if wide else 2), np.int64)

        def reduced(pairs):
            if not len(pairs):
                return pairs
            pairs = np.unique(np.where((pairs[:, 0] < pairs[:, 1])[:, None], pairs, pairs[:, [1, 0, 2, 4, 3] if wide else [1, 0]]), axis=0)
            return closest(pairs) if wide else span(pairs)

        def flush(last):
            nonlocal held, buffered
            keys, ids, fps, groups = (np.concatenate(x) for x in held)
            cut = len(keys) if last else int(np.searchsorted(keys, keys[-1] >> 1 << 1))  # the last anchor may go on
            out = []
            if cut:
                for at in proposed(keys[:cut], fps[:cut], groups[:cut], threshold) if wide else compare(keys[:cut], fps[:cut], threshold):
                    at = at[groups[at[:, 0]] != groups[at[:, 1]]]
                    out.append(reduced(np.column_stack([ids[at], apart(fps[at[:, 0]], fps[at[:, 1]]), groups[at]]) if wide else ids[at]))
            held, buffered = [[x[cut:]] for x in (keys, ids, fps, groups)], len(keys) - cut
            return out

        def batch(pairs):
            kept = reduced(np.concatenate([none, *pairs]))
            return pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["u", "v"])

        for b in batches:
            if b.num_rows:
                ids = b.column("fp").to_numpy()
                bits = np.frombuffer(b"".join(b.column("wide").to_pylist()), np.uint64).reshape(len(ids), -1) if wide else ids.view(np.uint64)
                for x, new in zip(held, (b.column("key").to_numpy(), ids, bits, b.column("group").to_numpy() if wide else ids)):
                    x.append(new)
                buffered += b.num_rows
            if buffered >= (50_000 if wide else 400_000):
                found += flush(False)
                if sum(map(len, found)) >= 100_000:
                    yield batch(found)
                    found = []
        if buffered:
            found += flush(True)
        yield batch(found)

    return rows.mapInArrow(run, "u long, v long")


def links(distinct: DataFrame, threshold: int = 4, zones: list[Zone] | None = None) -> DataFrame:
    """(u, v): links that span all pairs of distinct fingerprints (``fp``) within the threshold of four bits."""
    if threshold > 4:
        raise ValueError("the zones prove links of up to four differing bits")
    spark = distinct.sparkSession
    dealt = distinct.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")  # each row becomes many
    rows = anchored(dealt, zones or layout(distinct.count())).select("key", "fp").repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return _meet(rows, threshold)


def components(prints: DataFrame, threshold: int = 4, zones: list[Zone] | None = None) -> DataFrame:
    """``fp``, ``root``, ``component_id`` and the number of rows ``n`` for each distinct fingerprint of rows with ``__id`` and ``fp``."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("__id").alias("least"), F.count("*").alias("n")))
    return _components(distinct, connected_components(links(distinct, threshold, zones)))


def _components(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    named = cut_lineage(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left"))
    alone = named.where("root is null").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"), "n")
    linked = named.where("root is not null")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return alone.unionByName(salted_join(linked, least, "root").select("fp", "root", "component_id", "n"))


def _with_component(rows: DataFrame, found: DataFrame, share: int = 1000) -> DataFrame:
    """Rows with ``fp`` and what ``components`` says of it. Fingerprints that hold 1 in ``share`` of the rows are broadcast, at
    most ``share`` of them; no other is large."""
    enough = max(1000, rows.count() // share)
    hot, rest = found.where(F.col("n") >= enough), found.where(F.col("n") < enough)
    mine = rows.join(F.broadcast(hot.select("fp", F.col("root").alias("__root"), F.col("component_id").alias("__least"), F.lit(True).alias("__hot"))), "fp", "left")
    done = mine.where("__hot").select(*rows.columns, F.col("__root").alias("root"), F.col("__least").alias("component_id"))
    others = mine.where("__hot is null").select(*rows.columns).join(rest.select("fp", "root", "component_id"), "fp")
    return done.unionByName(others.select(*done.columns))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """One row for each input row: the id, ``fingerprint`` (hex) and ``component_id``."""
    source = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__body"))
    prints = cut_lineage(fingerprints(source, "__body", ["__id"], words, seed))
    joined = _with_component(prints, cut_lineage(components(prints, threshold)))
    return joined.select(F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """The input's rows, one of each component: the one with the smallest id, of rows that share it any one."""

    def prepare(rows, body, keep):
        return fingerprints(rows, body, keep, words, seed)

    return _one_of_each(docs, id_col, text_col, prepare, lambda prints, *_: components(prints, threshold))


#: Bits of a wide fingerprint, and what a shingle's hash is multiplied by for each further 64 of them.
WIDE = 512
FACTORS = np.array([2 * (0x9E3779B97F4A7C15 * (i + 1) % 2**63) + 1 for i in range(WIDE // 64)], np.uint64)


def wide_fingerprint(text: str | None, words: int = 5, seed: int = 42) -> bytes:
    """Majority bits over the different shingles, eight mixed hashes of each."""
    hashes = np.unique(shingles(text, words, seed))
    if not len(hashes):
        return bytes(WIDE // 8)
    mixed = hashes[:, None] * FACTORS
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return majority(mixed)


def wide_fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, words: int = 5, seed: int = 42) -> DataFrame:
    """The kept columns, ``wide`` (binary) and ``fp``, a hash of it."""

    def make():
        def run(texts):
            wide = [wide_fingerprint(t, words, seed) for t in texts]
            return {"wide": wide, "fp": [int.from_bytes(xxhash.xxh64_digest(w), "big", signed=True) for w in wide]}

        return run

    return text_map(docs, text_col, make, T.StructType([T.StructField("wide", T.BinaryType()), long("fp")]), keep)


def differing(similarity: float) -> float:
    """The share of bits in which two sets of that Jaccard similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


#: Leading bits of a wide fingerprint that candidates are told by.
SKETCH = 128
#: Places in a zone that the Hamming code is on; zones of the first round.
CODE, EARLY = 15, 8


def meeting(p: float, extra: int) -> float:
    """The chance that two fingerprints that differ in a share p of their bits have one anchor in a zone with that many bits besides the code's.

    With one or two differing bits of the code's they share the anchor in one case of eight.
    """
    same = sum(math.comb(CODE, d) * p**d * (1 - p) ** (CODE - d) * (1 if d == 0 else 1 / 8) for d in range(3))
    return same * (1 - p) ** extra


def wide_zones(n: int, similarity: float = 0.8, recall: float = 0.985, seed: int = 11) -> np.ndarray:
    """Zones by places, those of the code first: as wide that about four of n unlike fingerprints meet, as many that ``recall`` is reached.

    Sets of a few shingles differ in a tenth more bits than ``differing`` says, which is allowed for.
    """
    extra = min(25, max(0, math.ceil(math.log2(max(n, 2))) - 2 - 11))
    number = math.ceil(math.log(1 - recall) / math.log(1 - meeting(1.1 * differing(similarity), extra)))
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(WIDE, CODE + extra, replace=False) for _ in range(number)])


def anchors(bits: np.ndarray) -> np.ndarray:
    """The number of each row's anchor: the code word within one flip of the leading 15 bits, then the other bits as they are."""
    place = np.arange(1, CODE + 1)
    wrong = np.bitwise_xor.reduce(np.where(bits[:, :CODE], place, 0), axis=1)  # the place of the bit that leads to the code word
    word = bits.astype(np.int64)
    flip = np.flatnonzero(wrong)
    word[flip, wrong[flip] - 1] ^= 1
    return word @ (1 << np.arange(bits.shape[1], dtype=np.int64))


def most_differing(similarity: float, bits: int = SKETCH, errors: float = 3.5) -> int:
    """The bits that fingerprints of that similarity may differ in: the mean (of small sets) and ``errors`` standard deviations."""
    p = 1.1 * differing(similarity)
    return int(bits * p + errors * math.sqrt(bits * p * (1 - p)))


def similar_candidates(rows: DataFrame, zones: np.ndarray, most: int) -> DataFrame:
    """(u, v): pairs of rows (``fp``, ``wide``, ``group``) of different groups that may be similar; each zone tells by bits of its own."""
    part, parts = SKETCH // 8, WIDE // SKETCH

    def deal(batches):
        for piece in slices(batches):
            fps, group, wide = piece.column("fp"), piece.column("group"), piece.column("wide").to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(wide), np.uint8).reshape(len(wide), -1), axis=1)
            sketches = [pa.array([w[part * i : part * (i + 1)] for w in wide], pa.binary()) for i in range(parts)]
            for number, zone in enumerate(zones):
                keys = (np.int64(number << 40) + anchors(bits[:, zone])) * 2
                yield pa.RecordBatch.from_arrays([pa.array(keys), fps, group, sketches[number % parts]], ["key", "fp", "group", "wide"])

    dealt = rows.select("fp", "group", "wide").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    met = dealt.mapInArrow(deal, "key long, fp long, group long, wide binary").repartition("key").sortWithinPartitions("key")
    return _meet(met, most).distinct()


def near_enough(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole wide fingerprints may be so similar: what the few bits of a zone let pass is told by all, before any set is read."""
    most = most_differing(similarity, WIDE)
    for end in ("u", "v"):
        pairs = pairs.join(distinct.select(F.col("fp").alias(end), F.col("wide").alias(f"wide_{end}")), end)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("wide_u", "wide_v"))
            yield b.select(["u", "v"]).filter(pa.array(apart(one, two) <= most))

    return pairs.select("u", "v", "wide_u", "wide_v").mapInArrow(run, "u long, v long")


def shingle_sets(source: DataFrame, key: str, body: str, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """(fp, shingles): the set of each wanted fingerprint (``fp``, ``least``: the smallest id with it), of one of its texts, read again."""

    def make():
        def run(texts):
            wide = [wide_fingerprint(t, words, seed) for t in texts]
            return {"fp": [int.from_bytes(xxhash.xxh64_digest(w), "big", signed=True) for w in wide], "shingles": [np.unique(shingles(t, words, seed)).view(np.int64) for t in texts]}

        return run

    rows = source.select(F.col(key).alias("__id"), body)
    here = rows.join(wanted.where("least is not null"), F.col("__id") == F.col("least"), "left_semi")
    if not wanted.where("least is null").isEmpty():
        here = here.unionByName(rows.where("__id is null"))
    read = text_map(here, body, make, T.StructType([long("fp"), T.StructField("shingles", T.ArrayType(T.LongType(), False))]), [])
    return cut_lineage(read.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets are so similar (Jaccard), exactly."""
    with_u = pairs.join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u")
    both = with_u.join(sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v")
    # sets are sorted without repeats; the larger bounds what can be common
    shared = F.size(F.array_intersect("a", "b"))
    fits = F.least(F.size("a"), F.size("b")) >= similarity * F.greatest(F.size("a"), F.size("b"))
    return both.where(fits & (shared >= similarity * (F.size("a") + F.size("b") - shared))).select("u", "v")


def similar_roots(source: DataFrame, key: str, body: str, distinct: DataFrame, similarity: float, words: int, seed: int) -> DataFrame:
    """(node, root): of each fingerprint that is linked, the smallest of its component; texts (rows of ``source``) that are so similar are linked."""
    zones, most = wide_zones(distinct.count(), similarity), most_differing(similarity)
    roots = None
    for part in (zones[:EARLY], zones[EARLY:]):
        rows = distinct.select("fp", "wide", F.col("fp").alias("group"))
        if roots is not None:
            rows = distinct.select("fp", "wide").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "wide", F.coalesce("root", "fp").alias("group"))
        pairs = cut_lineage(near_enough(similar_candidates(rows, part, most), distinct, similarity))
        ends = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
        sets = shingle_sets(source, key, body, cut_lineage(distinct.select("fp", "least").join(ends, "fp")), words, seed)
        links = verified(pairs, sets, similarity)
        if roots is not None:  # what is joined already stays so
            links = links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        roots = connected_components(links)
    return roots


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5, seed: int = 42) -> DataFrame:
    """The input's rows, one of each component of texts whose sets of shingles are that similar; links are verified exactly."""

    def prepare(rows, body, keep):
        return wide_fingerprints(rows, body, keep, words, seed)

    def group(prints, source, key, body):
        distinct = cut_lineage(prints.groupBy("fp").agg(F.min("__id").alias("least"), F.count("*").alias("n"), F.first("wide").alias("wide")))
        return _components(distinct.drop("wide"), similar_roots(source, key, body, distinct, similarity, words, seed))

    return _one_of_each(docs, id_col, text_col, prepare, group)


def _one_of_each(docs: DataFrame, id_col: str, text_col: str, prepare, group) -> DataFrame:
    names = docs.columns
    source = docs.select(*[docs[c].alias(f"in_{i}") for i, c in enumerate(names)])
    key, body = (f"in_{names.index(c)}" for c in (id_col, text_col))
    prints = cut_lineage(prepare(source.select(F.col(key).alias("__id"), body), body, ["__id"]))
    ids = cut_lineage(group(prints, source, key, body))
    rows = prints.groupBy("__id").agg(F.count("*").alias("__n"), F.min("fp").alias("fp"))
    unique = F.col("__id").isNotNull() & (F.col("__n") == 1)
    # a component keeps its smallest id, so the row that stays is found by id alone
    least = ids.select(F.col("component_id").alias("__id")).distinct()
    keep = rows.where(unique).join(least, "__id", "left_semi").select("__id")
    out = source.join(keep, F.col(key) == F.col("__id"), "left_semi")
    shared = cut_lineage(rows.where(~unique).select("__id"))
    if not shared.isEmpty():
        again = prepare(source.join(shared, F.col(key).eqNullSafe(F.col("__id")), "left_semi"), body, source.columns)
        rest = _with_component(again, ids).where(F.col("component_id").eqNullSafe(F.col(key)))
        out = out.unionByName(rest.dropDuplicates(["root"]).select(*source.columns))
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)])
