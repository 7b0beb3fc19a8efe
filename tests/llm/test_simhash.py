import random

import numpy as np
import pytest
import xxhash
from gleanery.llm import simhash
from gleanery.llm.components import connected_components


def brute_print(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_masks_reach_every_home():
    masks = simhash.hamming_masks()
    rng = random.Random(1)

    def syn(x):
        s = 0
        for i in range(1, 16):
            s ^= i if x >> (i - 1) & 1 else 0
        return s

    for _ in range(300):
        x = rng.getrandbits(24)
        assert all(syn(x ^ m) == 0 and m.bit_count() <= 2 for m in masks[syn(x)]) and masks[syn(x)][0].bit_count() <= 1
        assert len(set(masks[syn(x)])) == sum(syn(x ^ m) == 0 for m in {0} | {1 << i for i in range(24)} | {1 << i | 1 << j for i in range(24) for j in range(i)})
        for y in [x] + [x ^ 1 << i for i in range(24)]:
            home = y ^ masks[syn(y)][0]
            assert home in {x ^ m for m in masks[syn(x)]}


def test_links_and_components(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0}
    for f in list(fps)[:60]:
        for n in (1, 2, 3, 4, 5):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    dense = rng.getrandbits(64)
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}  # one crowded anchor
    fps = sorted(fps)
    want = brute_components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "__id long, fp long").repartition(3)
    found = simhash.links(df.select("fp")).collect()
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 4 for r in found)
    assert len(found) < 40 * len(fps)
    got = {r.fp: r.component_id for r in simhash.components(df).collect()}
    assert [got[f] for f in signed] == want


@pytest.mark.parametrize("number", range(len(simhash.LAYOUTS)))
def test_every_layout_finds_the_same(spark, number):
    rng = random.Random(12)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for n in (3, 4, 4, 4, 5):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "__id long, fp long").repartition(3)
    zones = simhash.LAYOUTS[number][1]
    assert simhash.proves(zones) and not simhash.proves(zones, 5) and sum(w for b, w in {b for z, _ in zones for b in z}) == 64
    got = {r.fp: r.component_id for r in simhash.components(df, zones=zones).collect()}
    assert [got[f] for f in signed] == brute_components(fps)


def similarity(a, b, words=5):
    x, y = ({tuple(t.lower().split()[i : i + words]) for i in range(max(1, len(t.split()) - words + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_wide_fingerprints_tell_similarity():
    rng = random.Random(14)
    for share in (0.0, 0.01, 0.03, 0.1):
        base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        other = [w if rng.random() >= share else "x" + w for w in base]
        a, b = " ".join(base), " ".join(other)
        apart = (int.from_bytes(simhash.wide_fingerprint(a)) ^ int.from_bytes(simhash.wide_fingerprint(b))).bit_count() / simhash.WIDE
        assert abs(apart - simhash.differing(similarity(a, b))) < 4 * (0.25 / simhash.WIDE) ** 0.5
    assert simhash.wide_fingerprint(None) == simhash.wide_fingerprint(" \n") == bytes(simhash.WIDE // 8)
    zones = simhash.wide_zones(10**6)
    assert 1 - (1 - simhash.meeting(simhash.differing(0.8), zones.shape[1] - simhash.CODE)) ** len(zones) >= 0.985


def test_anchors_cover():
    """Every word is within one flip of its anchor, an anchor is its own, and the chance to meet is that of a count over all words."""
    words = (np.arange(1 << 15)[:, None] >> np.arange(15) & 1).astype(np.uint8)
    at = simhash.anchors(words)
    assert len(set(at.tolist())) == 2048 and max(int(a ^ b).bit_count() for a, b in zip(at.tolist(), range(1 << 15))) == 1
    p, met = 0.15, 0.0
    for flips in range(1 << 15):
        if (n := flips.bit_count()) <= 3:
            met += p**n * (1 - p) ** (15 - n) * (at == at[np.arange(1 << 15) ^ flips]).mean()
    assert abs(met - simhash.meeting(p, 0)) < 1e-9


def test_candidates_join_all_that_is_alike():
    """At small and at crowded anchors: the pairs given join what all pairs within the bound would join, and no more than are needed."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (3, 2), dtype=np.int64).view(np.uint64)
    rows = np.repeat(base, 40, axis=0)
    for i in range(len(rows)):
        for at in rng.choice(128, rng.integers(0, 12), replace=False):
            rows[i, at // 64] ^= np.uint64(1 << (int(at) % 64))
    keys = np.zeros(len(rows), np.int64)
    near = [(i, j) for i in range(120) for j in range(i) if simhash.apart(rows[i], rows[j : j + 1])[0] <= 14]
    for groups in (np.arange(120), np.arange(120) // 3):
        want = simhash.Joined()
        for a, b in near + [(i, j) for i in range(120) for j in range(i) if groups[i] == groups[j]]:
            want.join(a, b)
        for crowd in (4, 1000):
            got = np.concatenate(list(simhash.proposed(keys, rows, groups, 14, crowd)))
            got = got[groups[got[:, 0]] != groups[got[:, 1]]]
            bits = simhash.apart(rows[got[:, 0]], rows[got[:, 1]])
            assert (bits <= 14).all()
            kept = simhash.closest(np.column_stack([got, bits, groups[got]]))
            assert len(kept) < len(set(groups.tolist()))
            have = simhash.Joined()
            for a, b in kept[:, :2].tolist() + [(i, j) for i in range(120) for j in range(i) if groups[i] == groups[j]]:
                have.join(a, b)
            assert all((have.root(i) == have.root(j)) == (want.root(i) == want.root(j)) for i in range(120) for j in range(i))


def test_drop_similar(spark):
    """Planted pairs: those of 0.8 and more lose one text, all others keep both."""
    rng = random.Random(15)
    rows, near, far = [], [], []
    for i in range(120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        n = rng.choice([0, 1, 3, 5, 6, 7, 8, 9, 20])
        other = list(base)
        for at in rng.sample(range(300), n):
            other[at] = "y" + other[at]
        rows += [(2 * i, " ".join(base), "x"), (2 * i + 1, " ".join(other), "x")]
        (near if similarity(rows[-2][1], rows[-1][1]) >= 0.8 else far).append(i)
    rows += [(1000, None, "x"), (1001, "", "x"), (None, rows[0][1], "x"), (0, rows[0][1], "x"), (0, "quite another text under a known id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, wide string").repartition(3)
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    left = set(ids)
    assert len(near) > 20 and len(far) > 20
    assert sum(2 * i + 1 in left for i in near) <= 0.05 * len(near) and all(2 * i in left for i in range(120))
    assert all(2 * i + 1 in left for i in far)
    assert 1000 in left and 1001 not in left and None not in left and ids.count(0) == 2
    assert simhash.drop_similar(docs.limit(0)).count() == 0


def test_drop_similar_against_all_pairs(spark):
    """Documents of a data directory: no group, by exact similarity of all pairs, without a kept text; and few with two."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: set(simhash.shingles(r.text, 5, 42).tolist()) for r in rows}
    holders, joined, true = {}, simhash.Joined(), []
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    for i, j in sorted(pairs):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            true.append((i, j))
            joined.join(i, j)
    empty = [i for i, s in sets.items() if not s]
    for a, b in zip(empty, empty[1:]):
        joined.join(a, b)
    kept = [r.doc_id for r in simhash.drop_similar(docs).collect()]
    groups = {joined.root(i) for i in sets}
    assert {joined.root(i) for i in kept} == groups
    assert len(kept) - len(groups) <= 0.05 * len(true)


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(90)] + [(None, 3), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(200))
    for a, b in edges:
        if a is not None and a != b:
            assert got[a] == got[b] <= min(a, b)


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["alpha", "Beta", "gamma", "Éta", "delta", "x", "yy"]) + str(rng.randrange(99)) for _ in range(120)) for _ in range(20)]
    texts = base + base[:5] + [b.upper() if b.isascii() else b for b in base[5:8]] + [b + " tail" for b in base[8:12]] + ["", None, " \n", "one", "one two three", "one two three four"]
    data = [(i + 10, t, None) for i, t in enumerate(texts)] + [(10, base[0], None), (None, base[1], None), (None, "only here without id", None), (12, "a quite different text under a known id", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, fp string").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [brute_print(t) for _, t, _ in data]
    roots = brute_components(prints)
    least = {}
    for (i, _, _), r in zip(data, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i is None, i or 0, f"{p:016x}", least.get(r)) for (i, _, _), p, r in zip(data, prints, roots)), key=str)
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1 for r in kept.collect())) == sorted(least.get(r, -1) for r in set(roots))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_long_text():
    t = " ".join(f"w{i % 977}" for i in range(40_000))
    assert simhash.fingerprint(t) & (1 << 64) - 1 == brute_print(t)


def test_forest_spans():
    fps = np.array([1, 3, 7, 1 << 40, (1 << 40) + 1, (1 << 20) - 1], np.uint64)
    joined = {tuple(sorted(map(int, x))) for a in simhash.forest(fps, 4) for x in fps[a]}
    assert len(joined) == 4 - 0 or len(joined) == len(fps) - len(set(brute_components([int(x) for x in fps])))
