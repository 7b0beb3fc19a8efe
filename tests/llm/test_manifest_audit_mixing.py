"""Manifest, filter audit and mixing against plain versions of their contracts."""

import hashlib
import random
import zlib
from itertools import permutations

import pytest
from gleanery.llm import filter_audit, manifest, mixing
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def others(levels, place):
    out, at = [], place
    for nodes in levels[:-1]:
        run = at // 3 * 3
        out.append((nodes[run:at], nodes[at + 1 : run + 3]))
        at //= 3
    return out


def levels_of(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def plain_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = mine, levels_of([leaf_of(r) for r in mine])
    top = levels_of([trees[s][1][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        mine, levels = trees[s]
        for i, r in enumerate(mine):
            steps = others(levels, i) + others(top, at)
            broken = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            now = leaf_of((*r[:4], r[4].replace("\n", ""))) if broken else leaf_of(r)
            for left, right in steps:
                now = h(*left, now, *right)
            out.append((r[0], leaf_of(r), levels[-1][0], top[-1][0], h(*[x for a, b in steps for x in a + b]), now, now == top[-1][0]))
    return sorted(out, key=str)


def documents(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 5 + ["é", "z", "", None, "zz", f"s{i % 40}"])
        ident = rng.choice([i, i, i, None, 7, -i, 2**62 + i, -(2**63)])
        rows.append((ident, source, rng.choice(["en", None]), rng.choice([i, None]), rng.choice([None, "", "a\nb", f"line {i % 9}\nmore", "no break"])))
    return rows + rows[: n // 5]


@pytest.mark.parametrize("most", [12, 4096])
def test_manifest(spark, most):
    rows = documents(300)
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), most=most).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 730])
def test_manifest_of_one_source(spark, n):
    rows = [(i * 1000, "only", "en", i, f"x\n{i}") for i in range(n)]
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)


def test_manifest_of_many_sources_and_three_stages(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 1)
    rows = [(i, f"source {i % 31}" if i % 2 else "hot", "en", i, f"x\n{i}") for i in range(200)]
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA), most=3).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)


def test_ranks_split_one_id(spark):
    """A third of all rows with one id: no bucket over the bound is ever sorted."""
    rows = spark.range(3000).select(F.lit(0).alias("g"), F.unhex(F.lpad(F.hex(F.when(F.col("id") < 1000, 5).otherwise(F.col("id")) * 4096 + F.col("id")), 16, "0")).alias("k"))
    got = manifest.radix_ranks(rows, "g", "k", most=50).collect()
    want = {k: i for i, k in enumerate(sorted(bytes(r.k) for r in got))}
    assert len(want) == 3000 and all(want[bytes(r.k)] == r["rank"] for r in got)


WORDS = ["mill", "River", "#tag", "old", "5%", "house", "NORTH"]


def texts(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([0, 3, 150, 199, 200, 201, 400])
        words = [rng.choice(WORDS) if rng.random() < 0.3 else f"w{rng.randrange(300 if i % 2 else 30)}" for _ in range(size)]
        rows.append((rng.choice([i, None, 4]), rng.choice(["en", "de", None, ""]), rng.choice([None, rows[0][2] if rows else "x", " ".join(words), "\t".join(words) + "\n"])))
    return rows


def plain_audit(rows, labels):
    least = {}
    for ident, _, text in rows:
        if ident is not None:
            least[text or ""] = min(ident, least.get(text or "", ident))
    docs = []
    for ident, part, text in rows:
        t = text or ""
        words = t.encode().split()
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": ident is not None and least[t] < ident,
        }
        mine = [lab for lab in labels if ident is not None and lab[0] == ident]
        docs.append((part or "", fails, any(q == 1 for _, q, _ in mine), any(t == 1 for *_, t in mine)))
    out = []
    for part in {d[0] for d in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in docs if d[0] == part)
                lines.append([part, order, step, len(left), len(hit), sum(d[1][f] for d in gone), alone, sum(d[2] for d in hit), sum(d[3] for d in hit), f])
                shapley[f] += len(hit)
                gone += hit
        out += [(*x[:9], shapley[x[9]]) for x in lines]
    return sorted(out)


def test_audit(spark):
    rows = texts(60)
    labels = [(i, int(i % 3 == 0), 1 if i % 7 == 0 else None) for i in range(60)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("mask", F.lit(1)).withColumn("part", F.lit("x")).withColumn("good", F.lit(2))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = filter_audit.audit_filters(docs, marks)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)
    none = filter_audit.audit_filters(docs.limit(0), marks.limit(0))
    assert none.columns == got.columns and none.count() == 0


def test_audit_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "FEW", 0)
    test_audit(spark)


def level(sizes, weights):
    """Targets by dealing, round by round, what full sources leave."""
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = sum(weights[s] for s in sizes if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weights[s] / free for s in sizes}
        more = {s for s in sizes if s not in full and target[s] > 3 * sizes[s]}
        if not more:
            return target
        full |= more


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i if i % 50 else None, rng.choice(["a"] * 9 + ["b", "é", None, "c"]), rng.choice([None, "", "one", " two\twords\n", "w " * rng.randrange(400)])) for i in range(600)]
    rows += [(9000, "tiny", "only four words here"), (9001, "empty", None), (9002, "giant", "x " * 9000), (9003, "giant", "y"), *rows[:40]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit(1)).withColumn("target", F.lit("x"))
    got = mixing.mix(docs.repartition(7)).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level(sizes, {s: [5, 2, 1][i % 3] for i, s in enumerate(order)})
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, _, t in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got) and sum(r.taken for r in got) == sum(sizes.values())
    by_target = {}
    for r in got:
        by_target.setdefault((r.source_size, r.target), []).append(r.taken)
    for s, n in sizes.items():
        near = [(k, sum(v)) for k, v in by_target.items() if k[0] == n and k[1] == pytest.approx(want[s])]
        assert near and abs(near[0][1] - want[s]) <= want[s] / mixing.PACKETS + 2
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_is_native(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a", "x y")], "doc_id long, source string, text string"))
    assert not {"Python", "Arrow", "MapInPandas"} & set(plan._jdf.queryExecution().toString().split())
