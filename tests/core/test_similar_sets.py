"""Similar sets with common tokens against all pairs; many of them in bounded time."""

import random
import time

import numpy as np
import pytest
from gleanery.operators import relational


def planted(rng, n, vocabulary, sizes):
    sets = []
    while len(sets) < n:
        size = rng.choice(sizes)
        base = rng.sample(range(vocabulary), size)
        sets.append(base)
        if rng.random() < 0.3:
            swapped = rng.randrange(0, size // 8 + 1)
            sets.append(base[swapped:] + rng.sample([x for x in range(vocabulary) if x not in set(base)], rng.randrange(0, swapped + 1)))
    return sets[:n]


@pytest.mark.parametrize("vocabulary, sizes", [(140, [100, 95, 110]), (400, [40, 60, 100]), (150, [20, 29, 30, 31, 34])])
def test_against_all_pairs(spark, vocabulary, sizes):
    sets = planted(random.Random(vocabulary), 400, vocabulary, sizes)
    table = np.zeros((len(sets), vocabulary), np.int64)
    for i, s in enumerate(sets):
        table[i, s] = 1
    common, size = table @ table.T, table.sum(1)
    want = {(i, j, int(common[i, j])) for i in range(len(sets)) for j in range(i + 1, len(sets)) if common[i, j] >= 0.9 * max(size[i], size[j]) and not (table[i] == table[j]).all()}
    first = {}
    for i, row in enumerate(table):
        first.setdefault(row.tobytes(), i)
    want = {(i, j, n) for i, j, n in want if first[table[i].tobytes()] == i and first[table[j].tobytes()] == j}
    df = spark.createDataFrame([(i, [f"t{x}" for x in s]) for i, s in enumerate(sets)], "k long, t array<string>")
    got = {tuple(r) for r in relational.similar_sets(df, "k", "t").collect()}
    assert got == want and len(want) > 20


def test_fifty_thousand_sets_of_common_tokens(spark):
    rng = np.random.default_rng(1)
    sets = [rng.choice(300, 100, replace=False).tolist() for _ in range(49_900)]
    sets += [sets[i][4:] + [300 + i % 3] for i in range(100)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "k long, t array<int>").repartition(16)
    began = time.time()
    got = {(r.a, r.b) for r in relational.similar_sets(df, "k", "t").collect()}
    assert time.time() - began < 150  # about a minute on eight idle cores
    assert got >= {(i, 49_900 + i) for i in range(100)} and len(got) < 200
