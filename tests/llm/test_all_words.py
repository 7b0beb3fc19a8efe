import math
import random
from collections import Counter

import pytest
from gleanery.llm import cross_entropy


@pytest.mark.parametrize("hot", [(1 << 17, 1 << 16), (16, 8)])
def test_all_words_and_bigrams(spark, monkeypatch, hot):
    """Brute force over more words than any fixed vocabulary held, all of one count but for a few; few or all of them frequent."""
    monkeypatch.setattr(cross_entropy, "HOT_WORDS", hot[0])
    monkeypatch.setattr(cross_entropy, "HOT_PAIRS", hot[1])
    rng = random.Random(9)
    once = [f"w{i}" for i in range(20_000)] * 2
    rng.shuffle(once)
    rows = [(i, " ".join(x for w in once[i * 100 : i * 100 + 100] for x in (["the", w] if i % 2 else [w, "of", "the"]))) for i in range(400)]
    rows += [(400, None), (401, " "), (7, rows[7][1]), (7, "the the"), (None, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = {i for i in range(400) if i % 5 == 0}
    labels = spark.createDataFrame([(i, 1) for i in good], "doc_id long, quality int")
    got = cross_entropy.cross_entropy_difference(docs, labels).collect()
    models = []
    for target in (True, False):
        single, pair = Counter(), Counter()
        for i, t in rows:
            ws = (t or "").split()
            if (i in good) == target and ws:
                single.update(["<s>", *ws])
                pair.update(zip(["<s>", *ws], ws))
        models.append((single, pair, sum(n for w, n in single.items() if w != "<s>")))
    kinds, least = len({w for s, _, _ in models for w in s} - {"<s>"}), min(m[2] for m in models)
    assert kinds > 20_000

    def loss(model, ws):
        single, pair, n = model
        r = least / n
        return sum(-math.log((pair[v, w] * r + 4 * (single[w] * r + 0.5) / (least + 0.5 * kinds)) / (single[v] * r + 4)) for v, w in zip(["<s>", *ws], ws)) / len(ws)

    want = sorted(((str(i), len(ws), *([loss(m, ws) for m in models] if ws else [None, None])) for i, t in rows for ws in [(t or "").split()]), key=str)
    have = sorted(((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in got), key=str)
    for a, b in zip(have, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-6)
