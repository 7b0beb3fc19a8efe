import math
import random
from collections import Counter

import numpy as np
import pytest
from gleanery.llm import cross_entropy, language, toxicity
from gleanery.session import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_codewords():
    for n in (1, 2, 3, 4, 7, 8, 20):
        code = language.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {1, -1}
        assert len({tuple(r) for r in code}) == n
        if n > 2:
            apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
            assert min(apart) >= (2 ** (n - 2) if n <= 7 else 8)


def test_grams_by_hand():
    keys = language.grams("Ab,  c1é", 15)
    assert len(keys) == 8 + 7 + 6  # " ab c é "
    assert language.grams("12 ,;", 15) is None and language.grams(" ", 15) is None


@pytest.mark.parametrize("n", [2, 4, 9])
def test_decoding_by_hand(n):
    """Margins, codeword losses, the nearest codeword and the ambiguity mark, each by loops over the model's numbers."""
    rng = np.random.default_rng(n)
    model = language.Model([f"l{i}" for i in range(n)], rng.integers(0, 50, (n, 1 << 10)).astype(float), 10)
    bits = model.code.shape[1]
    model.scale, model.trust = rng.uniform(0.1, 2, bits), rng.uniform(0.1, 3, bits)
    for text in ["the cat", "a", "Straße über " * 40, "x" * 20_000, "été à la mer, 123"]:
        keys = language.grams(text, 10)
        margins = [sum(float(model.weights[k, b]) for k in keys) / len(keys) for b in range(bits)]
        losses = [sum(t * math.log1p(math.exp(-c * 3 * m / s)) for c, m, s, t in zip(code, margins, model.scale, model.trust)) / model.trust.mean() for code in model.code]
        order = sorted(range(n), key=lambda i: losses[i])
        got = model.predict(text, 0.5)
        assert got[0] == f"l{order[0]}" and got[1] == pytest.approx(1 / sum(math.exp(losses[order[0]] - x) for x in losses), rel=1e-3)
        assert got[2] == (losses[order[1]] - losses[order[0]] < 0.5)


def test_languages_are_bounded(spark):
    rows = [(i, "the cat sat" if i % 3 else "der hund", "en" if i % 3 else "de") for i in range(60)] + [(100 + i, "zz", f"odd{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True), most_languages=2)
    assert model.languages == ["de", "en"] and model.predict("the cat", 0.5)[0] == "en"


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34 ..", "en", None, None), (None, "the and of", "en", None, None)], docs.schema)
    out = language.identify(docs.unionByName(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in out if r.held_out and r.lang]
    assert len(held) > 250 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (10**6, 10**6 + 1)} == {"und"}
    assert len(out) == docs.count() + 3


def test_language_small_cases(spark):
    one = spark.createDataFrame([(i, "the cat sat", "en", "x") for i in range(9)], "doc_id long, text string, lang string, score string")
    assert {(r.lang_pred, r.score) for r in language.identify(one).collect()} == {("en", 1.0)}
    none = one.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identify(none).collect()} == {("und", 0.0)}
    assert language.identify(one.limit(0)).count() == 0


def brute_restore(word, model):
    """The cheapest of all readings, one by one."""
    best = [(0.0, "^^", "")]
    for options in toxicity.readings(word):
        new = []
        for cost, past, text in best:
            for c, price in options:
                if c == toxicity.BREAK:
                    new.append((cost + price + model.cost(past[-2:], "$"), "^^", text + c))
                else:
                    new.append((cost + price + (model.cost(past[-2:], c) if c else 0), past + c, text + c))
        best = new
    return min((cost + model.cost(past[-2:], "$"), text) for cost, past, text in best)


@pytest.fixture(scope="module")
def letters():
    counts = Counter()
    for w in "stupid worthless people stop the idle petal loser close trash you are".split():
        for i in range(len(w) + 1):
            counts[("^^" + w + "$")[i : i + 3]] += 5
    return toxicity.Letters(counts)


def test_viterbi_is_exact(letters):
    for w in ["5tup1d", "st.u.p.i.d", "w0rthl3ss", "tr@sh", "l00ser", "stuuupid", "1d1e", "y o u", "t h e 1 d l e", "u a r e"]:
        cost, text = brute_restore(w, letters)
        got = toxicity.restore(w, letters)
        assert got == text or math.isclose(min(c for c, t in [brute_restore(w, letters)]), cost)
    assert toxicity.restore("5tup1d", letters) == "stupid" and toxicity.restore("s t u p i d", letters) == "stupid" and toxicity.restore("stuuupid", letters) == "stupid"


def test_words_of_any_length_are_read(letters):
    reader = toxicity.Reader(letters)
    assert toxicity.restore("y o u a r e s t u p i d", letters) == "you are stupid"
    many = " ".join("youarestupid" * 20)  # 240 letters set apart
    assert reader.plain(many)[-3:] == ["you", "are", "stupid"] and reader.plain(many).count("stupid") == 20
    assert "stupid" in reader.plain("st" + "u" * 300 + "pid") and "stupid" in reader.plain("s.t.u" + "." * 10 + "p.1.d")
    assert "stupid" in reader.plain("$tupid") and "idle" in reader.plain("!dle!!")
    long = "5tup1d" + "-" * 17 + "x9" * 200_000  # a long run of signs parts words
    assert "stupid" in reader.plain(long)


def test_score_is_the_regression_by_hand(letters):
    weights = {"stupid": (1.5, 0.25), "stup*": (0.5, 2.0), "idle": (-1.0, 0.0)}
    score = toxicity.Judge(letters.three, weights, -2.0).scorer()

    def by_hand(text, counts):
        n = len(set(text.lower().split()))
        total = -2.0 + sum(weights[f][0] + weights[f][1] * toxicity.RATE * k / (n + toxicity.RATE) for f, k in counts.items())
        return 1 / (1 + math.exp(-total))

    for text, counts in [("", {}), ("the people", {}), ("Stupid people", {"stupid": 1, "stup*": 1}), ("5tup1d idle stupor the", {"stupid": 1, "stup*": 2, "idle": 1}), ("stupid stupid", {"stupid": 1, "stup*": 1})]:
        assert score(text) == pytest.approx(by_hand(text, counts))


def test_regression_is_at_its_least():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(200):
        which = sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist())
        rows.append((int(rng.random() < 0.2 + 0.6 * (0 in which)), 30, which, [1 + f % 3 for f in which]))
    weights = {0: 0.7, 1: 1.6}
    found = toxicity.regress(rows, 6, weights)

    def loss(x):
        total = 0.05 * (x[1:] ** 2).sum()
        for label, size, which, n in rows:
            margin = x[0] + sum(x[1 + f] + x[7 + f] * toxicity.RATE * k / (size + toxicity.RATE) for f, k in zip(which, n))
            total += weights[label] * math.log1p(math.exp(-margin if label else margin))
        return total

    least = loss(found)
    for i in range(13):
        for d in (-0.05, 0.05):
            moved = found.copy()
            moved[i] += d
            assert loss(moved) >= least - 1e-9


def test_toxicity(spark):
    rng = random.Random(5)
    plain = ["river", "stone", "cloud", "garden", "letter", "window", "planet", "silver", "market", "summer", "stupendous", "idea"]
    bad = ["stupid", "vequart", "vequont", "vequilo", "vequand"]
    docs, labels = [], []
    for i in range(500):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(40)] = bad[0] if i % 8 else rng.choice(bad[1:])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs += [(1000, "river s t u p i d stone", "x"), (1001, "river 5tup1d.", "x"), (1002, "the STUUUPID stone", "x"), (1003, None, "x"), (1004, "stupendous ideal garden", "x"), (1005, "river vequzzz", "x"), (None, "stone", "x")]
    labels += [(3, 0), (None, 1), (5, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    lb = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(d, lb).collect()}
    truth = dict(labels[:500])
    assert all(out[i].predicted == truth[i] for i in range(500))
    assert [out[i].predicted for i in (1000, 1001, 1002, 1003, 1004, 1005, None)] == [1, 1, 1, 0, 0, 1, 0]
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = toxicity.drop_toxic(d, lb)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted == 0 for r in out.values())
    assert {r.score for r in toxicity.score_documents(d, lb.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(d.limit(0), lb).count() == 0


def test_cross_entropy(spark, monkeypatch):
    """Upper case, nulls and repeated rows, in several chunks and buckets, against counts by hand."""
    monkeypatch.setattr(cross_entropy, "CHUNK", 50)
    monkeypatch.setattr(cross_entropy, "BUCKET", 300)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["Alpha", "beta", "gamma", "delta", f"rare{i}"] if i % 3 else ["beta", "eta", "É"]) for _ in range(rng.randrange(0, 30))), "x") for i in range(60)]
    rows += [(61, None, "x"), (7, "beta beta", "x"), (None, "eta alpha", "x")]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    out = cross_entropy.cross_entropy_difference(docs, table).collect()
    shuffled = cross_entropy.cross_entropy_difference(docs, table, max_rows=3).collect()
    good = {i for i, q in labels if q == 1 and i is not None}
    split = [(i, (t or "").lower().split()) for i, t, _ in rows]
    models = []
    for target in (True, False):
        single, pair = Counter(), Counter()
        for i, ws in split:
            if (i in good) == target and ws:
                single.update(ws)
                single["<s>"] += 1
                pair.update(zip(["<s>", *ws], ws))
        models.append((single, pair, sum(n for w, n in single.items() if w != "<s>")))
    size, least = len({w for _, ws in split for w in ws}), min(m[2] for m in models)

    def loss(model, ws):
        single, pair, n = model
        r, total = least / n, 0
        for v, w in zip(["<s>", *ws], ws):
            plain = (single[w] * r + 0.5) / (least + 0.5 * size)
            total -= math.log((pair[v, w] * r + 4 * plain) / (single[v] * r + 4))
        return total / len(ws)

    want = sorted(((str(i), len(ws), *([loss(m, ws) for m in models] if ws else [None, None])) for i, ws in split), key=str)
    for found in (out, shuffled):
        got = sorted(((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in found), key=str)
        for a, b in zip(got, want, strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=2e-6)
    assert all(r.score == pytest.approx(r.target_loss - r.background_loss, abs=2e-6) for r in out if r.n_tokens)
    assert cross_entropy.cross_entropy_difference(docs.limit(0), table).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline(spark, sf):
    import corpus_pipeline
    from gleanery.llm import packing, quality, simhash

    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, table(spark, sf, "labels")).collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    left = {r.doc_id for r in first.collect()}
    assert first.columns == docs.columns and left == {i for i, p in scores.items() if not p}
    second = corpus_pipeline.STAGES[1][1](spark, docs.where(F.col("doc_id").isin(list(left))), sf)
    left = {r.doc_id for r in second.collect()}
    measured = {i: dict(zip(quality.FEATURES, (v[0] for v in quality.measure([rows[i].text]).values()))) for i in left}
    assert second.columns == docs.columns and all(m["n_words"] >= 10 and 100 * m["n_repeat_words"] <= 20 * m["n_words"] for m in measured.values())
    third = corpus_pipeline.STAGES[2][1](spark, docs.where(F.col("doc_id").isin(list(left))), sf)
    kept = {r.doc_id for r in third.collect()}
    sets = {i: frozenset(simhash.shingles(rows[i].text, 5, 42).tolist()) for i in left}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0
    assert third.columns == docs.columns and kept < left
    assert all(alike(a, b) < 0.8 for a in kept for b in kept if a < b)  # of any that are alike one stays
    assert all(max(alike(a, b) for b in left if b != a) >= 0.8 for a in left - kept)  # none goes without one like it
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == kept
    encoder = packing.TextEncoder(packing.public_tokenizers.path(packing.DEFAULT_TOKENIZER))
    assert sum(r.length for r in out) == sum(len(x) // 4 + 1 for x in encoder.library([rows[i].text for i in kept]))


def test_one_of_each():
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(30)]
    copies = [b.replace(b.split()[7], "changed", 1) for b in base[:10]] + base[10:20]
    shared = base[20] + " " + " ".join(f"n{i}" for i in range(900))  # one passage in a long text of its own
    rows = [(i, toxicity.sketch(t)) for i, t in enumerate(base + copies + [shared, "", "a", "a"])]
    assert toxicity.one_of_each(rows) == [*range(30), 50, 51, 52]


def test_toxicity_learns_from_every_labelled_row(spark):
    """More rows of each label than a sample used to take; Spark's regression is that of ``regress``."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(rng.sample(words, 12) + ["zorgle"] * (i % 3 == 0 and rng.random() < 0.9) + ["quibble"] * (rng.random() < 0.2 + 0.3 * (i % 3 == 0)))) for i in range(14_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lb = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    found = toxicity.learn(d, lb, F.lit(True))
    assert found.counted == found.sizes
    assert sum(found.counted.values()) == 14_000 and any(f.startswith("zorg") for f in found.chosen)
    held = toxicity.features(d.join(lb, "doc_id").select(F.col("toxic").alias("label"), "text"), found, "text", ["label"])
    judge = toxicity.weigh(held, found)
    want = toxicity.regress(sorted(tuple(r) for r in held.collect()), len(found.chosen), {0: 1.0, 1: 1.0})
    got = [judge.constant, *[judge.weights[f][0] for f in sorted(found.chosen)], *[judge.weights[f][1] for f in sorted(found.chosen)]]
    assert max(abs(a - b) for a, b in zip(got, want)) < 0.05


def test_plain_words_are_read_as_all_tokens_are(letters):
    """Words of letters alone are neither searched for disguises nor remembered; what is found is what each token says by itself."""
    rng = random.Random(9)
    signs = "stupidleéßпт²013@$!|(.-_*' ,;:?\"«»%#\n"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["Stupid, (stupid) stupid! s t u p i d _idle_ the", "stuuupid idleee пттт ааа", "a b c the", "", None]
    chosen = {f: i for i, f in enumerate(["idle", "idle*", "stup*", "stupid", "the"])}
    reader, every = toxicity.Reader(letters, chosen), toxicity.Reader(letters)
    for text in texts:
        tokens = (text or "").lower().split()
        tokens = {*tokens, *toxicity.spaced(tokens)}
        words = {t: {w for w in reader.plain(t) if len(w) > 2} for t in tokens}
        names = [{f for w in ws for f in (w, *[w[:k] + "*" for k in toxicity.PREFIXES if len(w) >= k]) if f in chosen} for ws in words.values()]
        assert reader.count(text) == (len(tokens), Counter(chosen[f] for ws in names for f in ws))
        assert every.all_words(text) == set().union(*words.values())
    plain = ["".join(rng.choice("abcdefgh") + rng.choice("ijklm") for _ in range(5)) for _ in range(3000)]
    reader = toxicity.Reader(letters, chosen)
    assert reader.count(" ".join(plain) + " idle, idle.")[1] == {0: 2, 1: 2} and set(reader.memory) == {"idle"}


def test_trigrams_are_counted_by_code():
    words = {"the,": 3, "éa": 2, "o": 1, "(Stop!)": 4, "zooom": 5, "x1": 6, "": 1, "文𝒳b": 7}
    want = Counter()
    for w, n in (("the", 3), ("éa", 2), ("o", 1), ("Stop", 4), ("文𝒳b", 7)):
        for i in range(len(w) + 1):
            want[f"^^{w}$"[i : i + 3]] += n
    codes, counts = toxicity.trigram_codes(words)
    assert {"".join(chr(c >> k & 0x1FFFFF) for k in (42, 21, 0)): n for c, n in zip(codes.tolist(), counts.tolist())} == want
