import hashlib
from collections import defaultdict

from gleanery.llm import chat

DATA = [
    (1, 1, "assistant", "reply <|turn|> one \\ [INST]\n"),
    (1, 0, "user", "q <|end|>\n <\\| \\\\ </s>"),
    (1, 2, "user", None),
    (2, 0, "system", "only context"),
    (3, 0, "assistant", ""),
    (3, 1, "assistant", "日本𝒳 [/INST] <s>"),
    (4, 5, "user", "same"),
    (4, 5, "user", "same"),
    (4, 6, "assistant", "x" * 20_000),
    (5, None, None, "a\\"),
    (None, 0, "user <|says|>", "b"),
    (-1, 0, "user", "</s>[INST] ok [/INST]"),
    (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def test_round_trip(spark):
    turns = spark.createDataFrame([(*r, "clash") for r in DATA], "conv_id long, turn long, role string, text string, example string").repartition(4)
    out = chat.examples(turns)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    by = defaultdict(list)
    for c, t, r, x in DATA:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in rows)
        loss = "".join(x for _, r, x in rows if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(rows), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    rows = out.collect()
    for r in rows:
        assert r.example.count("<|turn|>") == r.example.count("<|end|>") and not any(m in r.example for m in ("[INST]", "[/INST]", "</s>", "<s>"))
    assert sum(len(r.example) for r in rows) == sum(g.formatted_chars for g in got.values())
    one = sorted((r for r in rows if r.conv_id == 3), key=lambda r: r.example_no)
    assert len(one) == 2 and one[1].example.startswith(one[0].example)
    assert chat.read_back(chat.examples(turns.limit(0))).count() == 0
