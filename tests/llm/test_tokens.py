import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from gleanery.llm.packing import TextEncoder, class_sizes, cuts, merges_agree, pack, sequences
from gleanery.llm.pieces import Agenda, encode_pieces
from gleanery.llm.token_counts import ChunkedCounter, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "a\n \nb", "▁x ▁", "日本 𝒳", "<s> </s>", "a <|endoftext|> b<|endoftext|>", "\x00 a", "it's\t 12,345.67", "x" * 3000, "é" * 900 + " " + "b" * 900, " " * 700]


def random_texts(n=300, seed=5):
    rng = random.Random(seed)
    letters = "abc  \n\n..,,!▁éß日本𝒳0123<>/s the'  "
    return ["".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 10, 900]))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    texts = ODD + random_texts(60)
    return [(i, t) for i, t in enumerate(texts)] + [(500, None), (500, None), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # the extra column bears the name of a result
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string").repartition(3)


def test_agenda_equals_library():
    agenda = Agenda(MODEL)
    texts = ODD + random_texts()
    for t, (raw, settled) in zip(texts, agenda.encode_all(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == agenda.sp.encode(t) and not settled
    assert not agenda.settled


@pytest.mark.parametrize("chunk,overlap", [(50, 4), (200, 16)])
def test_chunks_equal_whole(chunk, overlap):
    counter = ChunkedCounter(MODEL, chunk, overlap)
    for t in ODD + random_texts():
        assert counter.count(t) == len(counter.sp.encode(t)), t[:50]


@pytest.mark.parametrize("text", ["a" * 8_000_000, "a" * 300_000 + " x " + "b" * 300_000 + ". " + "c" * 100_000, "ab " * 40_000 + "z" * 200_000])
def test_long_stretches_without_boundary(text):
    """Exact, and within a few times what the library takes for the whole."""
    counter = ChunkedCounter(MODEL)
    began = time.process_time()
    whole = len(counter.sp.encode(text))
    between = time.process_time()
    assert counter.count(text) == whole
    assert time.process_time() - between < 3 * (between - began) + 1


def test_texts_equal_library():
    encoder = TextEncoder(JSON)
    texts = ODD + random_texts() + ["one two three", "two <|endoftext|> five", "a\u00a0b\x85c", "x\x1cy", "\u0378 \U0001fae8 z", "don't  stop\n\n now ", "日本語の テキスト。한국어", "1234567 ½ ²"]
    assert encoder.core is not None and sum(map(encoder.is_plain, texts)) > 20
    assert encoder.encode(texts) == encoder.library(texts)
    core = encoder.core
    encoder.core = None
    assert encoder.encode(texts[:20]) == encoder.library(texts[:20])
    encoder.core = core


def test_plain_texts_equal_library_at_random():
    """Letters of the file's scripts in any order, so that words cut across all merges."""
    rng = random.Random(12)
    encoder = TextEncoder(JSON)
    signs = "etaoinshrdlu ETA  \n'.,-0123éàüßñçœ\tжи中国"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(300))) for _ in range(3000)]
    pieces = [p.replace("Ġ", " ") for p in list(encoder.tokenizer.get_vocab())[:20000]]
    texts += ["".join(rng.choice(pieces) for _ in range(12)) for _ in range(3000)]
    assert encoder.encode(texts) == encoder.library(texts)


def test_merges_that_do_not_agree():
    merges = [("a", "b"), ("b", "c"), ("a", "bc")]  # the signs of abc merge to ab first
    vocabulary = {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}
    assert not merges_agree(merges, vocabulary) and merges_agree([("a", "b"), ("b", "c"), ("ab", "c")], vocabulary)
    assert not merges_agree(merges[:2], vocabulary | {"ab": 6})


def test_count_tokens(docs, rows):
    sp = ChunkedCounter(MODEL).sp
    got = sorted(map(tuple, count_tokens(docs, limit=100, chunk_chars=300, overlap_chars=8).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t in rows]
    assert got == sorted(want, key=str)
    assert count_tokens(docs.limit(0)).count() == 0


def test_encode_pieces(docs, rows):
    sp = ChunkedCounter(MODEL).sp
    got = sorted((tuple(r) for r in encode_pieces(docs).drop("ids", "from_library").collect()), key=str)
    want = []
    for i, t in rows:
        ids = [sp.bos_id(), *sp.encode(t or ""), sp.eos_id()]
        text = sp.decode(ids)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text))
    assert got == sorted(want, key=str)
    assert encode_pieces(docs.limit(0)).count() == 0


def test_cuts():
    sizes = class_sizes(1024, 64)
    for n in range(1, 3000):
        parts = cuts(n, sizes)
        assert sum(parts) == n and len(parts) <= n // 1024 + 7
        assert all(p in sizes or p < 64 for p in parts)


def test_pack(spark, docs, rows):
    encoder = TextEncoder(JSON)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(encoder.library([t or ""])[0] + b"\0\0\0\0")
    for capacity, cut in ((64, 8), (1024, 64)):
        packed = pack(docs, capacity=capacity, min_cut=cut)
        got = packed.collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in got:
            assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
            by_doc[r.doc_id].append(r)
            by_seq[r.sequence_id].append(r)
        for i, raws in want.items():
            assert sorted((r.start, r.length, r.doc_tokens) for r in by_doc[i] if r.start == 0)[0][0] == 0
            if len(raws) == 1:
                parts = sorted(by_doc[i], key=lambda r: r.start)
                assert b"".join(r.ids for r in parts) == raws[0] and {r.doc_tokens for r in parts} == {len(raws[0]) // 4}
        total = sum(r.length for r in got)
        assert total * 4 == sum(len(x) for v in want.values() for x in v)
        for parts in by_seq.values():
            at = 0
            for r in sorted(parts, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= capacity
        assert len(by_seq) <= total / capacity * 1.1 + 2
        out = sequences(packed, capacity).collect()
        assert len(out) == len(by_seq)
        for r in out:
            ids = b"".join(p.ids for p in sorted(by_seq[r.sequence_id], key=lambda p: p.offset))
            assert r.ids[: len(ids)] == ids and not any(r.ids[len(ids) :])
            assert len(r.ids) in (4 * capacity, len(ids)) and (len(r.ids) == 4 * capacity or len(ids).bit_count() == 1)
    assert pack(docs.limit(0)).count() == 0
