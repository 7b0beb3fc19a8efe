import hashlib
import io
import os
import re
import zlib
from collections import Counter

import numpy as np
from gleanery.llm import media, quality, queries

from tests.oracle import same_rows

TEXTS = ["", " ", "a b c d e a b c d e f", "x\nx\n\n \ny\nx", "# * $ % & | < > é 日本 x", "w " * 60, "one two\tthree\x0bfour\x0cfive\rsix", "q r s t u v q r s t u v w q r s t", "z" * 5000, None]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(cover), len(lines)]


def test_measure():
    rng = np.random.default_rng(1)
    texts = TEXTS + [" ".join(rng.choice(list("abc"), n)) for n in rng.integers(0, 80, 200)]
    got = quality.measure(texts)
    for i, t in enumerate(texts):
        assert [got[k][i] for k in quality.FEATURES] == brute(t), t


def rows(spark):
    good = " ".join(f"word{i}" for i in range(30))
    junk = " ".join(f"word{i}###" for i in range(30))
    dup = "\n".join(f"this line is said twice number {i // 2} with more words {'abcdefgh'[i // 2]}" for i in range(4))
    data = [(i, good + str(i), "good", 1) for i in range(50)] + [(100 + i, junk, "bad", 1) for i in range(40)] + [(150 + i, good, "bad", 1) for i in range(3)]
    data += [(200, None, None, 1), (200, None, None, 1), (201, good, None, None), (None, good, "good", None), (202, "", "good", None)]
    return data, spark.createDataFrame(data, "doc_id long, text string, source string, kept int").repartition(3)


def test_judge(spark):
    data, docs = rows(spark)
    got = quality.judge(docs).collect()
    assert len(got) == len(data)
    kept = Counter((r.doc_id, r.kept) for r in got)
    assert all(kept[i, True] for i in range(50)) and kept[None, True] and kept[201, True]
    assert not any(r.kept for r in got if r.doc_id and 100 <= r.doc_id < 201 or r.doc_id == 202)  # a rejected host takes its good pages along
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and out.count() == 52
    assert quality.judge(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


def test_planted_hosts_against_sql(spark, tmp_path):
    """The host decides both ways: fine texts go with a bad host, hard failures stay with a trusted one, soft ones count by host."""
    words = lambda i, n=40: [f"w{i}x{j}" for j in range(n)]
    fine = lambda i: " ".join(words(i))
    symbols = lambda i: " ".join(words(i, 20) + ["#"] * 4)
    soft = lambda i: "\n".join([" ".join(words(i, 12)), " ".join(words(-i, 3))] + [" ".join(words(i, 12)[:3])] * 2 + [" ".join(words(i + 9**6, 20))])
    few = lambda i: " ".join(words(i, 40) + ["#"] * 2)
    shares = {"bad": 0.9, "poor": 0.4, "middle": 0.15, "middling": 0.12, "trusted": 0.004}
    rows = []
    for host, share in shares.items():
        for i in range(500):
            n = len(rows)
            kind = symbols if i < 500 * share else few if i % 50 == 49 else soft if i % 50 == 48 else fine
            rows.append((n, kind(n), None, host, None))
    rows += [(9000, None, None, None, None), (9001, fine(9001), None, None, None), (9002, "", None, "trusted", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/out")
    (part,) = [f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".parquet")]
    os.makedirs(f"{tmp_path}/sf")
    os.rename(f"{tmp_path}/out/{part}", f"{tmp_path}/sf/documents.parquet")
    same_rows(spark, queries.QUERIES["op1_quality_rules"], queries.ORACLE_SQL["op1_quality_rules"], f"{tmp_path}/sf")
    kept = {r.doc_id: r.kept for r in queries.QUERIES["op1_quality_rules"](spark, f"{tmp_path}/sf").collect()}
    at = {h: 500 * i for i, h in enumerate(shares)}
    assert not any(kept[at["bad"] + i] for i in range(500))
    assert kept[at["poor"] + 300] and not kept[at["poor"] + 349] and not kept[at["poor"]]  # a few signs are enough there
    assert kept[at["middle"] + 349] and not kept[at["middle"]]
    assert kept[at["trusted"]] and kept[at["trusted"] + 1] and not kept[9002]  # symbols are forgiven, the base rule never is


def test_decode_forms():
    rng = np.random.default_rng(2)
    p = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_ppm(p)) == p).all() and (media.decode(media.encode_bmp(p)) == p).all()
    g = p[:, :, :1]
    assert (media.decode(b"P5 # c\n7 5\n255\n" + g.tobytes()) == g).all()
    assert (media.decode(b"P2\n7 5 255\n" + " ".join(map(str, g.reshape(-1))).encode()) == g).all()
    assert (media.decode(b"P3\n7 5 255\n" + " ".join(map(str, p.reshape(-1))).encode()) == p).all()
    bits = g[:, :, 0] > 127
    assert ((media.decode(b"P4\n7 5\n" + np.packbits(~bits, axis=1).tobytes())[:, :, 0] > 0) == bits).all()
    assert ((media.decode(b"P1\n7 5\n" + "".join("10"[b] for b in bits.reshape(-1).astype(int)).encode())[:, :, 0] > 0) == bits).all()


def test_area_resize():
    rng = np.random.default_rng(3)
    p = rng.integers(0, 256, (12, 18, 3), dtype=np.uint8)
    assert np.allclose(media.area_resize(media.integral_image(p), 4, 6), p.reshape(4, 3, 6, 3, 3).mean((1, 3)))
    assert np.allclose(media.area_resize(media.integral_image(p), 12, 18), p)
    big = p.repeat(5, 0).repeat(7, 1)  # fractional cells against a finer picture
    assert np.allclose(media.area_resize(media.integral_image(p), 5, 7), big.reshape(5, 12, 7, 18, 3).mean((1, 3)))


def cells(picture, height, width):
    """The mean of each cell by hand: every pixel by the area that it shares with the cell."""
    h, w, _ = picture.shape
    part = lambda n, m: np.array([[max(0.0, min((i + 1) * n / m, j + 1) - max(i * n / m, j)) for j in range(n)] for i in range(m)]) * m / n
    return np.einsum("ih,jw,hwb->ijb", part(h, height), part(w, width), picture.astype(float))


def test_text_media(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, feature string")
    for form, also in (("ppm", "bmp"), ("bmp", "ppm")):
        got = {r.doc_id: r for r in media.text_media(docs, form=form, also=also).collect()}
        for i, t in enumerate(TEXTS):
            raw = (t or "").encode()
            full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
            r = got[i]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
            assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and media.decode(bytes(r.media)).tobytes() == full
            picture = np.frombuffer(full, np.uint8).reshape(-1, 64, 3)
            assert r[f"{also}_sha256"] == hashlib.sha256(media.FORMS[also](picture)).hexdigest()
            grey = cells(picture, 8, 9).mean(2).round(6)
            assert int(r.feature, 16) == int("".join("01"[int(a < b)] for line in grey for a, b in zip(line, line[1:])), 2)
            small = np.load(io.BytesIO(r.tile_npy))
            assert small.shape == (32, 32, 3) and (abs(small - cells(picture, 32, 32)) < 0.51).all()
            assert r.tile_sha256 == hashlib.sha256(r.tile_npy).hexdigest() and abs(r.tile_mean - small.mean()) < 1e-9
    tiles = media.media_features(spark.createDataFrame([(1, b"junk"), (2, None), (3, media.encode_ppm(np.zeros((2, 2, 3), np.uint8)))], "id long, m binary"), "id", "m")
    got = {r.id: r for r in tiles.collect()}
    assert got[1].error and got[2].error is None and got[2].dhash is None and got[3].dhash == "0" * 16 and got[3].width == 2
    assert media.text_media(docs.limit(0)).count() == 0
