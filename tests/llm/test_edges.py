"""Nulls in any column, empty and long texts, repeated rows, empty tables and clashing names, for all operators and stages."""

import corpus_pipeline
import pytest
from gleanery.llm import chat, cross_entropy, filter_audit, language, manifest, media, mixing, packing, pieces, quality, simhash, token_counts, toxicity
from pyspark.sql import functions as F

CLASHES = [
    "__id", "__text", "__body", "__source", "__key", "__label", "__host", "__target", "__salt", "__task", "__n", "in_0", "in_1", "fp", "root", "key", "u", "v", "n",
    "component_id", "fingerprint", "score", "predicted", "held_out", "kept", "base_failed", "n_words", "sequence_id", "offset", "length", "start", "ids", "media",
    "feature", "lang_pred", "ambiguous", "n_tokens", "n_bytes", "over_limit", "toxic", "quality", "decoded",
]
LONG = " ".join(f"word{i % 977} tail{i}" for i in range(30_000))
PROSE = "the river ran past the old mill and nobody in the village could say who had built it first"
ROWS = [
    (1, PROSE, "en", "a.example"), (1, PROSE, "en", "a.example"), (2, PROSE, "en", None), (3, None, "en", "a.example"), (4, "", None, "b.example"),
    (5, LONG, "en", "b.example"), (None, PROSE, "en", "a.example"), (None, None, None, None), (6, " \t\n ", "de", "a.example"), (7, "é日本▁  x", "de", "c.example"),
    (8, PROSE.replace("river", "$tup1d"), "en", "c.example"), (9, PROSE.replace("river", "stupid"), "en", "c.example"),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return plain.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit(c).alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (9, 0, 1), (8, 0, 1), (3, None, None), (None, 1, 1), (2, 1, 0), (4, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("__key", F.lit(0)).withColumn("score", F.lit(0.5))


OPERATORS = {
    "quality": lambda d, _: quality.judge(d),
    "media": lambda d, _: media.text_media(d),
    "packing": lambda d, _: packing.pack(d),
    "simhash": lambda d, _: simhash.near_duplicates(d),
    "pieces": lambda d, _: pieces.encode_pieces(d),
    "language": lambda d, _: language.identify(d),
    "token_counts": lambda d, _: token_counts.count_tokens(d),
    "toxicity": lambda d, lab: toxicity.score_documents(d, lab),
    "cross_entropy": lambda d, lab: cross_entropy.cross_entropy_difference(d, lab),
    "manifest": lambda d, _: manifest.manifest(d),
    "mixing": lambda d, _: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(docs, labels, name):
    run = OPERATORS[name]
    got = run(docs, labels).collect()
    ids = sorted(str(r.doc_id) for r in got)
    want = sorted(str(i) for i, *_ in ROWS)
    assert sorted(set(ids)) == sorted(set(want)) if name == "packing" else ids == want
    empty = run(docs.limit(0), labels.limit(0))
    assert empty.columns == run(docs, labels).columns and empty.count() == 0


#: Texts that are not UTF-8, one of them labelled, so that it is learned from.
BROKEN = [(1, b"the r\xffver ran past stupid old mills and back to the town that had built it"), (2, b"\xc3"), (3, b"plain words that anyone could read in a book about rivers")]


@pytest.fixture(scope="module")
def broken(spark):
    rows = spark.createDataFrame([(i, bytearray(t), "en", "a.example") for i, t in BROKEN], "doc_id long, text binary, lang string, source string")
    rows = rows.withColumn("text", F.col("text").cast("string"))
    return rows.withColumn("n_chars", F.length("text")).repartition(2)


@pytest.mark.parametrize("name", OPERATORS)
def test_bytes_that_are_not_utf8(spark, broken, name):
    """They are read as U+FFFD, by what is fitted as by what is applied."""
    labels = spark.createDataFrame([(i, 1, i % 2) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    got = OPERATORS[name](broken, labels).collect()
    assert {r.doc_id for r in got} == {1, 2, 3}


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stage_with_bytes_that_are_not_utf8(spark, broken, tmp_path, number):
    spark.createDataFrame([(i, 1, i % 2) for i in (1, 2, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.STAGES[number][1](spark, broken, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, 2, 3}


def test_packing_of_all_rows(docs):
    got = packing.pack(docs).collect()
    assert sum(r.length for r in got if r.start == 0 and r.doc_tokens == 1) == 3  # null, null, empty
    assert sum(r.doc_tokens for r in got if r.start == 0) == sum(r.length for r in got)
    assert sum(r.start == 0 for r in got) == len(ROWS)


def test_components_of_odd_rows(docs):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {c for i, _, c in got if i in (1, 2)} == {1}
    assert {(f, c) for i, f, c in got if i in (3, 4, 6)} == {("0" * 16, 3)}


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, docs, labels, tmp_path, number):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = corpus_pipeline.STAGES[number][1]
    out = stage(spark, docs, str(tmp_path))
    if number < 3:
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} <= {i for i, *_ in ROWS}
        again = stage(spark, docs.limit(0), str(tmp_path))
        assert again.columns == docs.columns and again.count() == 0
    else:
        assert out.count() >= len(ROWS) and stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_over_files(spark, docs, labels, tmp_path):
    for rows, name in ((docs, "full"), (docs.limit(0), "none")):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert sum(r.start == 0 and r.doc_id == 1 for r in out) == 1 and not {2, 3, 4, 6} & {r.doc_id for r in out}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (1, None, "assistant", None, "x"), (None, 3, None, "[INST]", None), (2, 1, "assistant", "a" * 200_000, "y"), (3, 5, "system", "", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t string").withColumn("example", F.lit(1)).withColumn("i", F.lit(2))
    got = {r.conv_id: r for r in chat.read_back(chat.examples(turns)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 1, 3: 1}
    assert {k: r.loss_chars for k, r in got.items()} == {1: 0, None: 0, 2: 200_000, 3: 0}
    assert chat.read_back(chat.examples(turns.limit(0))).count() == 0
