"""The pipeline's stages hand texts to Python in batches bounded by bytes, whatever the number of rows."""

import corpus_pipeline
import pyarrow as pa
import pytest
from gleanery.session import BATCH_BYTES
from pyspark.sql import functions as F

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def session(spark):
    own = spark.newSession()
    own.conf.unset(KEY)
    return own


def rows_and_bytes(docs):
    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    return [tuple(r) for r in docs.select("text").mapInArrow(seen, "n long, size long").collect()]


def documents(session, n, times):
    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit(" quiet meadow"), times))
    return session.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("host").alias("source"), F.length(text).cast("long").alias("n_chars"))


@pytest.mark.parametrize("stage", [f for name, f in corpus_pipeline.STAGES if name != "toxicity"])
def test_batches_are_bounded_by_bytes(session, stage):
    stage(session, documents(session, 3, 3), "")
    docs = documents(session, 1500, 800)  # 10 kB each, 15 MB in one partition
    found = rows_and_bytes(docs)
    assert sum(n for n, _ in found) == 1500
    assert max(size for _, size in found) < 1.2 * BATCH_BYTES


def test_larger_texts_are_batches_of_their_own_and_whole(session):
    corpus_pipeline.keep_good_documents(session, documents(session, 3, 3), "")
    docs = documents(session, 4, 250_000)  # 3 MB each, over the bound
    found = rows_and_bytes(docs)
    assert sum(n for n, _ in found) == 4 and max(n for n, _ in found) == 1
    packed = corpus_pipeline.pack_sequences(session, docs, "")
    totals = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(totals) == 4 and all(r["n"] == r["all"] for r in totals)


def test_a_bound_of_the_session_stands(session):
    session.conf.set(KEY, "5m")
    corpus_pipeline.keep_good_documents(session, documents(session, 3, 3), "")
    assert session.conf.get(KEY) == "5m"
