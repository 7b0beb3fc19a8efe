"""Components whatever is joined in a task, broadcast or salted; and what they and the pipeline's stages leave on disk."""

import random
import time

import corpus_pipeline
import pytest
from gleanery.llm.components import connected_components
from gleanery.llm.simhash import Joined
from pyspark.sql import functions as F

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def edges():
    rng = random.Random(21)
    chain = list(range(300))
    rng.shuffle(chain)
    out = list(zip(chain, chain[1:])) + [(5000 - i, 5000) for i in range(1, 400)] + [(6000, 6000 + i) for i in range(400)]
    out += [(rng.randrange(-2000, -1000), rng.randrange(-2000, -1000)) for _ in range(600)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("few, piece", [(200_000, 100_000), (0, 100_000), (0, 7), (3, 50)])
def test_components_however_they_are_joined(spark, few, piece):
    rows, want = edges(), Joined()
    for a, b in rows:
        want.join(a, b)
    table = spark.createDataFrame(rows, "u long, v long").repartition(3)
    got = [tuple(r) for r in connected_components(table, few=few, piece=piece).select("node", "root").collect()]
    assert sorted(got) == sorted((x, want.root(x)) for x in {x for e in rows if e[0] != e[1] for x in e})


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0


def test_components_take_few_tasks(spark):
    """Pairs and stars are done in one round."""
    pairs = [(10 * i, 10 * i + 1) for i in range(200)] + [(10 * i + 1, 10 * i + 2) for i in range(0, 200, 3)]
    table = spark.createDataFrame(pairs, "u long, v long").repartition(4)
    context = spark.sparkContext
    context.setJobGroup("few tasks", "")
    try:
        assert connected_components(table).count() == len({x for p in pairs for x in p})
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(context.statusTracker().getJobIdsForGroup("few tasks")) <= 14


@pytest.fixture
def session(spark):
    own = spark.newSession()
    own.conf.unset(KEY)
    return own


def shuffled(session) -> set[str]:
    files = session.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for i in range(files.size()) if (x := files.apply(i).getName()).startswith("shuffle_") and x.endswith(".data")}


def test_near_duplicates_leave_no_shuffle_files(session):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(F.lit("w"), (F.col("id") % 60 * 1000 + i).cast("string"))))
    docs = session.range(0, 90, 1, 3).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("host").alias("source"), F.length(text).cast("long").alias("n_chars"))
    before = shuffled(session)
    kept = corpus_pipeline.drop_near_duplicate_documents(session, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    ends = time.time() + 10
    while (left := shuffled(session) - before) and time.time() < ends:
        time.sleep(0.2)
    assert not left
    assert kept.count() == 60  # executed again


def test_what_the_session_says_of_shuffle_files_stands(session):
    session.conf.set(KEY, "false")
    corpus_pipeline.keep_good_documents(session, session.createDataFrame([(1, "a b c", "en", "h", 5)], "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert session.conf.get(KEY) == "false"
