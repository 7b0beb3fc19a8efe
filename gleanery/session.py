"""Session and storage helpers shared by the whole library."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library expects (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data directory; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (tests, local runs) a temporary folder is taken, one for the whole
    session; on a cluster that is an error, since executors would write to their own disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gleanery-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library wrote, in whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and drop its lineage.

    The folder is that of ``shared_folder``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch on its way to Python; a larger row is a batch of its own.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold ``BATCH_BYTES``, unless it has a bound of its own.

    Spark's 10,000 rows or 64 MB are whole texts beside each other: buffers that double as they fill, for each task once in
    the executor's direct memory and once more in the Python worker, and neither gives all of it back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def shuffles_removed(spark: SparkSession) -> None:
    """From now on the session removes the shuffle files of an execution when it ends, unless the session says otherwise.

    Else they lie on disk until the driver's JVM happens to collect what refers to them. What is cut by a checkpoint or written needs
    them no more; a DataFrame that is executed twice shuffles again, with the same rows.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "true")


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left", max_rows: int = 200_000) -> DataFrame:
    """Join with ``small`` broadcast if it is counted to hold at most ``max_rows`` rows, else by a shuffle."""
    few = small.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(small) if few else small, on, how)


def salted_join(big: DataFrame, small: DataFrame, on: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Inner or left join for a ``small`` side with one row a key where a key may hold much of ``big``.

    Where ``small`` was summed up by the same key, its exchange is shared with the join and adaptive
    execution cannot split a large key; with a salt both sides are dealt anew, the key over ``salts`` tasks.
    """
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [on, "__salt"], how).drop("__salt")
