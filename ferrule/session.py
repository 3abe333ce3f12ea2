"""Session settings that the library expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "ferrule", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; shuffle partitions and memory are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Texts that one task scans, about: a page takes all rules and classifiers a few milliseconds.
TASK_TEXTS = 2_000


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over at least as many partitions as there are cores, and of about ``TASK_TEXTS`` rows at most.

    Scanning texts takes far more time than reading them; a file of one row group is one task, into however many splits
    it is cut, and a longer one would be a longer task.  Rows are counted, so hand it a table as it is read, whose files
    tell their number.  An input that has as many partitions is left as it is.
    """
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_TEXTS))
    return rows if rows.rdd.getNumPartitions() >= wanted else rows.repartition(wanted)


#: Rows that one task sorts, about.
TASK_ROWS = 250_000


def parts_for(*tables: DataFrame) -> int:
    """Partitions for a shuffle of the rows of some tables: about ``TASK_ROWS`` each, so that no task's memory grows with them.

    Rows are counted, so hand it tables as they are read, whose files tell their number.
    """
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-sum(t.count() for t in tables) // TASK_ROWS))


#: Bytes of the record batches that texts reach Python in.
BATCH = "2m"


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, with the session told to hand Python record batches of few bytes; without it a task holds 64 MB of texts or more at once."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="shared-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
