"""Tables in the folder that driver and executors share, for results that several later steps read; joins that pass nothing through the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is not set, local mode takes a temporary folder, a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagegrain-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Bytes of an Arrow batch between executors and Python workers; Spark's own default lets a worker hold many times that.
BATCH_BYTES = 5 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long arrays small, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: computed once, however often it is read, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/pagegrain/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_merge(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose sides are shuffled and sorted, never broadcast.

    Spark takes rows that are exploded, or come from Python or from well
    compressed files, for as small as what they were made from, and would
    send them all through the driver.
    """
    return left.join(right.hint("merge"), keys, how)


def by_hash(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """As ``by_merge``, for a left side of long arrays that need not be sorted: each task keeps its few short rows of ``right``."""
    return left.join(right.hint("shuffle_hash"), keys, how)
