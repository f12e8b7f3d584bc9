"""Cutting lineage in a folder every executor can reach, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many bytes (as estimated from row count and width) may be broadcast.
BROADCAST_BYTES = 32 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable.

    The folder is the one named by ``spark.checkpoint.dir``. Only a local session
    (tests) that names none gets a temporary folder; on a cluster this is an error,
    since a machine-local folder would not survive a lost executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="terrace-checkpoint-")
    context.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table in the shared checkpoint folder: for the rounds of a loop.

    A checkpoint keeps the size that the optimiser guessed, for a join the product of both
    sides', so in a loop the guess's digits double in every round until planning takes
    longer than the work. A table has the size of its files; one in every few rounds is enough.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of the already computed ``df`` if its rows fit in ``limit`` bytes.

    Otherwise ``df`` comes back unchanged and a join on it shuffles. Call it on a
    checkpointed or otherwise cheap table: it counts the rows.
    """
    most = max(1, limit // max(1, row_bytes))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
