"""Where intermediate tables are kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary one.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weftline-")
    if current.isEmpty():
        context.setCheckpointDir(folder)
    return folder


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Most ids or terms that are broadcast to select rows; more are joined by shuffling.
BROADCAST_KEYS = 500_000


def among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose column is among the keys; few keys are broadcast, so that nothing else is shuffled."""
    return rows.join(if_few(keys.select(column).distinct()), column, "left_semi")


def if_few(keys: DataFrame) -> DataFrame:
    """keys, marked to be broadcast if they are few; a join with more shuffles both sides."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys
