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


#: Spark's setting by which the shuffles of a query are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder.

    Nothing reads the shuffles of a checkpoint again, so they are removed with
    it and not some time later, when the driver collects its garbage.
    """
    conf = df.sparkSession.conf
    shared_folder(df.sparkSession)
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(CLEANUP, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that a table doesn't have."""
    low = {t.lower() for t in taken}
    while name in low:
        name = f"_{name}"
    return name


#: Most ids that are sent to every executor to select rows, at 16 bytes each.
BROADCAST_IDS = 500_000


def having(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of docs whose column is among the ids.

    Up to BROADCAST_IDS ids are broadcast, so no text is shuffled that isn't
    asked for; with more of them Spark joins by shuffling both sides.
    """
    ids = ids.select(column).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, column, "left_semi")
