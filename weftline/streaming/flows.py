"""The operators over streams: directories that grow, event windows and index sync."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.manifest import BucketIndex


def subscribe(spark: SparkSession, folder: str, schema, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """New files of a folder as a stream; timestamps without a zone become UTC instants, as watermarks need."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    df = reader.format(kind).load(folder)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def window_counts(events: DataFrame, every: str, late: str, keys: list[str]) -> DataFrame:
    """start, keys, n, total by tumbling windows with a watermark."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("w.start").alias("start"), *keys, "n", "total")


def first_seen(events: DataFrame, keys: list[str], within: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def near_in_time(a: DataFrame, b: DataFrame, key: str, within: str) -> DataFrame:
    """Rows of b (key, ts) that come after a row of a with the same key, at most ``within`` later; both sides have watermarks."""
    x = a.withWatermark("ts", within).alias("x")
    y = b.withWatermark("ts", within).alias("y")
    on = F.expr(f"x.{key} = y.{key} AND y.ts >= x.ts AND y.ts <= x.ts + INTERVAL {within}")
    return x.join(y, on, "inner").select(F.col(f"x.{key}").alias(key), F.col("x.ts").alias("first_ts"), F.col("y.ts").alias("then_ts"))


def run_totals(events: DataFrame, late: str = "1 hour", idle_seconds: int = 7 * 86_400) -> DataFrame:
    """user_id, n, total after each trigger: a custom state of counts and sums per user, which goes when the watermark is so far past the user's last event."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        last = state.getCurrentWatermarkMs()
        for p in parts:
            n, total = n + len(p), total + float(p["value"].sum())
            last = max(last, int(p["ts"].max().timestamp() * 1000))
        state.update((n, total))
        state.setTimeoutTimestamp(last + idle_seconds * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", "EventTimeTimeout")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there now, batch by batch, and stop; a later call goes on from there."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sync_index(source: DataFrame, index: BucketIndex, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Keep an index (id, hash, text) in step with a stream of documents (doc_id, text[, order]).

    Of a document's versions in one batch the last by the column ``order``
    counts, by its text if no column is named.

    Each batch is the documents that came in: new ones and those whose content
    changed make a new version of the index, in which only their buckets are
    rewritten; a batch without changes makes none. A batch that runs again after
    a failure changes nothing.
    """

    def each(batch: DataFrame, no: int) -> None:
        new = batch.groupBy(F.col("doc_id").alias("id")).agg(F.max_by("text", F.struct(*([order] if order else []), F.md5("text"))).alias("text")).select("id", F.md5("text").alias("hash"), "text")
        index.merge(new.where("id is not null"), note={"batch": no})

    return run_available(source, each, checkpoint)
