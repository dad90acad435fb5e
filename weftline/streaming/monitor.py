"""What streams report of themselves, as a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import files

PROGRESS = "run_id string, name string, batch long, at string, input_rows long, state_rows long, watermark string, batch_ms long, observed map<string,map<string,string>>"


class ProgressLog(StreamingQueryListener):
    """Writes a row for every batch of every stream of a session to a folder, and one when a stream ends with an error.

    The rows are small files of their own names, so several drivers may share a
    folder, and a batch that is reported twice is one row. What df.observe()
    counts in a stream is in ``observed``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _put(self, name: str, row: dict) -> None:
        files.create_once(self.spark, f"{self.folder}/{name}.json", json.dumps(row))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"run_id": str(p.runId), "name": p.name, "batch": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}
        row |= {"watermark": p.eventTime.get("watermark"), "batch_ms": p.durationMs.get("triggerExecution"), "observed": {k: {c: str(x) for c, x in v.asDict().items()} for k, v in p.observedMetrics.items()}}
        self._put(f"progress/{p.runId}-{p.batchId}-{p.timestamp.replace(':', '.')}", row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._put(f"failed/{event.runId}", {"run_id": str(event.runId), "error": event.exception})

    def read(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).json(f"{self.folder}/progress")

    def failures(self) -> DataFrame:
        if not files.exists(self.spark, f"{self.folder}/failed"):
            return self.spark.createDataFrame([], "run_id string, error string")
        return self.spark.read.schema("run_id string, error string").json(f"{self.folder}/failed")
