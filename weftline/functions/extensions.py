"""User-defined table functions, aggregates and sources, for what built-in functions don't express."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


@F.udtf(returnType=StructType([StructField("sentence_no", IntegerType()), StructField("sentence", StringType())]))
class Sentences:
    """The sentences of a text, each with its final mark."""

    def eval(self, text: str):
        import re

        for i, m in enumerate(re.finditer(r"[^.!?]*[.!?]+|[^.!?]+$", text or "")):
            if m.group().strip(" "):
                yield i, m.group().strip(" ")


@F.pandas_udf(DoubleType())
def geometric_mean(values: pd.Series) -> float:
    """Of positive values; null if there is none. A group's values are in one task."""
    good = values[values > 0]
    return math.exp(sum(math.log(v) for v in good) / len(good)) if len(good) else float("nan")


class Calendar(DataSource):
    """Days as a source, ``spark.read.format("calendar").option("start", "2024-01-01").option("days", "30")``, in partitions of a month's length."""

    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "day date, weekday int"

    def reader(self, schema) -> DataSourceReader:
        return CalendarReader(self.options)


class CalendarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.start, self.days = options.get("start", "2024-01-01"), int(options.get("days", "31"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(0, self.days, 31)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime

        first = datetime.date.fromisoformat(self.start)
        for i in range(partition.value, min(partition.value + 31, self.days)):
            day = first + datetime.timedelta(days=i)
            yield day, day.isoweekday()
