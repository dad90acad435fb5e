"""Tables by version: a folder for each version and a pointer to the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def index_diff(new: DataFrame, old: DataFrame, key: str = "id", content: str = "hash") -> DataFrame:
    """(key, action): insert, update or delete; unchanged keys are absent."""
    n = new.select(key, F.col(content).alias("_new"), F.lit(True).alias("_in_new"))
    o = old.select(key, F.col(content).alias("_old"), F.lit(True).alias("_in_old"))
    both = n.join(o, key, "full_outer")
    action = F.when(F.col("_in_old").isNull(), "insert").when(F.col("_in_new").isNull(), "delete").when(~F.col("_new").eqNullSafe(F.col("_old")), "update")
    return both.select(key, action.alias("action")).where("action is not null")


def apply_diff(new: DataFrame, old: DataFrame, diff: DataFrame, key: str = "id") -> DataFrame:
    """The next version: unchanged rows of old, and the new rows that were inserted or updated."""
    changed = new.join(diff.where("action != 'delete'").select(key), key, "left_semi")
    return old.join(diff.select(key), key, "left_anti").unionByName(changed.select(*old.columns))


class VersionedTable:
    """Parquet versions under a folder; writes never touch an older version.

    A writer claims a version's number, and publishes by a pointer, by creating
    a numbered file, which only one writer can; so two writers never share a
    number, and the order of pointers is that of their numbers, not of clocks.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self, kind: str) -> list[int]:
        return [int(n) for n in files.names(self.spark, f"{self.folder}/{kind}")]

    def _next(self, kind: str, text: str) -> int:
        while True:
            no = max(self._numbers(kind), default=0) + 1
            if files.create_once(self.spark, f"{self.folder}/{kind}/{no:012d}", text):
                return no

    def exists(self) -> bool:
        return bool(self._numbers("pointers"))

    def current(self) -> int:
        """The version that the latest pointer names; 0 without one."""
        last = max(self._numbers("pointers"), default=0)
        return int(files.read_text(self.spark, f"{self.folder}/pointers/{last:012d}")) if last else 0

    def latest(self) -> int:
        return max(self._numbers("claims"), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v={version or self.current()}")

    def write(self, df: DataFrame) -> int:
        version = self._next("claims", "")
        df.write.mode("errorifexists").parquet(f"{self.folder}/v={version}")
        self.point(version)
        return version

    def point(self, version: int) -> None:
        """Make a version the current one: publish it, or roll back to it."""
        self._next("pointers", str(version))


def latest_per_key(registry: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key, for model and prompt registries."""
    names = [c for c in registry.columns if c != key]
    return registry.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in names))
