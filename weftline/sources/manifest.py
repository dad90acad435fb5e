"""An index in buckets: a version is a list of files, a change rewrites the buckets it touches."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import hash_share
from . import files
from .shared import among, if_few, keep
from .versions import index_diff


class Conflict(RuntimeError):
    """Other writers were first, each time."""


class BucketIndex:
    """Rows by a key, in ``buckets`` buckets by a hash of the key.

    A version is a manifest, ``manifests/<number>.json``: for each bucket its
    Parquet files and the version that wrote them. Files are never changed. A
    writer puts the buckets that it changes into new files, and publishes by
    creating the manifest of the next number, which only one writer can; who
    comes second starts again from the version that won. Readers name a version
    or take the last one, and see all of it or nothing. The number of buckets is
    fixed when the index is made: choose it for buckets of some 100 MB.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def versions(self) -> list[int]:
        return [int(n.partition(".")[0]) for n in files.names(self.spark, f"{self.folder}/manifests")]

    def current(self) -> int:
        """The last version; 0 without one."""
        return max(self.versions(), default=0)

    def exists(self) -> bool:
        return self.current() > 0

    def manifest(self, version: int | None = None) -> dict:
        version = self.current() if version is None else version
        return json.loads(files.read_text(self.spark, f"{self.folder}/manifests/{version:012d}.json"))

    def bucket(self):
        return (hash_share(F.col(self.key)) % self.buckets).cast("int")

    def _rows(self, manifest: dict, buckets=None) -> DataFrame:
        paths = [f"{self.folder}/{p}" for b, own in manifest["buckets"].items() if buckets is None or int(b) in buckets for p in own["files"]]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def lookup(self, keys: list, version: int | None = None) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([StructType.fromJson((m := self.manifest(version))["schema"])[self.key]]))
        own = {r[0] for r in asked.select(self.bucket()).distinct().collect()}
        return self._rows(m, own).join(F.broadcast(asked), self.key, "left_semi")

    def _publish(self, manifest: dict) -> bool:
        return files.create_once(self.spark, f"{self.folder}/manifests/{manifest['version']:012d}.json", json.dumps(manifest))

    def _write(self, rows: DataFrame, version: int) -> dict[str, dict]:
        """The buckets of rows in new files, one task for each bucket."""
        place = f"data/{version:012d}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{place}")
        out = {}
        for name in files.names_of_partitions(self.spark, f"{self.folder}/{place}"):
            own = [f"{place}/{name}/{f}" for f in files.names(self.spark, f"{self.folder}/{place}/{name}")]
            out[name.partition("=")[2]] = {"files": own, "since": version}
        return out

    def merge(self, changes: DataFrame, content: str = "hash", deleted: str | None = None, note: dict | None = None, attempts: int = 10) -> int:
        """The version with changes (key, content, other columns) in it; the current one if they change nothing.

        A row replaces that of its key, or goes in, unless the key's ``content``
        is the same already. ``deleted`` names a boolean column of changes: true
        takes the key out. Keys are unique in changes and not null. Only
        buckets that change are read and written again. ``changes`` is read twice,
        and has to give the same rows.
        """
        columns = [c for c in changes.columns if c != deleted]
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        # what is written again and again is keys and contents; the rows themselves are read once more, for those that change
        keys = keep(changes.select(self.key, content, gone.alias("_gone"), self.bucket().alias("_bucket")))
        first = changes.select(*columns).schema
        for _ in range(attempts):
            base = self.manifest() if self.exists() else {"version": 0, "buckets": {}, "schema": first.jsonValue()}
            near = {r[0] for r in keys.select("_bucket").distinct().collect()}  # a number for each bucket
            known = self._rows(base, near).select(self.key, F.col(content).alias("_content"), F.lit(True).alias("_known"))
            same = F.coalesce("_known", F.lit(False)) & F.col("_content").eqNullSafe(F.col(content))
            real = keys.join(known, self.key, "left").where(F.when(F.col("_gone"), F.col("_known").isNotNull()).otherwise(~same))
            real = keep(real.select(self.key, "_gone", "_bucket"))
            touched = {r[0] for r in real.select("_bucket").distinct().collect()}
            if not touched and base["version"]:
                return base["version"]
            rest = self._rows(base, touched).join(if_few(real.select(self.key)), self.key, "left_anti")
            new = among(changes.select(*rest.columns), real.where(~F.col("_gone")), self.key)
            version = base["version"] + 1
            written = self._write(rest.unionByName(new), version)
            kept = {b: own for b, own in base["buckets"].items() if int(b) not in touched}
            if self._publish({"version": version, "parent": base["version"], "at": time.time(), "note": note or {}, "schema": base["schema"], "buckets": kept | written}):
                return version
        raise Conflict(f"{attempts} other versions came first")

    def rollback(self, version: int) -> int:
        """A new version that holds what an earlier one held; nothing is rewritten."""
        while True:
            now = self.current()
            if self._publish(self.manifest(version) | {"version": now + 1, "parent": now, "at": time.time(), "note": {"rollback": version}}):
                return now + 1

    def diff(self, old: int, new: int, content: str = "hash") -> DataFrame:
        """(key, action) from one version to another; buckets with the same files are not read."""
        a, b = self.manifest(old), self.manifest(new)
        other = {int(k) for k in a["buckets"].keys() | b["buckets"].keys() if a["buckets"].get(k) != b["buckets"].get(k)}
        return index_diff(self._rows(b, other), self._rows(a, other), self.key, content)

    def table_of_buckets(self, version: int | None = None) -> DataFrame:
        """bucket, since (the version that wrote its files) and n_files of every bucket that holds rows."""
        rows = [(int(b), own["since"], len(own["files"])) for b, own in self.manifest(version)["buckets"].items()]
        return self.spark.createDataFrame(rows, "bucket int, since int, n_files int")

    def vacuum(self, keep_last: int = 10) -> int:
        """Delete the manifests of all versions but the last ones, then the data that no manifest names; the number of folders deleted.

        Data of a version that is not published yet is left alone.
        """
        versions = sorted(self.versions())
        for v in versions[:-keep_last]:
            files.delete(self.spark, f"{self.folder}/manifests/{v:012d}.json")
        used = {f.split("/")[1] for v in versions[-keep_last:] for own in self.manifest(v)["buckets"].values() for f in own["files"]}
        idle = [n for n in files.names(self.spark, f"{self.folder}/data") if n not in used and int(n.partition("-")[0]) <= max(versions, default=0)]
        for n in idle:
            files.delete(self.spark, f"{self.folder}/data/{n}")
        return len(idle)
