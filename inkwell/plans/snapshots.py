"""Several tables that change together: a commit writes new folders first and one manifest last.

A version is a JSON file that names the folders of each table. Readers take the newest one, so they see all tables before a commit or all after it,
and a job that dies on the way leaves only folders that no manifest names. Two writers cannot take the same version: the second one fails and
may try again on the new state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed since the version that a commit started from."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"tables": {name: {"paths", "schema"}}, "notes": {...}} of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "notes": {}}
        stream = self._fs.open(self._path(f"{self.root}/_versions/{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def names(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        found = self.manifest(version)["tables"][name]
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(*found["paths"])

    def commit(self, replace: Mapping[str, DataFrame] | None = None, append: Mapping[str, DataFrame] | None = None, since: int | None = None, notes: Mapping[str, object] | None = None) -> int:
        """Writes all given tables and makes them visible at once; returns the new version.

        since: the version that the given tables were made from; fails with Conflict if it is no longer the newest. notes: small values kept with the version.
        """
        since = self.version() if since is None else since
        old = self.manifest(since)
        tables = dict(old["tables"])
        for name, df in [*(replace or {}).items(), *(append or {}).items()]:
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            # Read again, as what is written may be null anywhere.
            kept = tables[name]["paths"] if name in (append or {}) and name in tables else []
            tables[name] = {"paths": [*kept, path], "schema": self.spark.read.parquet(path).schema.jsonValue()}
        self._publish(since + 1, {"tables": tables, "notes": {**old["notes"], **(notes or {})}})
        return since + 1

    def _publish(self, version: int, manifest: dict) -> None:
        """Puts the manifest in place by a rename that fails where the version exists."""
        jvm = self.spark._jvm
        draft, final = self._path(f"{self.root}/_versions/_{uuid.uuid4().hex}"), self._path(f"{self.root}/_versions/{version:020d}.json")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        # No option: the rename does not replace a file.
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(draft, final, options)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version} exists") from error
            raise

    def drop(self, path: str) -> None:
        """Deletes a folder that no version names."""
        self._fs.delete(self._path(path), True)

    def clean(self, keep: int = 1) -> None:
        """Deletes all but the newest versions and the folders that only those named."""
        gone, kept = self.versions()[:-keep], self.versions()[-keep:]
        used = {p for v in kept for t in self.manifest(v)["tables"].values() for p in t["paths"]}
        for path in {p for v in gone for t in self.manifest(v)["tables"].values() for p in t["paths"]} - used:
            self._fs.delete(self._path(path), True)
        for v in gone:
            self._fs.delete(self._path(f"{self.root}/_versions/{v:020d}.json"), False)
