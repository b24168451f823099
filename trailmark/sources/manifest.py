"""Several Parquet tables in one folder that change together.

A commit writes new folders of files, and then one small file, the manifest, which names the folders that every table
is made of from then on. Readers resolve the newest manifest, so they see all tables of a commit or none; what a commit
that failed has written is named nowhere. Two commits at once can't both take the same number: one of them is an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Manifest:
    """tables: name -> [[folder, batch or None], ...] in order of writing; marks: name -> value."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, path = self._fs(), self._path("_manifests")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; before the first commit an empty one."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "tables": {}, "marks": {}}
        stream = self._fs().open(self._path("_manifests", f"{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, df: DataFrame, name: str) -> str:
        """Writes a table's files to a folder of their own, which no manifest names yet."""
        part = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{part}")
        return part

    def publish(self, before: dict, tables: dict, marks: dict) -> int:
        """Makes ``tables`` and ``marks`` the state after ``before``; an error where another commit came first."""
        version = before["version"] + 1
        text = json.dumps({"version": version, "tables": tables, "marks": marks})
        new, final = self._path("_manifests", f"_{uuid.uuid4().hex}"), self._path("_manifests", f"{version:012d}.json")
        out = self._fs().create(new, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self._conf).rename(new, final, none)
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Removes the folders that none of the last ``keep`` manifests names, and older manifests; says how many.

        Not while a commit or a reader of an older version is running.
        """
        versions, fs, gone = self.versions(), self._fs(), 0
        held = [self.read(v) for v in versions[-keep:]]
        named = {part for m in held for parts in m["tables"].values() for part, _ in parts}
        names = {name for v in versions for name in self.read(v)["tables"]}
        for name in names:
            path = self._path(name)
            if fs.exists(path):
                for s in fs.listStatus(path):
                    if f"{name}/{s.getPath().getName()}" not in named:
                        gone += fs.delete(s.getPath(), True)
        for v in versions[:-keep]:
            fs.delete(self._path("_manifests", f"{v:012d}.json"), False)
        return gone

    def frames(self, parts: list) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.folder}/{part}") for part, _ in parts]
