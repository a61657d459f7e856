"""Atomic commits of folders: staged apart, marked, then moved by one rename to the next free version.

A root holds ``v/<20 digits>``, one folder for each committed version, and ``_staging/<token>``, what writers are at.
A folder is a version as soon as the rename has happened, and never before: a writer that dies at any step leaves the
versions as they were, and what it staged is swept later. Renames don't overwrite, so of two writers that chose the same
version one fails, looks at what the other has committed and tries again. Any file system that Spark reaches will do whose
rename of a folder is atomic (as on HDFS or local disks).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import SparkSession

MARK = "_MARK.json"


class Conflict(Exception):
    """Another writer has committed the version first."""


class Root:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def _names(self, path: str) -> list[str]:
        at = self._at(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n) for n in self._names(f"{self.path}/v") if n.isdigit()]

    def folder(self, version: int) -> str:
        return f"{self.path}/v/{version:020d}"

    def stage(self) -> str:
        """A new folder to write into."""
        return f"{self.path}/_staging/{uuid4().hex}"

    def mark(self, staged: str, told: dict) -> None:
        """What the version says of itself, written last of all that is staged."""
        out = self._fs.create(self._at(f"{staged}/{MARK}"), True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()

    def told(self, version: int) -> dict:
        at = self._at(f"{self.folder(version)}/{MARK}")
        return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(self._fs.open(at))).decode())

    def commit(self, staged: str, version: int) -> str:
        """Moves the staged folder to its version, or raises ``Conflict`` if it is taken."""
        if not self._fs.exists(self._at(f"{staged}/{MARK}")):
            raise ValueError(f"{staged} is not marked, so it may be half written")
        to = self._at(self.folder(version))
        self._fs.mkdirs(to.getParent())
        if self._fs.exists(to):
            raise Conflict(version)
        files = self._hadoop.FileContext.getFileContext(to.toUri(), self._conf)
        try:
            files.rename(self._at(staged), to, self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Exception as e:
            if "AlreadyExists" in str(e) or "not empty" in str(e):
                raise Conflict(version) from e
            raise
        return self.folder(version)

    def sweep(self) -> int:
        """Deletes what was staged and never committed; only when no writer is at work. Returns how many folders went."""
        left = self._names(f"{self.path}/_staging")
        for name in left:
            self._fs.delete(self._at(f"{self.path}/_staging/{name}"), True)
        return len(left)

    def write(self, make: Callable[[str, list[int]], dict], tries: int = 20) -> int:
        """Stages what ``make(folder, versions)`` writes for the next version and commits it, anew after each conflict."""
        for _ in range(tries):
            known = self.versions()
            staged = self.stage()
            self.mark(staged, make(staged, known))
            version = (known[-1] if known else -1) + 1
            try:
                self.commit(staged, version)
            except Conflict:
                self._fs.delete(self._at(staged), True)
                continue
            return version
        raise Conflict(f"{tries} tries")
