"""The target's files, through Spark's file systems.

A table's rows lie in ``<root>/<table>/task=<id>/<range>``; only the ranges that a task's newest manifest lists are the
table's. A manifest is a new file, ``<table>/_manifest/<task>/<number>.json``, written aside and renamed once; older ones stay,
so no crash leaves a table without one. A lock file, created only where none is, keeps a second run from the same root.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

LOCK = "_lock.json"
SHAPE = 2


class LockHeld(RuntimeError):
    """Another run holds the target."""


@dataclass
class Store:
    spark: SparkSession
    root: str
    holder: str | None = None

    def _path(self, relative: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, relative: str) -> bool:
        path, system = self._path(relative)
        return system.exists(path)

    def names(self, relative: str) -> list[str]:
        """What a folder holds, in order; nothing where it is missing."""
        path, system = self._path(relative)
        return sorted(x.getPath().getName() for x in system.listStatus(path)) if system.exists(path) else []

    def delete(self, relative: str) -> None:
        path, system = self._path(relative)
        system.delete(path, True)

    def read_json(self, relative: str) -> dict | None:
        path, system = self._path(relative)
        if not system.exists(path):
            return None
        stream = system.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, relative: str, value: dict, overwrite: bool) -> None:
        path, system = self._path(relative)
        stream = system.create(path, overwrite)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def write_new(self, relative: str, value: dict) -> None:
        """A file that appears whole or not at all; an error if it is there already."""
        folder, _, name = relative.rpartition("/")
        aside = f"{folder}/_{uuid.uuid4().hex}.new"
        self._write(aside, value, True)
        path, system = self._path(relative)
        draft, _ = self._path(aside)
        if system.exists(path) or not system.rename(draft, path):
            system.delete(draft, False)
            raise LockHeld(f"{name} of {folder} was written by another run")

    # Manifests

    def manifest(self, table: str, task: str) -> dict | None:
        """The newest manifest of a task."""
        numbers = [n for n in self.names(f"{table}/_manifest/{task}") if n.endswith(".json") and n[:-5].isdigit()]
        found = self.read_json(f"{table}/_manifest/{task}/{numbers[-1]}") if numbers else None
        if found is not None and found.get("shape") != SHAPE:
            raise RuntimeError(f"{table}: the manifest of {task} has a shape that this version does not know")
        return found

    def commit(self, table: str, task: str, state: dict) -> None:
        state["version"] = state.get("version", 0) + 1
        self.write_new(f"{table}/_manifest/{task}/{state['version']:010d}.json", state | {"shape": SHAPE})

    def paths(self, table: str) -> list[str]:
        """Of the committed ranges of all tasks."""
        states = [self.manifest(table, task) for task in self.names(f"{table}/_manifest")]
        return [f"{self.root}/{x['path']}" for s in states if s for x in s["ranges"] if x["rows"]]

    def read(self, table: str) -> DataFrame | None:
        paths = self.paths(table)
        return self.spark.read.parquet(*paths) if paths else None

    def truncate(self, *tables: str) -> None:
        """In the order given: children come before their parents."""
        for table in tables:
            self.delete(table)

    # The lock

    def acquire(self, holder: str) -> None:
        """Take the target for one run. Creating the file fails where it exists, which decides between two runs."""
        try:
            self._write(LOCK, {"holder": holder}, False)
        except Exception as taken:  # the gateway's own error class wraps the file system's
            if isinstance(taken, PySparkException) or not self.exists(LOCK):
                raise
            other = (self.read_json(LOCK) or {}).get("holder", "an unknown run")
            raise LockHeld(f"the target is in use by {other}") from None
        self.holder = holder

    def lock_lost(self) -> bool:
        """Whether a lock that this store took is no longer its own."""
        return self.holder is not None and (self.read_json(LOCK) or {}).get("holder") != self.holder

    def release(self) -> None:
        if self.holder is not None and not self.lock_lost():
            self.delete(LOCK)
        self.holder = None
