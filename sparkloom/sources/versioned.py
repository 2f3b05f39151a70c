"""Versioned tables in plain folders: many tables become visible together, by one pointer.

``publish`` writes the tables to a folder of its own, lets a guard look at it, and then creates the marker of the
next version, which names that folder (created, never replaced: of two writers one wins, and the loser's folder is
never read). Readers take the largest marker. A version number is never used twice, also after a rollback. Old
versions stay until ``expire`` drops them, so a reader keeps what it began with.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .markers import Markers


class Conflict(RuntimeError):
    """Another writer published first."""


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._current, self._back = Markers(spark, f"{self.root}/_current"), Markers(spark, f"{self.root}/_rolled_back")

    def versions(self) -> list[int]:
        """All that were published and not rolled back, oldest first."""
        gone = set(self._back.names())
        return sorted(int(n) for n in self._current.names() if n.isdigit() and n not in gone)

    def version(self) -> int:
        """The current version; 0 before the first."""
        return max(self.versions(), default=0)

    def folder(self, version: int) -> str:
        name = self._current.get(str(version))
        if name is None:
            raise KeyError(f"no version {version}")
        return f"{self.root}/{name}"

    def blocked(self) -> str | None:
        """Why readers are held off, if they are."""
        for reason in ("unavailable", "rebuild_required"):
            if self._fs.exists(self._path(f"{self.root}/_{reason}")):
                return reason
        return None

    def block(self, reason: str) -> None:
        self._fs.create(self._path(f"{self.root}/_{reason}"), True).close()

    def unblock(self) -> None:
        for reason in ("unavailable", "rebuild_required"):
            self._fs.delete(self._path(f"{self.root}/_{reason}"), False)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        if (reason := self.blocked()) is not None:
            raise RuntimeError(f"tables are {reason}")
        return self.spark.read.parquet(f"{self.folder(self.version() if version is None else version)}/{name}")

    def publish(self, tables: dict[str, DataFrame], expected: int | None = None, guard: Callable[[VersionedTables, str], None] | None = None) -> int:
        """Write all tables as the next version and show them together; ``guard`` gets the folder and may raise before that."""
        base = self.version()
        if expected is not None and expected != base:
            raise Conflict(f"expected version {expected}, found {base}")
        new = max([base, *(int(n) for n in self._current.names() if n.isdigit())]) + 1
        folder = f"v={new}-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/{folder}/{name}")
            if guard is not None:
                guard(self, f"{self.root}/{folder}")
            if not self._current.put(str(new), folder):
                raise Conflict(f"version {new} was published by another writer")
        except BaseException:
            self._current.remove(f"{self.root}/{folder}")
            raise
        return new

    def publish_with_restart(self, build: Callable[[int], dict[str, DataFrame]], restarts: int = 1, guard: Callable[[VersionedTables, str], None] | None = None) -> int:
        """Build the tables from the current version and publish them; on a conflict begin again from the new one."""
        for left in range(restarts, -1, -1):
            base = self.version()
            try:
                return self.publish(build(base), expected=base, guard=guard)
            except Conflict:
                if not left:
                    raise
        raise AssertionError("unreachable")

    def rollback(self) -> int:
        """Back to the version before; its tables must still be there."""
        if (v := self.version()) > 0:
            self._back.put(str(v))
        return self.version()

    def expire(self, keep: int = 2) -> None:
        kept = set(self.versions()[-keep:])
        for n in self._current.names():
            if n.isdigit() and int(n) not in kept and int(n) < max(kept, default=0):
                self._current.remove(self.folder(int(n)))
                self._current.drop(n)
