"""Derived projections: named tables that one owner writes and reads, each with versions of its own.

The first writer of a name becomes its owner, by a marker that is created once; whoever else writes or reads it is refused.
A projection can be rebuilt from journals at any time, so reading one that is not there gives None and no error.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .markers import Markers
from .versioned import VersionedTables


class ForeignOwner(PermissionError):
    """The projection belongs to somebody else."""


class Projections:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._owners = Markers(spark, f"{self.root}/_owners")

    def _tables(self, name: str) -> VersionedTables:
        return VersionedTables(self.spark, f"{self.root}/{name}")

    def _owned(self, name: str, owner: str) -> None:
        if not re.fullmatch(r"[a-z0-9][a-z0-9_.-]{0,63}", name):
            raise ValueError(f"no name for a projection: {name!r}")
        found = self._owners.get(name)
        if found is not None and found != owner:
            raise ForeignOwner(f"{name} belongs to {found}")

    def write(self, name: str, owner: str, table: DataFrame, expected: int | None = None) -> int:
        """Publish the next version; ``expected`` is the version that the writer has seen (0: none yet), another one is a conflict."""
        self._owned(name, owner)
        self._owners.put(name, owner)
        self._owned(name, owner)  # of two first writers one is the owner
        return self._tables(name).publish({"rows": table}, expected)

    def read(self, name: str, owner: str) -> DataFrame | None:
        self._owned(name, owner)
        if self._owners.get(name) is None or (tables := self._tables(name)).version() == 0:
            return None
        return tables.read("rows")
