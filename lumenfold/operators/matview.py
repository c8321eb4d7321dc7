"""Materialized views: Parquet snapshots with a status row, a time to live, and row refreshes.

A snapshot is a folder of its own; the status says which one holds.  A failed load leaves the old snapshot in place.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .dml import upsert


@dataclass
class Status:
    state: str = "NEEDS_LOADING"
    path: str | None = None
    updated: float = 0.0
    rows: int = 0
    loads: int = 0
    error: str | None = None


class MaterializedViews:
    def __init__(self, spark: SparkSession, base: str, clock: Callable[[], float] = time.time):
        self.spark, self.base, self.clock = spark, base.rstrip("/"), clock
        self.views: dict[str, tuple[Callable[[], DataFrame], float | None, Sequence[str]]] = {}
        self.status: dict[str, Status] = {}

    def create(self, name: str, query: Callable[[], DataFrame], ttl: float | None = None, key: Sequence[str] = ()) -> None:
        self.views[name], self.status[name] = (query, ttl, key), Status()

    def _write(self, name: str, df: DataFrame) -> None:
        status, path = self.status[name], f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        before = status.state
        status.state = "LOADING"
        try:
            df.write.parquet(path)
            rows = self.spark.read.parquet(path).count()
        except Exception as error:
            status.state, status.error = before if status.path else "FAILED_LOAD", str(error)
            raise
        self.status[name] = Status("LOADED", path, float(self.clock()), rows, status.loads + 1)

    def refresh(self, name: str, invalidate: bool = False) -> int:
        if invalidate:
            self.status[name].path = None
        self._write(name, self.views[name][0]())
        return self.status[name].rows

    def stale(self, name: str) -> bool:
        ttl, status = self.views[name][1], self.status[name]
        return status.path is None or ttl is not None and self.clock() - status.updated >= ttl

    def read(self, name: str, no_cache: bool = False) -> DataFrame:
        """The snapshot, loaded first if it is missing or too old; ``no_cache`` runs the query instead."""
        if no_cache:
            return self.views[name][0]()
        if self.stale(name):
            self.refresh(name)
        return self.spark.read.parquet(self.status[name].path)

    def refresh_rows(self, name: str, changed: DataFrame) -> int:
        """Replaces the rows that have the keys of ``changed`` by what the query gives for them now."""
        query, _, key = self.views[name]
        keys = changed.select(*key).distinct()
        old = self.read(name)
        kept = old.join(keys, list(key), "left_anti").select(old.columns)
        self._write(name, upsert(kept, query().join(keys, list(key), "left_semi").select(old.columns), key))
        return self.status[name].rows

    def report(self) -> DataFrame:
        rows = [(n, s.state, s.path, s.updated, s.rows, s.loads, s.error) for n, s in self.status.items()]
        return self.spark.createDataFrame(rows, "Name string, LoadState string, Path string, Updated double, Cardinality long, LoadNumber int, Error string")
