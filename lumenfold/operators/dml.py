"""Changes to tables as new versions: every statement gives a new DataFrame, old ones stay readable.

A version is a plan over the one before.  After ``cut_every`` changes the rows are written into the shared folder, so plans
stay short and a lost executor doesn't replay the history.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def _expr(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Missing columns are null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*(F.col(c).cast(t).alias(c) for c, t in table.dtypes))


def update(table: DataFrame, condition: Column | str, changes: Mapping[str, Column | str]) -> DataFrame:
    hit = F.coalesce(_expr(condition), F.lit(False))
    types = dict(table.dtypes)
    return table.select(*(F.when(hit, _expr(changes[c]).cast(types[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns))


def delete(table: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is unknown stay."""
    return table.where(~F.coalesce(_expr(condition), F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows take the place of those with their key."""
    return insert(table.join(rows.select(*keys), list(keys), "left_anti").select(table.columns), rows)


class VersionedTable:
    """A mutable name for versions of rows, with savepoints, keys and INSTEAD OF triggers."""

    def __init__(self, df: DataFrame, key: Sequence[str] = (), cut_every: int = 8):
        self.df, self.key, self.cut_every, self.changes = df, list(key), cut_every, 0
        self.saved: dict[str, DataFrame] = {}
        self.triggers: dict[str, Callable[[DataFrame], None]] = {}

    def _set(self, df: DataFrame) -> VersionedTable:
        self.changes += 1
        self.df = cut(df, "version") if self.changes % self.cut_every == 0 else df
        return self

    def insert(self, rows: DataFrame) -> VersionedTable:
        if "insert" in self.triggers:
            self.triggers["insert"](rows)
            return self
        if self.key and not rows.join(self.df.select(*self.key), self.key, "left_semi").isEmpty():
            raise ValueError(f"a row with the same {self.key} is there")
        return self._set(insert(self.df, rows))

    def upsert(self, rows: DataFrame) -> VersionedTable:
        return self._set(upsert(self.df, rows, self.key))

    def update(self, condition: Column | str, changes: Mapping[str, Column | str]) -> VersionedTable:
        if "update" in self.triggers:
            self.triggers["update"](update(self.df.where(_expr(condition)), F.lit(True), changes))
            return self
        return self._set(update(self.df, condition, changes))

    def delete(self, condition: Column | str) -> VersionedTable:
        if "delete" in self.triggers:
            self.triggers["delete"](self.df.where(_expr(condition)))
            return self
        return self._set(delete(self.df, condition))

    def batch(self, statements: Sequence[Callable[[VersionedTable], object]]) -> VersionedTable:
        """All statements or none."""
        before = self.df, self.changes, dict(self.saved)
        try:
            for s in statements:
                s(self)
        except Exception:
            self.df, self.changes, self.saved = before
            raise
        return self

    def instead_of(self, event: str, action: Callable[[DataFrame], None]) -> None:
        """The action gets the new rows (insert, update) or the old ones (delete)."""
        if event not in ("insert", "update", "delete"):
            raise ValueError(event)
        self.triggers[event] = action

    def savepoint(self, name: str) -> None:
        self.saved[name] = self.df

    def rollback(self, name: str) -> None:
        self.df = self.saved[name]
