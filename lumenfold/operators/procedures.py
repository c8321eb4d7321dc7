"""Procedures, SQL scripts and result caching."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog
from ..sqlcompat import rewrite


class Procedures:
    """Named procedures: Python functions of a session, or SQL scripts (BEGIN ... END) with :name parameters.  With a
    catalog, scripts and dynamic SQL see its names as the session's roles may, and no paths."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark, self.known, self.catalog = spark, {}, catalog
        self.variables: dict[str, object] = {}

    def create(self, name: str, body: Callable[..., DataFrame] | str) -> None:
        self.known[name.lower()] = body

    def call(self, name: str, **args) -> DataFrame | None:
        body = self.known[name.lower()]
        return body(self.spark, **args) if callable(body) else self.script(body, **args)

    def script(self, text: str, **args) -> DataFrame:
        """Runs a script; the result is its last query's.  Control flow is Spark's: IF, CASE, WHILE, REPEAT, LOOP, FOR,
        LEAVE, ITERATE, DECLARE, SET, handlers and SIGNAL."""
        if self.catalog is None:
            return self.spark.sql(text, args=args or None)
        with self.catalog.bound(text) as own:
            return self.spark.sql(own, args=args or None)

    def execute_immediate(self, text: str, args: dict | list | None = None, into: str | None = None) -> DataFrame:
        """Dynamic SQL; with ``into`` the rows become a temporary view of that name."""
        out = self.spark.sql(rewrite(text), args=args) if self.catalog is None else self.catalog.sql(text, args)
        if into:
            out.createOrReplaceTempView(into)
        return out

    def dependent(self, name: str, inputs: DataFrame, *parameters: str, bound: int = 1000) -> DataFrame:
        """Calls a procedure once for each distinct set of inputs, at most ``bound`` of them, and joins what it gives."""
        sets = inputs.select(*parameters).distinct().limit(bound + 1).collect()
        if len(sets) > bound:
            raise ValueError(f"more than {bound} input sets; use a lateral join with a table function")
        out = None
        from pyspark.sql import functions as F

        types = dict(inputs.dtypes)
        for row in sets:
            part = self.call(name, **row.asDict())
            part = part.select(*(F.lit(row[p]).cast(types[p]).alias(p) for p in parameters), *(c for c in part.columns if c not in parameters))
            out = part if out is None else out.unionByName(part)
        return inputs.join(out, list(parameters)) if out is not None else inputs.limit(0)


class ResultCache:
    """Results by query text, scope and, with a catalog, user and roles, whose policies they obey.  What is kept is a
    cached DataFrame, which Spark spills to disk as it must."""

    def __init__(self, spark: SparkSession, ttl: float = 3600, clock: Callable[[], float] = time.time, catalog: Catalog | None = None):
        self.spark, self.ttl, self.clock, self.kept, self.catalog = spark, ttl, clock, {}, catalog

    def sql(self, text: str, ttl: float | None = None, scope: str = "session") -> DataFrame:
        who = (self.catalog.user, *sorted(self.catalog.roles)) if self.catalog else ()
        key = scope, who, " ".join(text.split())
        df, until = self.kept.get(key, (None, 0))
        if df is None or self.clock() >= until:
            if df is not None:
                df.unpersist()
            df = (self.catalog.sql(text) if self.catalog else self.spark.sql(rewrite(text))).cache()
            self.kept[key] = df, self.clock() + (self.ttl if ttl is None else ttl)
        return df

    def clear(self) -> None:
        for df, _ in self.kept.values():
            df.unpersist()
        self.kept.clear()
