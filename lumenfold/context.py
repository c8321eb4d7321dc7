"""What a session knows of itself: user, roles, variables, settings, and statistics of tables."""

from __future__ import annotations

import os
import platform
import socket
from collections.abc import Callable, Iterable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog
from .operators.matview import MaterializedViews


def _literal(f: Callable) -> Callable[..., Column]:
    """As a column; with ``plain`` the value itself."""

    @wraps(f)
    def method(self, *args, plain: bool = False):
        value = f(self, *args)
        return value if plain else F.lit(value)

    return method


class SessionContext:
    """Values are fixed when a plan is made, as literals, so Catalyst folds them.  Environment variables are only read
    by the names in ``readable``."""

    def __init__(self, catalog: Catalog, views: MaterializedViews | None = None, payload: object = None, readable: Iterable[str] = ()):
        self.catalog, self.views, self.payload, self.readable = catalog, views, payload, set(readable)
        self.variables: dict[str, object] = {}
        catalog.context = self

    def value_of(self, name: str, args: list) -> object:
        """The functions of the session in SQL text; NotImplemented for others."""
        calls = {
            ("session_id", 0): self.session_id, ("node_id", 0): self.node_id, ("commandpayload", 0): self.command_payload, ("commandpayload", 1): self.command_payload, ("env_var", 1): self.env_var, ("env", 1): self.env_var,
            ("sys_prop", 1): self.sys_prop, ("session_get", 1): self.session_get, ("mvstatus", 1): self.mv_status, ("mvstatus", 2): self.mv_status,
        }
        if name == "session_set" and len(args) == 2:
            return self.session_set(*args)
        if (name, len(args)) not in calls:
            return self.catalog.value_of(name, args)
        return calls[name, len(args)](*(args[-1:] if name == "mvstatus" else args), plain=True)

    def user(self) -> Column:
        return F.lit(self.catalog.user)

    def has_role(self, role: str) -> Column:
        return F.lit(self.catalog.has_role(role))

    @_literal
    def session_id(self) -> object:
        return self.catalog.spark.sparkContext.applicationId

    @_literal
    def node_id(self) -> object:
        return socket.gethostname()

    @_literal
    def command_payload(self, key: str | None = None) -> object:
        """The payload as text, or one property of it."""
        value = self.payload.get(key) if key and isinstance(self.payload, dict) else None if key else self.payload
        return None if value is None else str(value)

    @_literal
    def env_var(self, name: str) -> object:
        if name not in self.readable:
            raise PermissionError(f"{name} isn't readable")
        return os.environ.get(name)

    @_literal
    def sys_prop(self, name: str) -> object:
        """A Spark setting, or one of os.name, os.version, user.timezone."""
        own = {"os.name": platform.system(), "os.version": platform.release(), "user.timezone": self.catalog.spark.conf.get("spark.sql.session.timeZone")}
        return own.get(name, self.catalog.spark.conf.get(name, None))

    def session_set(self, name: str, value: object) -> object:
        """Gives the value from before."""
        before = self.variables.get(name)
        self.variables[name] = value
        return before

    @_literal
    def session_get(self, name: str) -> object:
        return self.variables.get(name)

    @_literal
    def mv_status(self, name: str) -> object:
        """Whether the materialized view can be read as it is; an error if it can't."""
        if self.views is None or name not in self.views.status:
            raise KeyError(name)
        if self.views.stale(name):
            raise RuntimeError(f"the materialized view {name} isn't loaded or too old")
        return 1


def column_statistics(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, rows, distinct values, nulls, least, greatest) in one pass; distinct counts are estimates (2 percent)."""
    names = list(columns or df.columns)
    comparable = {c for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))}
    parts = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(names):
        parts += [F.approx_count_distinct(c, 0.02).alias(f"d{k}") if c in comparable else F.lit(None).cast("long").alias(f"d{k}"), F.count_if(F.col(c).isNull()).alias(f"z{k}")]
        parts += [(f(c).cast("string") if c in comparable else F.lit(None).cast("string")).alias(f"{n}{k}") for f, n in ((F.min, "lo"), (F.max, "hi"))]
    one = df.agg(*parts)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), F.col(f"d{k}").alias("distinct_values"), F.col(f"z{k}").alias("nulls"), F.col(f"lo{k}").alias("least"), F.col(f"hi{k}").alias("greatest")) for k, c in enumerate(names)))
    return one.select(F.inline(rows))
