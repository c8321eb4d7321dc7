"""Join helpers beyond df.join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import free_name


def bind(dependent: DataFrame, key: str, independent: DataFrame, independent_key: str, max_keys: int = 10_000) -> DataFrame:
    """The dependent rows whose key is among the independent side's.

    With at most ``max_keys`` distinct keys they become an IN predicate, which the source evaluates (Parquet row groups,
    a JDBC WHERE).  With more, the dependent side is reduced by a left-semi join on the distinct keys instead, whose
    runtime filter Catalyst may derive; no key list grows in the driver.
    """
    own = free_name("key", dependent)
    sets = independent.select(F.col(independent_key).alias(own)).where(F.col(own).isNotNull()).distinct()
    keys = [r[0] for r in sets.limit(max_keys + 1).collect()]
    if len(keys) <= max_keys:
        return dependent.where(F.col(key).isin(keys)) if keys else dependent.where(F.lit(False))
    return dependent.join(sets, F.col(key) == F.col(own), "left_semi")


def dependent_join(independent: DataFrame, dependent: DataFrame, key: str, how: str = "inner", max_keys: int = 10_000) -> DataFrame:
    """Joins after sending the independent side's keys to the other source (see ``bind``)."""
    return independent.join(bind(dependent, key, independent, key, max_keys), key, how)


def union_partition_join(left: Sequence[tuple[object, DataFrame]], right: Sequence[tuple[object, DataFrame]], on: Sequence[str], how: str = "inner") -> DataFrame:
    """(a1 + a2) join (b1 + b2) where each branch is known to hold one value of the join key's partition column: only
    branches of one value meet, so each join is smaller and is planned on its own.  As one value would go to one task, right
    branches of few rows are broadcast, and larger ones are repeated for the salts of the left side."""
    other = {}
    for value, df in right:
        other[value] = other[value].unionByName(df) if value in other else df
    parts = []
    for value, df in left:
        if value in other:
            parts.append(_one_value_join(df, other[value], on, how))
        elif how in ("left", "left_outer", "left_anti"):
            empty = right[0][1].where(F.lit(False))
            parts.append(df.join(empty, list(on), how))
    if not parts:
        return left[0][1].where(F.lit(False)).join(right[0][1].where(F.lit(False)), list(on), how)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _one_value_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, most_rows: int = 100_000) -> DataFrame:
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        return left.join(right, list(on), how)
    if right.limit(most_rows + 1).count() <= most_rows:
        return left.join(F.broadcast(right), list(on), how)
    return salted_join(left, right, on, how=how)


def lateral_topk(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """For each left row the first k of its right rows: LATERAL (SELECT ... ORDER BY ... LIMIT k) without a nested loop.
    The ranks are cut before the join, and Spark limits each group before it shuffles."""
    rank = free_name("rank", right)
    ranked = right.withColumn(rank, F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where(F.col(rank) <= k).drop(rank)
    return left.join(ranked, list(on))


def optional_join(left: DataFrame, right: DataFrame, on: Sequence[str], used: Sequence[str], how: str = "left") -> DataFrame:
    """A join that may be left out: if no used column comes from the right side, the left side stands alone."""
    extra = [c for c in right.columns if c not in on]
    if not set(used) & set(extra):
        return left.select(*used)
    return left.join(right, list(on), how).select(*used)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], parts: int = 16, how: str = "inner") -> DataFrame:
    """Inner, left, semi or anti join for keys that hold much of the left side: its rows are dealt over ``parts`` salts, the
    right side is repeated for each.  AQE splits skewed partitions of plain joins by itself; this is for plans where it can't."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    name = free_name("salt", left, right)
    dealt = left.withColumn(name, F.pmod(F.xxhash64(*[c for c in left.columns]), F.lit(parts)).cast("int"))
    return dealt.join(right.withColumn(name, salt), [*on, name], how).drop(name)
