"""Plan rewrites that Catalyst doesn't do by itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import free_name

def aggregate_before_join(facts: DataFrame, dimension: DataFrame, on: Sequence[str], keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """SELECT keys, sum(...), count(*) FROM facts JOIN dimension USING (on) GROUP BY keys, for keys of the dimension:
    facts shrink to one row for each join key before they meet the dimension, and the partial sums are summed again.
    Counts multiply with matches, which the join does; so do sums."""
    partial = facts.groupBy(*on).agg(*(F.sum(c).alias(n) for n, c in sums.items()), F.count(F.lit(1)).alias("n"))
    joined = partial.join(dimension.select(*dict.fromkeys([*on, *keys])), list(on))
    return joined.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in sums), F.sum("n").alias("n"))


def count_before_join(left: DataFrame, right: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """SELECT on, count(*) FROM left JOIN right USING (on) GROUP BY on: each side shrinks to one row for each key, so matches
    are multiplied rather than made."""
    a, b = free_name("a", left, right), free_name("b", left, right)
    counts = [df.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, a), (right, b))]
    return counts[0].join(counts[1], list(on)).select(*on, (F.col(a) * F.col(b)).alias(name))


def prune_branches(branches: Sequence[tuple[dict, DataFrame]], wanted: dict) -> DataFrame:
    """The union of those branches whose known constants don't contradict ``wanted``."""
    live = [df for known, df in branches if all(known.get(k, v) == v for k, v in wanted.items())]
    if not live:
        return branches[0][1].where(F.lit(False))
    out = live[0]
    for df in live[1:]:
        out = out.unionByName(df)
    for k, v in wanted.items():
        out = out.where(F.col(k) == F.lit(v)) if k in out.columns else out
    return out


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
