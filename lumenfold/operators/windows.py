"""Window functions that Spark rejects or defines otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.common import col, free_name


def count_distinct_over(x, window: WindowSpec) -> Column:
    """COUNT(DISTINCT x) OVER (PARTITION BY ...)."""
    return F.size(F.collect_set(col(x)).over(window)).cast("bigint")


def range_counts(df: DataFrame, keys: Sequence[str], order: str, upto: str, from_here: str) -> DataFrame:
    """Adds COUNT(*) OVER (PARTITION BY keys ORDER BY order), and that with RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING.

    Spark counts a frame that ends with the partition anew for every row.  Here peers are counted first, only their counts
    are ordered, and each row looks its own up.
    """
    own, n = [free_name(f"k{k}", df) for k in range(len(keys) + 1)], free_name("n", df)
    peers = df.groupBy(*(F.col(c).alias(o) for c, o in zip([*keys, order], own))).agg(F.count(F.lit(1)).alias(n))
    p = Window.partitionBy(*own[:-1])
    before = F.sum(n).over(p.orderBy(own[-1]))
    counted = peers.select(*own, before.alias(upto), (F.sum(n).over(p) - before + F.col(n)).alias(from_here))
    return df.join(counted, [F.col(c).eqNullSafe(F.col(o)) for c, o in zip([*keys, order], own)]).drop(*own)


def filtered_over(agg, x, condition: Column, window: WindowSpec) -> Column:
    """agg(x) FILTER (WHERE condition) OVER (...)."""
    return agg(F.when(condition, col(x))).over(window)


def row_number(window: WindowSpec) -> Column:
    return F.row_number().over(window).cast("bigint")


def rank(window: WindowSpec) -> Column:
    return F.rank().over(window).cast("bigint")


def dense_rank(window: WindowSpec) -> Column:
    return F.dense_rank().over(window).cast("bigint")


def array_agg_over(x, window: WindowSpec) -> Column:
    """Keeps nulls."""
    return F.transform(F.collect_list(F.struct(col(x).alias("v"))).over(window), lambda r: r["v"])
