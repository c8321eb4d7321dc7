"""Set operations, limits and recursion."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import scratch


def limit_offset(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """OFFSET m ROWS FETCH NEXT n ROWS ONLY."""
    if (limit or 0) < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    out = df.offset(offset) if offset else df
    return out if limit is None else out.limit(limit)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Each task keeps k rows; only those meet."""
    return df.orderBy(*order).limit(k)


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, max_rounds: int | None = None, small: int = 10_000, unroll: int = 8) -> DataFrame:
    """WITH RECURSIVE seed UNION [ALL] step: semi-naive rounds until one adds no row, however many that takes unless
    ``max_rounds`` says how many may.

    ``step`` gets the rows that the round before added.  With ``distinct`` a row that is there already isn't added again.
    Rows are written into the shared folder (see ``storage``), and all that were are read as one table.  While a round has
    ``small`` rows or less, one job does ``unroll`` rounds: each round's rows carry its number, of equal ones the first
    counts, and only the last round's go on.
    """
    spark, names = seed.sparkSession, seed.columns
    plain = [f"c{k}" for k in range(len(names))]
    path, types = scratch(spark, "recursion"), [t for _, t in seed.dtypes]
    shape = ", ".join([*(f"{c} {t}" for c, t in zip(plain, types)), "round long"])

    def read(first: int, last: int) -> DataFrame:
        return spark.read.schema(shape).parquet(*(f"{path}/{k}" for k in range(first, last + 1)))

    def apply(rows: DataFrame) -> DataFrame:
        return step(rows.toDF(*names)).toDF(*plain).select(*(F.col(c).cast(t).alias(c) for c, t in zip(plain, types)))

    new, done, k = (seed.distinct() if distinct else seed).toDF(*plain).withColumn("round", F.lit(0).cast("long")), 0, 0
    while True:
        new.write.parquet(f"{path}/{k}")
        front = read(k, k).where(F.col("round") == done).select(*plain)
        n = front.count()
        if not n:
            return read(0, k).select(*plain).toDF(*names)
        if max_rounds is not None and done >= max_rounds:
            raise RuntimeError(f"recursion didn't end after {max_rounds} rounds")
        rounds, parts = unroll if n <= small else 1, []
        if max_rounds is not None:
            rounds = min(rounds, max_rounds - done)
        for j in range(1, rounds + 1):
            front = apply(front)
            parts.append(front.withColumn("round", F.lit(done + j).cast("long")))
        more = reduce(DataFrame.unionByName, parts)
        if distinct:
            more, total = more.groupBy(*plain).agg(F.min("round").alias("round")), read(0, k).select(*plain)
            more = more.join(total, reduce(and_, [more[c].eqNullSafe(total[c]) for c in plain]), "left_anti")
        new, done, k = more, done + rounds, k + 1
