"""User-defined functions, aggregates and table functions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .functions.common import free_name


def scalar(spark: SparkSession, name: str, f: Callable, returns: str, null_on_null: bool = True, deterministic: bool = True, vectorised: bool = False):
    """Registers a Python function for SQL and gives it as a column function.  With ``vectorised`` it gets Series, else
    values, in Arrow batches either way."""

    def batch(*series: pd.Series) -> pd.Series:
        if vectorised:
            return f(*series)
        return pd.Series([None if null_on_null and any(v is None or v is pd.NA for v in row) else f(*row) for row in zip(*(s.astype(object).where(s.notna(), None) for s in series))], dtype=object)

    from pyspark.sql.pandas.functions import PandasUDFType

    made = F.pandas_udf(batch, returns, PandasUDFType.SCALAR)
    made = made if deterministic else made.asNondeterministic()
    spark.udf.register(name, made)
    return made


def aggregate(spark: SparkSession, name: str, f: Callable[..., object], returns: str):
    """Registers an aggregate over a group's Series.  It isn't mergeable: a group meets in one task; see ``mergeable``
    for groups that can be large."""
    from pyspark.sql.pandas.functions import PandasUDFType

    made = F.pandas_udf(lambda *s: f(*s), returns, PandasUDFType.GROUPED_AGG)
    spark.udf.register(name, made)
    return made


def mergeable(df: DataFrame, keys: Sequence[str], value: str, add: Callable[[pd.Series], object], merge: Callable[[list], object], finish: Callable[[object], object], returns: str, name: str = "result") -> DataFrame:
    """A user-defined aggregate whose states merge: ``add`` makes a state of a batch's values of one group, ``merge`` one of
    several states, ``finish`` the result.  Each task sends one state for each group it has seen in a batch; these merge by
    task first, so a large group never meets as a whole."""
    part, state = free_name("part", df), free_name("state", df)
    shape = StructType([*(df.schema[k] for k in keys), StructField(state, BinaryType())])

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for key, own in frame.groupby(list(keys), dropna=False, sort=False)[value]:
                key = tuple(None if v != v else v for v in key)
                held[key] = merge([held[key], add(own)]) if key in held else add(own)
            if len(held) > 10_000:
                yield pd.DataFrame([[*k, pickle.dumps(s)] for k, s in held.items()], columns=shape.names)
                held = {}
        yield pd.DataFrame([[*k, pickle.dumps(s)] for k, s in held.items()], columns=shape.names)

    def merged(last: bool) -> Callable:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            whole = merge([pickle.loads(s) for s in frame[state]])
            return pd.DataFrame([[*frame.iloc[0][list(keys)], finish(whole) if last else pickle.dumps(whole)]], columns=[*keys, name if last else state])

        return run

    states = df.select(*keys, value).mapInPandas(begin, shape).withColumn(part, F.pmod(F.spark_partition_id(), F.lit(64)))
    some = states.groupBy(*keys, part).applyInPandas(lambda frame: merged(False)(frame), shape)
    out = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), f"`{name}` {returns}"])
    return some.groupBy(*keys).applyInPandas(lambda frame: merged(True)(frame), out)


def table(spark: SparkSession, name: str, f: Callable, returns: str):
    """Registers a generator of rows for use in FROM, also laterally."""
    made = F.udtf(type(name, (), {"eval": lambda self, *args: f(*args)}), returnType=returns)
    spark.udtf.register(name, made)
    return made


def sql_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A virtual function, which Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
