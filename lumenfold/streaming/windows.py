"""Event-time aggregation on streams.  An addition: the source model has only re-execution (see continuous)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant; a timestamp without zone is taken as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts] == "timestamp_ntz" else df


def _late(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    return df.withWatermark(ts, late) if df.isStreaming and late else df


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], late: str | None = None, slide: str | None = None, **aggs: Column) -> DataFrame:
    """(window_start, window_end, keys, aggregates), on a batch or a stream; ``slide`` makes windows overlap."""
    df = _late(_event_time(df, ts), ts, late)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.groupBy(window.alias("w"), *keys).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggs)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None, **aggs: Column) -> DataFrame:
    df = _late(_event_time(df, ts), ts, late)
    out = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggs)
