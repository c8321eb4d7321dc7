"""Sources that need no store: rows in memory, and a loopback that makes rows of any schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def collection(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _value(kind: DataType, n: Column, increment: bool) -> Column:
    number = n if increment else F.lit(0)
    name = kind.typeName()
    if name == "string":
        return F.concat(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), number.cast("string")) if increment else F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if name == "boolean":
        return number % 2 == 1
    if name == "date":
        return F.date_add(F.lit("1970-01-01").cast("date"), number.cast("int"))
    if name.startswith("timestamp"):
        return F.timestamp_seconds(number).cast(kind)
    if name == "binary":
        return F.encode(number.cast("string"), "UTF-8")
    return number.cast(kind)


def loopback(spark: SparkSession, schema: str, rows: int = 1, increment: bool = False) -> DataFrame:
    """``rows`` rows of made-up values, alike or counting up."""
    fields = StructType.fromDDL(schema).fields
    return spark.range(rows).select(*(_value(f.dataType, F.col("id"), increment).alias(f.name) for f in fields))
