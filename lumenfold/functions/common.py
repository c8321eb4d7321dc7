from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str | int | float | bool | None) -> Column:
    """Strings name columns; other plain values are literals."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def text(x: Column | str) -> Column:
    """Strings are literals."""
    return x if isinstance(x, Column) else F.lit(x)


def require(condition: Column, value: Column, message: str) -> Column:
    """``value``, or an error where the condition doesn't hold; null stays null."""
    return F.when(condition.isNull() | condition, value).otherwise(F.raise_error(F.lit(message)))


def free_name(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    while any(name in df.columns for df in frames):
        name += "_"
    return name
