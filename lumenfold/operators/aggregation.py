"""Aggregates with the semantics of the source model.  All are plain Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import col


def _sorted(x: Column, order_by: Sequence[Column]) -> Column:
    """The values of x, nulls included, in the order of the columns (ascending, nulls first)."""
    fields = [c.alias(f"k{i}") for i, c in enumerate(order_by)] + [x.alias("v")]
    rows = F.collect_list(F.struct(*fields))
    return F.transform(F.array_sort(rows) if order_by else rows, lambda r: r["v"])


def array_agg(x, order_by: Sequence[Column] = ()) -> Column:
    """Keeps nulls; null without rows."""
    out = _sorted(col(x), order_by)
    return F.when(F.count(F.lit(1)) > 0, out)


def string_agg(x, delimiter: str, order_by: Sequence[Column] = ()) -> Column:
    """Skips nulls; null without values."""
    return F.when(F.count(col(x)) > 0, F.array_join(_sorted(col(x).cast("string"), order_by), delimiter))


def json_array_agg(x, order_by: Sequence[Column] = ()) -> Column:
    """A JSON array of the values that aren't null."""
    values = F.filter(_sorted(col(x), order_by), lambda v: v.isNotNull())
    return F.when(F.count(F.lit(1)) > 0, F.to_json(values))


def xml_agg(x, order_by: Sequence[Column] = ()) -> Column:
    """Fragments one after the other; null without any."""
    return F.when(F.count(col(x)) > 0, F.array_join(_sorted(col(x).cast("string"), order_by), ""))


def text_agg(columns: Sequence[str], delimiter: str = ",", quote: str | None = '"', header: bool = False, encoding: str = "UTF-8", order_by: Sequence[Column] = ()) -> Column:
    """Lines of delimited text as binary; every value is quoted unless quote is None, a quote in it is doubled."""
    def cell(c: Column) -> Column:
        plain = F.coalesce(c.cast("string"), F.lit(""))
        return plain if quote is None else F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit(quote), F.replace(plain, F.lit(quote), F.lit(quote * 2)), F.lit(quote)))

    line = F.concat_ws(delimiter, *(cell(col(c)) for c in columns))
    mark = (lambda s: s) if quote is None else (lambda s: f"{quote}{s}{quote}")
    head = F.lit(delimiter.join(mark(c) for c in columns) + "\n" if header else "")
    return F.encode(F.concat(head, F.array_join(F.transform(_sorted(line, order_by), lambda s: F.concat(s, F.lit("\n"))), "")), encoding)


def sum_(x, kind: str) -> Column:
    """Whole numbers give a long (an overflow is an error), others their own kind."""
    return F.sum(col(x).cast("bigint")) if kind in ("byte", "short", "integer", "long") else F.sum(col(x))


def avg_(x, kind: str) -> Column:
    """Whole numbers give a decimal."""
    return F.avg(col(x).cast("decimal(34,12)")).cast("decimal(38,16)") if kind in ("byte", "short", "integer", "long", "biginteger") else F.avg(col(x))


def every(x) -> Column:
    return F.every(col(x))


def some(x) -> Column:
    return F.some(col(x))


def var_pop(x) -> Column:
    return F.var_pop(col(x))


def where(agg, x, condition: Column) -> Column:
    """agg(x) FILTER (WHERE condition)."""
    return agg(F.when(condition, col(x)))


def rollup(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    return df.rollup(*keys).agg(*(c.alias(n) for n, c in aggs.items()))


def staged_union_aggregate(parts: Sequence[DataFrame], keys: Sequence[str], sums: dict[str, str], counts: Sequence[str] = ()) -> DataFrame:
    """Aggregates a union branch by branch, then the partial rows.  Spark's own partial aggregation does the same within
    one plan; this form is for branches that are separate sources, where each can take its part as a pushed query."""
    staged = None
    for df in parts:
        part = df.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.count(F.lit(1)).alias(n) for n in counts))
        staged = part if staged is None else staged.unionByName(part)
    return staged.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in [*sums, *counts]))
