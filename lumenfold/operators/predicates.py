"""Predicates that Spark's SQL doesn't have."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import col, free_name


def quantified(df: DataFrame, x: str, op: str, quantifier: str, sub: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the boolean ``x op ANY|SOME|ALL (SELECT value FROM sub)`` in three-valued logic.

    The subquery shrinks to one row (least, greatest, rows, rows that aren't null), which is joined by a nested loop over
    that single row; equality with ANY and inequality with ALL need the values themselves and join on them.
    """
    some = quantifier.upper() in ("ANY", "SOME")
    op = {"!=": "<>"}.get(op, op)
    if op not in ("=", "<>", "<", "<=", ">", ">=") or not some and quantifier.upper() != "ALL":
        raise ValueError(f"{op} {quantifier}")
    facts, key = free_name("facts", df), free_name("key", df)
    one = sub.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"), F.count(value).alias("known")).alias(facts))
    lo, hi, n, known = (F.col(f"{facts}.{k}") for k in ("lo", "hi", "n", "known"))
    out = df.crossJoin(F.broadcast(one))  # one row
    v = F.col(x)
    holes = known < n
    if (op == "=") == some and op in ("=", "<>"):
        keys = sub.where(F.col(value).isNotNull()).select(F.col(value).alias(key)).distinct()
        out = out.join(keys, v == F.col(key), "left")
        found = F.when(n == 0, F.lit(False)).when(v.isNull(), F.lit(None).cast("boolean")).when(F.col(key).isNotNull(), F.lit(True)).when(holes, F.lit(None).cast("boolean")).otherwise(F.lit(False))
        return out.withColumn(name, found if some else ~found).drop(facts, key)
    decided = {
        ("<", True): v < hi, ("<=", True): v <= hi, (">", True): v > lo, (">=", True): v >= lo, ("<>", True): (v != lo) | (v != hi),
        ("<", False): v < lo, ("<=", False): v <= lo, (">", False): v > hi, (">=", False): v >= hi, ("=", False): (v == lo) & (v == hi),
    }[op, some]
    decided = F.when(n == 0, F.lit(not some)).otherwise(decided)
    decided = F.when((n > 0) & holes & ((~decided if some else decided) | decided.isNull()), F.lit(None).cast("boolean")).otherwise(decided)
    return out.withColumn(name, decided).drop(facts)


def similar_pattern(pattern: str, escape: str | None = None) -> str:
    """A SIMILAR TO pattern as a regular expression for the whole text."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            i += 1
            if i == len(pattern):
                raise ValueError("the pattern ends in its escape character")
            out.append(re.escape(pattern[i]))
        elif inside:
            inside = c != "]"
            out.append("\\" + c if c in "\\[&" else c)
        elif c == "[":
            inside = True
            out.append(c)
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in "|*+?{},()0123456789":
            out.append(c)
        else:
            out.append(re.escape(c))
        i += 1
    if inside:
        raise ValueError("a bracket isn't closed")
    return f"(?s)^(?:{''.join(out)})$"


def similar_to(x, pattern: str, escape: str | None = None) -> Column:
    return col(x).rlike(similar_pattern(pattern, escape))


def like_regex(x, pattern: str) -> Column:
    """True if the pattern is found anywhere."""
    return col(x).rlike(pattern)


def not_in(df: DataFrame, x: str, sub: DataFrame, value: str) -> DataFrame:
    """WHERE x NOT IN (SELECT value FROM sub): a null among the values leaves no row, a null x only if there are none."""
    return quantified(df, x, "<>", "ALL", sub, value, "__not_in").where("__not_in").drop("__not_in")
