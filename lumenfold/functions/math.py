"""Numeric functions."""

from __future__ import annotations

import math
import re
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col


def divide(a, b, kind: str) -> Column:
    """``kind``: "int" truncates, "double" gives infinities and NaN for division by zero, "decimal" keeps 16 places."""
    a, b = col(a), col(b)
    if kind == "int":
        return F.call_function("div", a, b)
    if kind == "double":
        inf = F.when(a == 0, F.lit(float("nan"))).when((a > 0), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return F.when(b.isNull() | a.isNull(), F.lit(None).cast("double")).when(b == 0, inf).otherwise(a.cast("double") / F.when(b != 0, b.cast("double")))
    return (a.cast("decimal(38,16)") / b.cast("decimal(38,0)" if kind == "decimal_by_int" else "decimal(38,16)")).cast("decimal(38,16)")


def ceiling(x) -> Column:
    return F.ceil(col(x)).cast("double")


def floor(x) -> Column:
    return F.floor(col(x)).cast("double")


def sign(x) -> Column:
    return F.signum(col(x)).cast("int")


def round_(x, places: int) -> Column:
    """Rounds half away from zero on the exact binary value, so 2.675 at two places is 2.67 (it lies below).

    Spark rounds a double's shortest decimal form, and its decimals are made from that form too, so the exact value is
    only in reach of Python; use F.round where the last place doesn't matter.
    """

    @F.pandas_udf("double")
    def exact(s: pd.Series) -> pd.Series:
        unit = Decimal(1).scaleb(-places)
        return s.map(lambda v: float(Decimal(v).quantize(unit, ROUND_HALF_UP)) if v is not None and math.isfinite(v) else v)

    return exact(col(x).cast("double"))


def round_scaled(x, places: int) -> Column:
    """Rounds as C programs and most databases do: the value times a power of ten goes to the nearest whole number, half away
    from zero, and is divided again.  What that would take beyond the largest double stays as it is."""
    x, scale = col(x), F.lit(float(10**places))
    whole = F.round(x * scale, 0) / scale
    return F.when(F.isnan(whole) | (F.abs(whole) == float("inf")), x).otherwise(whole)


def exp(x) -> Column:
    """The C library's exponential.  Java's is off by a unit in the last place more often, which shows in large values."""

    @F.arrow_udf("double")
    def run(a: pa.Array) -> pa.Array:
        def one(v: float | None) -> float | None:
            try:
                return None if v is None else math.exp(v)
            except OverflowError:
                return math.inf

        return pa.array([one(v) for v in a.to_pylist()], pa.float64())

    return run(col(x).cast("double"))


def power(x, y) -> Column:
    return F.pow(col(x), col(y))


def log10(x) -> Column:
    return F.log10(col(x))


def bitand(a, b) -> Column:
    return col(a).bitwiseAND(col(b))


def bitor(a, b) -> Column:
    return col(a).bitwiseOR(col(b))


def bitxor(a, b) -> Column:
    return col(a).bitwiseXOR(col(b))


def bitnot(a) -> Column:
    return F.bitwise_not(col(a))


def format_number(x, pattern: str) -> Column:
    """A number by a decimal pattern such as ``#,##0.00``."""
    return F.call_function("format_number", col(x), F.lit(pattern))


class NumberPattern(NamedTuple):
    """What a decimal pattern such as ``$#,##0.00;($#)`` says about texts."""

    prefix: str
    suffix: str
    minus: str
    minus_suffix: str
    grouped: bool
    scale: int


def number_pattern(pattern: str) -> NumberPattern:
    """Raises ValueError on a malformed one: one point at most, no comma after it, no # between 0 and the point."""
    found = re.fullmatch(r"((?:[^#0,.;']|'[^']*')*)([#0,.]+(?:E0+)?)((?:[^#0,.;']|'[^']*')*)(?:;((?:[^#0,.;']|'[^']*')*)[#0,.]*(?:E0+)?((?:[^#0,.;']|'[^']*')*))?", pattern)
    if not found or not re.fullmatch(r"#*[#,]*[0,]*(\.0*#*)?(E0+)?", found[2]) or not set(found[2]) & set("#0") or re.search(r",(\.|$)", found[2]):
        raise ValueError(f"malformed pattern {pattern}")
    plain = lambda t: re.sub(r"'([^']*)'", lambda m: m[1] or "'", t or "")
    prefix, suffix = plain(found[1]), plain(found[3])
    minus = (plain(found[4]), plain(found[5])) if found[4] is not None else ("-" + prefix, suffix)
    return NumberPattern(prefix, suffix, *minus, "," in found[2], 100 if "%" in prefix + suffix else 1000 if "\u2030" in prefix + suffix else 1)


def parse_number(s, pattern: str, kind: str) -> Column:
    """A text written by a decimal pattern, read as far as it fits; one that doesn't begin so is an error."""
    how, s = number_pattern(pattern), col(s)
    number = ("([0-9,]*" if how.grouped else "([0-9]*") + r"(?:\.[0-9]*)?(?:E-?[0-9]+)?)"

    def sign(prefix: str, suffix: str, factor: int) -> Column:
        digits = F.replace(F.regexp_extract(s, "^" + re.escape(prefix) + number + re.escape(suffix), 1), F.lit(","), F.lit(""))
        return F.when(digits != "", digits.cast("decimal(38,18)") * F.lit(factor) / F.lit(how.scale))

    either = F.coalesce(sign(how.prefix, how.suffix, 1), sign(how.minus, how.minus_suffix, -1))
    target = {"integer": "int", "long": "bigint", "double": "double", "float": "float", "biginteger": "decimal(38,0)", "bigdecimal": "decimal(38,18)"}[kind]
    value = either.cast(target) if kind in ("double", "float", "bigdecimal") else (F.floor(F.abs(either)) * F.signum(either)).cast(target)
    return F.when(s.isNull(), F.lit(None).cast(target)).when(either.isNull(), F.raise_error(F.lit(f"{kind}: the text does not fit {pattern}"))).otherwise(value)


def avg_exact(x) -> Column:
    """The mean of whole numbers as a decimal, not a double."""
    return F.avg(col(x).cast("decimal(34,12)")).cast("decimal(38,16)")
