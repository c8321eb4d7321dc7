"""Conversion, conditional, array and hash functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name

#: Spark type of each type name of the source model.
TYPES = {
    "string": "string", "varchar": "string", "char": "string", "clob": "string", "xml": "string", "json": "string", "boolean": "boolean",
    "byte": "tinyint", "tinyint": "tinyint", "short": "smallint", "smallint": "smallint", "integer": "int", "long": "bigint", "bigint": "bigint",
    "biginteger": "decimal(38,0)", "bigdecimal": "decimal(38,18)", "decimal": "decimal(38,18)", "float": "float", "real": "float", "double": "double",
    "date": "date", "time": "string", "timestamp": "timestamp_ntz", "blob": "binary", "varbinary": "binary", "geometry": "binary", "geography": "binary", "object": "string",
}


def convert(x, kind: str) -> Column:
    """cast(x AS kind); a type name ending in [] is an array.  A time is text HH:mm:ss."""
    kind = kind.lower()
    if kind.endswith("[]"):
        return col(x).cast(f"array<{TYPES[kind[:-2]]}>")
    if kind == "char":
        return F.left(col(x).cast("string"), F.lit(1))
    if kind == "time":
        return F.date_format(col(x).cast("timestamp"), "HH:mm:ss")
    return col(x).cast(TYPES[kind])


def decode_case(x, *pairs, default=None) -> Column:
    """Simple CASE in which a null matches a null."""
    out, x = F.lit(None) if default is None else col(default), col(x)
    for key, value in reversed(list(zip(pairs[::2], pairs[1::2]))):
        out = F.when(x.eqNullSafe(F.lit(key) if not isinstance(key, Column) else key), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def array_get(a, i) -> Column:
    """1-based; null outside."""
    return F.get(col(a), col(i) - 1)


def array_length(a) -> Column:
    return F.when(col(a).isNotNull(), F.size(col(a)))


def row_equal(left: Sequence, right: Sequence) -> Column:
    """(a, b) = (c, d) in three-valued logic: unknown if it hangs on a null."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & (col(a) == col(b))
    return out


def row_distinct(left: Sequence, right: Sequence) -> Column:
    """(a, b) IS DISTINCT FROM (c, d)."""
    out = F.lit(False)
    for a, b in zip(left, right, strict=True):
        out = out | ~col(a).eqNullSafe(col(b))
    return out


def row_compare(left: Sequence, op: str, right: Sequence) -> Column:
    """(a, b) op (c, d) for < <= > >=, in order of the columns."""
    if op not in ("<", "<=", ">", ">="):
        raise ValueError(op)
    pairs = [(col(a), col(b)) for a, b in zip(left, right, strict=True)]
    out = None
    for k, (a, b) in reversed(list(enumerate(pairs))):
        strict = a < b if op[0] == "<" else a > b
        last = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        out = last if k == len(pairs) - 1 else strict | ((a == b) & out)
    return out


def md5(x) -> Column:
    return F.unhex(F.md5(col(x).cast("binary")))


def sha1(x) -> Column:
    return F.unhex(F.sha1(col(x).cast("binary")))


def sha2(x, bits: int) -> Column:
    return F.unhex(F.sha2(col(x).cast("binary"), bits))


def aes_encrypt(x, key) -> Column:
    """AES-CBC with PKCS padding; the vector comes first in the result."""
    return F.aes_encrypt(col(x).cast("binary"), col(key), F.lit("CBC"), F.lit("PKCS"))


def aes_decrypt(x, key) -> Column:
    return F.aes_decrypt(col(x), col(key), F.lit("CBC"), F.lit("PKCS"))


def lookup(df: DataFrame, code_table: DataFrame, returns: str, key: str, by: str, name: str | None = None) -> DataFrame:
    """Adds the code table's value for each key; null without one.  Spark broadcasts the table if it is small."""
    own = free_name("key", df)
    codes = code_table.select(F.col(key).alias(own), F.col(returns).alias(name or returns)).dropDuplicates([own])
    return df.join(codes, F.col(by) == F.col(own), "left").drop(own)
