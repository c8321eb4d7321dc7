"""String functions.  Arguments that are texts by nature (delimiters, patterns) may be plain strings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, require, text


def ascii_(s) -> Column:
    """Code point of the first character; null for empty text."""
    s = col(s)
    return F.when(F.length(s) > 0, F.ascii(s))


def chr_(n) -> Column:
    return F.char(col(n))


def concat2(a, b) -> Column:
    """Like concat, but one null counts as empty; null only if both are."""
    a, b = col(a), col(b)
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("string")).otherwise(F.concat(F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit(""))))


def endswith(sub, s) -> Column:
    return F.endswith(col(s), text(sub))


def insert(s, start, length, other) -> Column:
    """Replaces ``length`` characters from ``start`` (1-based); a start beyond the text is an error."""
    s, start, length = col(s), col(start), col(length)
    sound = (start >= 1) & (start <= F.length(s) + 1) & (length >= 0)
    return require(sound, F.overlay(s, text(other), start, length), "insert: start or length is out of range")


def left(s, n) -> Column:
    s, n = col(s), col(n)
    return require(n >= 0, F.left(s, n), "left: negative count")


def right(s, n) -> Column:
    s, n = col(s), col(n)
    return require(n >= 0, F.right(s, n), "right: negative count")


def locate(sub, s, start=1) -> Column:
    """Place of ``sub`` at ``start`` or later, 0 if there is none; a start below 1 is 1."""
    return F.call_function("locate", text(sub), col(s), F.greatest(col(start), F.lit(1)))


def substring(s, start, length=None) -> Column:
    """From ``start`` (1-based; negative: from the end; 0 is 1); null where it lies outside or the length is negative."""
    s, start = col(s), col(start)
    size = F.length(s)
    first = F.when(start < 0, size + start + 1).when(start == 0, F.lit(1)).otherwise(start)
    sound = (first >= 1) & (first <= size)
    if length is None:
        return F.when(sound, F.substr(s, first))
    length = col(length)
    return F.when(sound & (length >= 0), F.substr(s, first, length))


def translate(s, source: str, target: str) -> Column:
    if len(source) != len(target):
        raise ValueError("translate: both lists need one length")
    return F.translate(col(s), source, target)


def trim(s, mode: str = "BOTH", char: str = " ") -> Column:
    if len(char) != 1:
        raise ValueError("trim: one character is needed")
    return {"BOTH": F.btrim, "LEADING": F.ltrim, "TRAILING": F.rtrim}[mode.upper()](col(s), F.lit(char))


def regexp_replace(s, pattern: str, replacement: str, flags: str = "") -> Column:
    """Replaces the first match, or with flag g every match; i ignores case, m lets ^ and $ match at lines."""
    if set(flags) - set("gim"):
        raise ValueError(f"regexp_replace: unknown flags in {flags!r}")
    mode = "".join(f for f in "im" if f in flags)
    prefix = f"(?{mode})" if mode else ""
    if "g" in flags:
        return F.regexp_replace(col(s), prefix + pattern, replacement)
    shift = lambda m: m[1] + str(int(m[2]) + 1)  # noqa: E731  one more group stands before
    own = re.sub(r"(\\)([1-9])", shift, pattern)
    return F.regexp_replace(col(s), rf"{prefix}\A([\s\S]*?)(?:{own})([\s\S]*)\z", "$1" + re.sub(r"(\$)(\d+)", shift, replacement) + "$" + str(2 + re.compile(pattern).groups))


def tokenize(s, delimiter: str) -> Column:
    """Parts between single delimiters; a doubled one stands for itself, empty parts are dropped."""
    if len(delimiter) != 1:
        raise ValueError("tokenize: one character is needed")
    mark = "\x00"
    parts = F.split(F.replace(col(s), F.lit(delimiter * 2), F.lit(mark)), re.escape(delimiter))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.replace(x, F.lit(mark), F.lit(delimiter)))


_ESCAPES = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r"}
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|[0-7]{1,3}|.)", re.DOTALL)


def unescape_text(s: str | None) -> str | None:
    one = lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else chr(int(m[1], 8)) if m[1][0] in "01234567" else _ESCAPES.get(m[1], m[1])
    return None if s is None else _ESCAPE.sub(one, s)


def unescape(s) -> Column:
    """Resolves backslash escapes: b t n f r, uXXXX and octal."""

    @F.pandas_udf("string")
    def resolve(s: pd.Series) -> pd.Series:
        return s.map(unescape_text, na_action="ignore")

    return resolve(col(s))


def to_chars(data, encoding: str) -> Column:
    kind = encoding.upper()
    return F.hex(col(data)) if kind == "HEX" else F.base64(col(data)) if kind == "BASE64" else F.decode(col(data), kind)


def to_bytes(s, encoding: str) -> Column:
    kind = encoding.upper()
    return F.unhex(col(s)) if kind == "HEX" else F.unbase64(col(s)) if kind == "BASE64" else F.encode(col(s), kind)


def query_string(path: str, **params) -> Column:
    """path?name=value&...: null values are left out, the rest is percent-encoded."""
    encode = lambda c: F.regexp_replace(F.url_encode(c.cast("string")), r"\+", "%20")
    parts = F.filter(F.array(*(F.concat(encode(F.lit(k)), F.lit("="), encode(col(v))) for k, v in params.items())), lambda x: x.isNotNull())
    return F.concat(F.lit(path), F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(F.lit("")))
