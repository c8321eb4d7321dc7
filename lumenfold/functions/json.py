"""JSON functions.  A JSON value is text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col

_PLAIN = re.compile(r"\$(\.[A-Za-z_]\w*|\[\d+\])*")
_STEP = re.compile(r"\.\.(\w+|\*)|\.(\w+|\*)|\[(\d+|\*)\]|\['([^']*)'\]|\[(-?\d*):(-?\d*)\]|\[\?\(@\.(\w+)\s*(==|!=|<=|>=|<|>)\s*('[^']*'|-?[\d.]+|true|false|null)\)\]|\[\?\(@\.(\w+)\)\]")
_TESTS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@lru_cache(1000)
def steps(path: str) -> tuple[re.Match, ...]:
    if not path.startswith("$"):
        raise ValueError(f"a path starts with $: {path}")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"can't read the path {path} at {at}")
        out.append(m)
        at = m.end()
    return tuple(out)


@lru_cache(1000)
def definite(path: str) -> bool:
    """Whether the path leads to one value at most."""
    return all(m[2] not in (None, "*") or m[3] not in (None, "*") or m[4] is not None for m in steps(path))


def _all(value) -> Iterator:
    yield value
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from _all(v)


def select(doc, path: str) -> list:
    """Every value that the path leads to, in document order."""
    found = [doc]
    for m in steps(path):
        deep, name, index, quoted, low, high, key, op, literal, has = m.groups()
        now = []
        for v in (x for f in found for x in _all(f)) if deep else found:
            name_ = deep or name or quoted
            if name_ == "*" and quoted is None or index == "*":
                now += v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
            elif name_ is not None:
                if isinstance(v, dict) and name_ in v:
                    now.append(v[name_])
            elif index is not None:
                if isinstance(v, list) and int(index) < len(v):
                    now.append(v[int(index)])
            elif low is not None:
                now += v[int(low) if low else None : int(high) if high else None] if isinstance(v, list) else ()
            else:
                for item in v if isinstance(v, list) else v.values() if isinstance(v, dict) else ():
                    if isinstance(item, dict):
                        want = json.loads(literal.replace("'", '"')) if literal else None
                        mine = item.get(key or has)
                        try:
                            if (has and has in item) or (key and key in item and _TESTS[op](mine, want)):
                                now.append(item)
                        except TypeError:
                            pass
        found = now
    return found


#: Made once, as json.dumps makes an encoder for each call with settings.
_json = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else _json(value)


def path_value(doc: str | None, path: str, null_leaf: bool = False, whole: bool = False) -> str | None:
    """The first match as text, or with ``whole`` as JSON.  A definite path that leads nowhere is an error, unless
    ``null_leaf`` says that its last step may be missing."""
    return None if doc is None else _value_at(json.loads(doc), path, null_leaf, whole)


def _value_at(value, path: str, null_leaf: bool, whole: bool = False) -> str | None:
    found = select(value, path)
    if not found:
        if definite(path) and not (null_leaf and select(value, path[: steps(path)[-1].start()])):
            raise ValueError(f"no value at {path}")
        return None
    return _json(found[0] if definite(path) else found) if whole else _text(found[0])


def json_path_value(doc, path: str, null_leaf: bool = False) -> Column:
    if null_leaf and _PLAIN.fullmatch(path):
        return F.get_json_object(col(doc), path)

    @F.pandas_udf("string")
    def value(s: pd.Series) -> pd.Series:
        return s.map(lambda d: path_value(d, path, null_leaf), na_action="ignore")

    return value(col(doc))


def json_query(doc, path: str, null_leaf: bool = False) -> Column:
    @F.pandas_udf("string")
    def value(s: pd.Series) -> pd.Series:
        return s.map(lambda d: path_value(d, path, null_leaf, True), na_action="ignore")

    return value(col(doc))


def _element(c: Column, kind: str | None) -> Column:
    """A value as JSON text; ``kind`` "json" passes text through."""
    if kind == "json":
        return F.coalesce(c, F.lit("null"))
    one = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(one, F.lit(6), F.length(one) - 6)


def json_array(*values, raw: tuple[int, ...] = ()) -> Column:
    """An array of values of any types, nulls kept; ``raw``: places of values that are JSON already."""
    parts = [_element(col(v), "json" if k in raw else None) for k, v in enumerate(values)]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def json_object(raw: tuple[str, ...] = (), **members) -> Column:
    """An object, nulls kept."""
    parts = [F.concat(F.lit(json.dumps(k) + ":"), _element(col(v), "json" if k in raw else None)) for k, v in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_parse(doc, wellformed: bool = False) -> Column:
    """The text itself; an error if it isn't JSON, unless the caller vouches for it."""
    doc = col(doc)
    return doc if wellformed else F.when(doc.isNull() | F.try_parse_json(doc).isNotNull(), doc).otherwise(F.raise_error(F.lit("json_parse: not JSON")))


def json_to_array(doc: str | None, row_path: str, null_leaf: bool, *paths: str) -> list[list[str | None]] | None:
    """Rows of the values of each path, for each value of the row path."""
    if doc is None:
        return None
    rows = select(json.loads(doc), row_path)
    if len(rows) == 1 and isinstance(rows[0], list):
        rows = rows[0]
    return [[_value_at(r, p, null_leaf) for p in paths] or [_text(r)] for r in rows]


@lru_cache(10_000)
def _element_name(name: str) -> str:
    return re.sub(r"^[^A-Za-z_]|[^\w.-]", lambda m: f"_x{ord(m[0]):04X}_", name)


def _xml(name: str, value) -> str:
    name = _element_name(name)
    if isinstance(value, list):
        return "".join(_xml(name, v) for v in value)
    if isinstance(value, dict):
        return f"<{name}>{''.join(_xml(k, v) for k, v in value.items())}</{name}>"
    if value is None:
        return f'<{name} xsi:nil="true"/>'
    kind = "boolean" if isinstance(value, bool) else "decimal" if isinstance(value, int) else "double" if isinstance(value, float) else None
    return f"<{name}{f' xsi:type={chr(34)}{kind}{chr(34)}' if kind else ''}>{escape(_text(value))}</{name}>"


def to_xml(root: str, doc: str) -> str:
    """Elements named after members; a root array repeats the root's name inside it."""
    value = json.loads(doc)
    body = f"<{root}>{_xml(root, value)}</{root}>" if isinstance(value, list) else _xml(root, value)
    return '<?xml version="1.0" ?>' + body.replace(f"<{root}", f'<{root} xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"', 1)


def json_to_xml(root: str, doc) -> Column:
    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda text: to_xml(root, text), na_action="ignore")

    return convert(col(doc))
