"""Table functions over a column of a DataFrame.  Every row's other columns are kept, as a lateral join keeps them.

A column spec is (name, type, options): texttable: width, header, no_trim, selector, position; jsontable and xmltable:
path, default; type "ordinality" numbers the rows from 1.
"""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.common import free_name
from ..functions.conversion import TYPES
from ..functions.json import _PLAIN, _text, select

Spec = Sequence[tuple]


def _type(kind: str) -> str:
    return "int" if kind == "ordinality" else TYPES.get(kind, kind)


def _options(spec: tuple) -> dict:
    return spec[2] if len(spec) > 2 else {}


def expand(df: DataFrame, column: str, columns: Spec, rows: Callable[[object], Iterable[Sequence]]) -> DataFrame:
    """Calls ``rows`` for each value of the column and converts the texts it gives; a null value gives no row."""
    names = [c[0] for c in columns]
    kept = StructType([f for f in df.schema.fields if f.name != column])
    raw = StructType([*kept.fields, *(StructField(n, StringType()) for n in names)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at, out = [], []
            for i, value in enumerate(frame[column]):
                if value is not None:
                    for row in rows(value):
                        at.append(i)
                        out.append([None if v is None else str(v) for v in row])
            base = frame[[f.name for f in kept]].iloc[at].reset_index(drop=True)
            yield pd.concat([base, pd.DataFrame(out, columns=names, dtype=object)], axis=1)

    made = df.mapInPandas(run, raw)
    return made.select(*(F.col(f.name) for f in kept), *(F.col(c[0]).cast(_type(c[1])).alias(c[0]) for c in columns))


def _records(text: str, row_delimiter: str | None, delimiter: str, quote: str | None, escape: str | None) -> Iterator[list[str]]:
    if quote is None and escape is None:
        for line in (text.split(row_delimiter) if row_delimiter else [text]):
            yield line.rstrip("\r").split(delimiter) if row_delimiter == "\n" else line.split(delimiter)
        return
    row, cell, inside, i, touched = [], [], False, 0, False
    while i < len(text):
        c = text[i]
        if escape and c == escape and i + 1 < len(text):
            i += 1
            cell.append(text[i])
        elif inside:
            if c == quote:
                if i + 1 < len(text) and text[i + 1] == quote and escape is None:
                    i += 1
                    cell.append(quote)
                else:
                    inside = False
            else:
                cell.append(c)
        elif quote and c == quote:
            inside, cell, touched = True, [] if not "".join(cell).strip() else cell, True
        elif c == delimiter:
            row.append("".join(cell))
            cell = []
        elif row_delimiter and c == row_delimiter:
            yield [*row, "".join(cell).rstrip("\r") if row_delimiter == "\n" else "".join(cell)]
            row, cell, touched = [], [], False
        else:
            cell.append(c)
        i += 1
    if inside:
        raise ValueError("a quoted value isn't closed")
    if row or cell or touched:
        yield [*row, "".join(cell)]


def text_rows(text: str, columns: Spec, delimiter: str = ",", row_delimiter: str | None = "\n", quote: str | None = '"', escape: str | None = None, header: int | None = None, skip: int = 0, selector: str | None = None) -> Iterator[list]:
    """Rows of a text table.  ``header``: the line (from 1, after ``skip``) that names the columns.  ``selector``: only
    lines that begin with it; a column with a selector takes its value from the last line that begins with that one."""
    fixed = any("width" in _options(c) for c in columns)
    if fixed:
        total = sum(_options(c).get("width", 0) for c in columns)
        lines = text.split(row_delimiter) if row_delimiter else [text[i : i + total] for i in range(0, len(text), total)]
        number = 0
        for line in lines[skip:]:
            if not line.strip("\r"):
                continue
            number += 1
            at, row = 0, []
            for c in columns:
                if c[1] == "ordinality":
                    row.append(number)
                    continue
                width = _options(c)["width"]
                cell = line[at : at + width]
                row.append(cell if _options(c).get("no_trim") else cell.strip() or None)
                at += width
            yield row
        return
    places, number, last = None, 0, {}
    if header is None:
        places = {}
        for k, c in enumerate(c for c in columns if c[1] != "ordinality" and "selector" not in _options(c)):
            places[c[0]] = k + bool(selector)
    for k, cells in enumerate(r for i, r in enumerate(_records(text, row_delimiter, delimiter, quote, escape)) if i >= skip):
        if header is not None and k == header - 1:
            names = [c.strip().lower() for c in cells]
            places = {c[0]: names.index(_options(c).get("header", c[0]).lower()) for c in columns if c[1] != "ordinality"}
            continue
        if header is not None and k < header or cells == [""]:
            continue
        last[cells[0]] = cells
        if selector and cells[0] != selector:
            continue
        number += 1
        row = []
        for c in columns:
            if c[1] == "ordinality":
                row.append(number)
                continue
            if own := _options(c).get("selector"):
                cell = (last.get(own) or [])[_options(c).get("position", 1) :][:1]
            else:
                cell = cells[places[c[0]] :][:1]
            value = cell[0] if cell else None
            row.append(value if value is None or _options(c).get("no_trim") else value.strip() or None)
        yield row


#: What Python counts as white space.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def texttable_native(df: DataFrame, column: str, columns: Spec, delimiter: str = ",", row_delimiter: str = "\n", header: int | None = None, skip: int = 0) -> DataFrame:
    """Delimited text without quotes or escapes, in Catalyst alone."""
    lines = F.split(F.col(column), re.escape(row_delimiter), -1)
    if row_delimiter == "\n":
        lines = F.transform(lines, lambda x: F.regexp_replace(x, r"\r+$", ""))
    cells = lambda x: F.split(x, re.escape(delimiter), -1)
    first = skip + (header or 0)
    data = F.filter(F.slice(lines, first + 1, F.greatest(F.size(lines) - first, F.lit(0))), lambda x: x != "")
    n, line, names = free_name("n", df), free_name("line", df), free_name("names", df)
    named = df.withColumn(names, F.transform(cells(F.get(lines, F.lit(first - 1))), lambda x: F.lower(F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", ""))) if header else F.lit(None))
    kept = [c for c in df.columns if c != column]
    flat = named.select(*kept, names, F.posexplode(F.transform(data, cells)).alias(n, line))
    out, k = [], 0
    for c in columns:
        if c[1] == "ordinality":
            out.append((F.col(n) + 1).alias(c[0]))
            continue
        if header:
            wanted = _options(c).get("header", c[0]).lower()
            at = F.array_position(names, wanted)
            place = F.when(at > 0, at - 1).otherwise(F.raise_error(F.lit(f"the header has no {wanted}"))).cast("int")
        else:
            place, k = F.lit(k), k + 1
        cell = F.get(F.col(line), place)
        bare = cell if _options(c).get("no_trim") else F.nullif(F.regexp_replace(cell, f"^{_SPACE}+|{_SPACE}+$", ""), F.lit(""))
        out.append(bare.cast(_type(c[1])).alias(c[0]))
    return flat.select(*kept, *out)


def texttable(df: DataFrame, column: str, columns: Spec, **how) -> DataFrame:
    """Stays in Catalyst where nothing is quoted, escaped, selected or of fixed width."""
    plain = how.get("quote", '"') is None and how.get("escape") is None and how.get("selector") is None and how.get("row_delimiter", "\n")
    if plain and not any({"width", "selector"} & _options(c).keys() for c in columns):
        return texttable_native(df, column, columns, **{k: v for k, v in how.items() if k in ("delimiter", "row_delimiter", "header", "skip")})
    return expand(df, column, columns, lambda text: text_rows(text, columns, **how))


def json_rows(doc: str, row_path: str, columns: Spec, null_leaf: bool = True) -> Iterator[list]:
    values = select(json.loads(doc), row_path)
    if len(values) == 1 and isinstance(values[0], list):
        values = values[0]
    for number, value in enumerate(values, 1):
        row = []
        for c in columns:
            if c[1] == "ordinality":
                row.append(number)
                continue
            path = _options(c).get("path", f"$.{c[0]}").replace("@", "$", 1)
            found = select(value, path)
            if not found and not null_leaf:
                raise ValueError(f"no value at {path}")
            cell = _text(found[0]) if found else None
            row.append(_options(c).get("default") if cell is None else cell)
        yield row


def jsontable(df: DataFrame, column: str, row_path: str, columns: Spec, null_leaf: bool = True) -> DataFrame:
    """Stays in Catalyst where all paths are plain member and index steps and may lead nowhere."""
    if null_leaf and all(_PLAIN.fullmatch(p) for p in (row_path, *(_options(c).get("path", f"$.{c[0]}").replace("@", "$", 1) for c in columns if c[1] != "ordinality"))):
        return jsontable_native(df, column, columns, row_path)
    return expand(df, column, columns, lambda doc: json_rows(doc, row_path, columns, null_leaf))


def jsontable_native(df: DataFrame, column: str, columns: Spec, row_path: str = "$") -> DataFrame:
    """The object at a path as one row, or its array of objects as a row each, without Python."""
    n, item = free_name("n", df), free_name("item", df)
    found = F.col(column) if row_path == "$" else F.get_json_object(column, row_path)
    kind = F.when(F.ltrim(found).startswith("["), found).otherwise(F.concat(F.lit("["), found, F.lit("]")))
    kept = [c for c in df.columns if c != column]
    flat = df.select(*kept, F.posexplode(F.from_json(kind, "array<string>")).alias(n, item))
    out = []
    for c in columns:
        if c[1] == "ordinality":
            out.append((F.col(n) + 1).cast("int").alias(c[0]))
            continue
        value = F.get_json_object(item, _options(c).get("path", f"$.{c[0]}").replace("@", "$", 1))
        value = F.coalesce(value, F.lit(_options(c)["default"])) if "default" in _options(c) else value
        out.append(value.cast(_type(c[1])).alias(c[0]))
    return flat.select(*kept, *out)


def _strings(node: ET.Element, path: str) -> list[str]:
    """String values of a relative path: child and descendant steps, predicates as ElementTree has them, a last step
    @name or text(), and . for the node."""
    path, _, last = path.rpartition("/") if path.rpartition("/")[2] in ("text()",) or path.rpartition("/")[2].startswith("@") else (path, "", "")
    nodes = [node] if path in ("", ".") else node.findall(path.lstrip("/") if not path.startswith("//") else "." + path)
    if last.startswith("@"):
        return [n.attrib[last[1:]] for n in nodes if last[1:] in n.attrib]
    return ["".join(n.itertext()) for n in nodes]


def xml_rows(doc: str, row_path: str, columns: Spec) -> Iterator[list]:
    root = ET.fromstring(re.sub(r"\sxmlns=(\"[^\"]*\"|'[^']*')", "", doc))
    parts = row_path.strip("/").split("/")
    nodes = root.iter(parts[-1]) if row_path.startswith("//") and len(parts) == 1 else [root] if parts == [root.tag] else root.findall("/".join(parts[1:])) if parts[0] == root.tag else root.findall(row_path)
    for number, node in enumerate(nodes, 1):
        row = []
        for c in columns:
            if c[1] == "ordinality":
                row.append(number)
                continue
            found = _strings(node, _options(c).get("path", c[0]))
            if len(found) > 1 and not c[1].endswith("[]"):
                raise ValueError(f"more than one value for {c[0]}")
            row.append(found[0] if found else _options(c).get("default"))
        yield row


def xmltable(df: DataFrame, column: str, row_path: str, columns: Spec) -> DataFrame:
    return expand(df, column, columns, lambda doc: xml_rows(doc, row_path, columns))


def arraytable(df: DataFrame, array: str | Column, columns: Spec, rows: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """An array as one row of columns, or with ``rows`` an array of arrays as a row each; missing places are null."""
    array = F.col(array) if isinstance(array, str) else array
    row = free_name("row", df)
    base = df.select(*keep, (F.explode(array) if rows else array).alias(row))
    return base.where(F.col(row).isNotNull()).select(*keep, *(F.try_element_at(row, F.lit(k)).cast(_type(c[1])).alias(c[0]) for k, c in enumerate(columns, 1)))


def array_iterate(df: DataFrame, array: str, name: str = "col") -> DataFrame:
    return df.select(F.explode(array).alias(name))


def objecttable(df: DataFrame, column: str, rows: Callable[[object], Iterable], columns: Sequence[tuple[str, str, Callable]]) -> DataFrame:
    """Rows of a Python object: ``rows`` gives the row objects, each column's function its value."""
    return expand(df, column, columns, lambda value: ([f(r) for _, _, f in columns] for r in rows(value)))


def to_csv_text(rows: Iterable[Sequence]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()
