"""XML publishing and query functions.  An XML value is text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col


def xml_text(x) -> Column:
    out = col(x).cast("string")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def _attribute(x) -> Column:
    return F.replace(xml_text(x), F.lit('"'), F.lit("&quot;"))


def xml_element(name: str, *content, attributes: dict | None = None, raw: tuple[int, ...] = ()) -> Column:
    """An element; null attributes and contents are left out; ``raw``: places of contents that are XML already."""
    head = [F.concat(F.lit(f' {k}="'), _attribute(v), F.lit('"')) for k, v in (attributes or {}).items()]
    inner = [col(c).cast("string") if k in raw else xml_text(c) for k, c in enumerate(content)]
    body = F.concat_ws("", *inner) if inner else F.lit("")
    return F.concat(F.lit(f"<{name}"), F.concat_ws("", *head) if head else F.lit(""), F.when(body == "", F.lit("/>")).otherwise(F.concat(F.lit(">"), body, F.lit(f"</{name}>"))))


def xml_forest(raw: tuple[str, ...] = (), **members) -> Column:
    """An element for each member that isn't null; null if all are."""
    parts = [F.when(col(v).isNotNull(), F.concat(F.lit(f"<{k}>"), col(v).cast("string") if k in raw else xml_text(v), F.lit(f"</{k}>"))) for k, v in members.items()]
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws("", *parts))


def xml_concat(*parts) -> Column:
    """Null only if all parts are."""
    return F.when(F.coalesce(*map(col, parts)).isNotNull(), F.concat_ws("", *map(col, parts)))


def xml_comment(x) -> Column:
    return F.concat(F.lit("<!--"), col(x), F.lit("-->"))


def xml_pi(name: str, x="") -> Column:
    return F.concat(F.lit(f"<?{name}"), F.concat(F.lit(" "), F.ltrim(col(x))) if isinstance(x, Column) or x else F.lit(""), F.lit("?>"))


def xml_serialize(x, declaration: bool = False) -> Column:
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), col(x)) if declaration else col(x)


def xpath_value(x, path: str) -> Column:
    """The string value of the first node, null if the path finds none."""
    return F.when(F.xpath_boolean(col(x), F.lit(path)), F.xpath_string(col(x), F.lit(path)))


def xml_exists(x, path: str) -> Column:
    return F.xpath_boolean(col(x), F.lit(path))


def xml_query(x, path: str) -> Column:
    """The string values of all nodes that the path finds."""
    return F.xpath(col(x), F.lit(path))


def xml_cast(x, kind: str) -> Column:
    return F.xpath_string(col(x), F.lit("/*")).cast(kind)
