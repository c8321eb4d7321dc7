"""Whole-number division in SQL text: ``a / b`` of two whole numbers is a whole number, as in the source dialect.

The analyser knows the operands' types and where each division stands in the text; those of two whole numbers are written
out as ``div`` with the wider operand's type, from the innermost on.  Catalyst then sees its own operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sqltext import tokens

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _kind(expression) -> str:
    """The type before the analyser's cast."""
    if expression.getClass().getSimpleName() == "Cast" and expression.dataType().simpleString() == "double":
        expression = expression.child()
    return expression.dataType().simpleString()


def _divisions(node, text: str, out: list[tuple[int, int, str]]) -> None:
    """(first, last character, type) of each division of two whole numbers in this text."""
    methods = dir(node)
    if node.getClass().getSimpleName() == "Divide":
        kinds, at = (_kind(node.left()), _kind(node.right())), node.origin()
        own = at.sqlText().isDefined() and at.sqlText().get() == text
        if own and all(k in _WHOLE for k in kinds) and at.startIndex().isDefined() and at.stopIndex().isDefined():
            out.append((at.startIndex().get(), at.stopIndex().get(), max(kinds, key=_WHOLE.index)))
    for name in ("expressions", "children", "innerChildren"):
        if name in methods:
            for x in _items(getattr(node, name)()):
                _divisions(x, text, out)
    if "plan" in methods and "exprId" in methods:  # a subquery
        _divisions(node.plan(), text, out)


def _slash(text: str, first: int, last: int) -> int:
    """Where the last division sign outside parentheses stands: division groups to the left."""
    at, depth, found = first, 0, -1
    for t in tokens(text[first : last + 1]):
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(t, 0)
        if t == "/" and depth == 0:
            found = at
        at += len(t)
    return found


def run(spark: SparkSession, text: str, args: dict | list | None = None) -> DataFrame:
    df = spark.sql(text, args=args)
    while "/" in tokens(text):
        found: list[tuple[int, int, str]] = []
        _divisions(df._jdf.queryExecution().analyzed(), text, found)
        found = [f for f in found if _slash(text, *f[:2]) > 0]
        if not found:
            break
        first, last, kind = min(found, key=lambda f: f[1] - f[0])
        at = _slash(text, first, last)
        text = f"{text[:first]}CAST(({text[first:at]}) div ({text[at + 1 : last + 1]}) AS {kind}){text[last + 1 :]}"
        df = spark.sql(text, args=args)
    return df
