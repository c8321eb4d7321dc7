"""Tokens of SQL text."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\{\w+\}|[A-Za-z_]\w*|\d+(?:\.\d+)?|<>|!=|<=|>=|\|\||.", re.DOTALL)


_NAME = re.compile(r"[A-Za-z_]\w*|`[^`]+`|\"[^\"]+\"")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def solid(ts: list[str], i: int, step: int) -> int:
    """The next token from i that isn't space or comment; -1 or len(ts) at the ends."""
    while 0 <= i < len(ts) and (ts[i].isspace() or ts[i].startswith(("--", "/*"))):
        i += step
    return i


def closing(ts: list[str], i: int) -> int:
    depth = 0
    while i < len(ts):
        depth += {"(": 1, ")": -1}.get(ts[i], 0)
        if depth == 0:
            return i
        i += 1
    raise ValueError("a parenthesis isn't closed")


def word(ts: list[str], i: int) -> str:
    return ts[i].upper() if 0 <= i < len(ts) else ""


def split(ts: list[str]) -> list[str]:
    """Arguments at the top level."""
    out, depth = [""], 0
    for t in ts:
        depth += {"(": 1, ")": -1}.get(t, 0)
        if t == "," and depth == 0:
            out.append("")
        else:
            out[-1] += t
    return out


def chains(ts: list[str]) -> list[tuple[int, list[int], list[str]]]:
    """(first token, last token of each part, parts) of every dotted name; quotes of names are taken off."""
    out, i = [], 0
    while i < len(ts):
        if not _NAME.fullmatch(ts[i]):
            i += 1
            continue
        first, ends, parts = i, [i], [_bare(ts[i])]
        while i + 2 < len(ts) and ts[i + 1] == "." and _NAME.fullmatch(ts[i + 2]):
            i += 2
            ends.append(i)
            parts.append(_bare(ts[i]))
        out.append((first, ends, parts))
        i += 1
    return out


def _bare(name: str) -> str:
    return name[1:-1] if name[0] in '"`' else name


def literal(value: object) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value) if isinstance(value, int) else f"CAST('{value!r}' AS DOUBLE)"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def unquoted(text: str) -> str | None:
    """The text of a string literal, None for anything else."""
    m = re.fullmatch(r"\s*'((?:[^']|'')*)'\s*", text)
    return m and m[1].replace("''", "'")
