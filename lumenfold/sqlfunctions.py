"""Function calls and table functions in SQL text, in the source dialect, written out as Spark SQL.

``expand`` replaces calls by templates, innermost first, so arguments keep their types and Catalyst sees plain built-in
expressions.  What no built-in expresses (geometry, escapes, full JSON paths, text distances) becomes a call of ``lf_name``,
which ``provide`` registers as a UDF over Arrow batches when a text uses it.  Functions of the session become literals.
``expand_tables`` turns TEXTTABLE, JSONTABLE, XMLTABLE and ARRAYTABLE in FROM into lateral calls of table functions that it
registers for the clause at hand.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import json as js
from .functions import quality, strings
from .functions.conversion import TYPES
from .functions.dates import UNITS
from .functions.geo import GEO, batched
from .functions.math import number_pattern
from .operators import tables as tf
from .sqltext import closing, literal, solid, split, tokens, unquoted, word

_JSON = "to_json(named_struct('v', {}), map('ignoreNullFields', 'false'))"
_PIECE = f"substring({_JSON}, 6, length({_JSON}) - 6)"
_XML = "replace(replace(replace(CAST({} AS STRING), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_FIRST = "(CASE WHEN ({1}) < 0 THEN length({0}) + ({1}) + 1 WHEN ({1}) = 0 THEN 1 ELSE ({1}) END)"
_CHARS = "filter(split({}, ''), c -> c <> '')"
_DIGITS = "regexp_replace({0}, '[ -]', '')"
def _escaped(pattern: str) -> str:
    return literal(pattern).replace("{", "{{").replace("}", "}}")


_EPOCH = "unix_micros(CAST({} AS TIMESTAMP))"

#: (name, number of arguments): the Spark form.
CALLS = {
    ("ascii", 1): "(CASE WHEN length({0}) > 0 THEN ascii({0}) END)",
    ("concat2", 2): "(CASE WHEN ({0}) IS NULL AND ({1}) IS NULL THEN NULL ELSE concat(coalesce({0}, ''), coalesce({1}, '')) END)",
    ("endswith", 2): "endswith({1}, {0})",
    ("insert", 4): "(CASE WHEN ({1}) BETWEEN 1 AND length({0}) + 1 THEN overlay({0} PLACING {3} FROM {1} FOR {2}) WHEN ({0}) IS NOT NULL THEN raise_error('insert: start is out of range') END)",
    ("left", 2): "(CASE WHEN ({1}) < 0 THEN raise_error('left: negative count') ELSE `left`({0}, {1}) END)",
    ("right", 2): "(CASE WHEN ({1}) < 0 THEN raise_error('right: negative count') ELSE `right`({0}, {1}) END)",
    ("locate", 3): "locate({0}, {1}, greatest({2}, 1))",
    ("substring", 2): f"(CASE WHEN {_FIRST} BETWEEN 1 AND length({{0}}) THEN substr({{0}}, {_FIRST}) END)",
    ("substring", 3): f"(CASE WHEN {_FIRST} BETWEEN 1 AND length({{0}}) AND ({{2}}) >= 0 THEN substr({{0}}, {_FIRST}, {{2}}) END)",
    ("dayname", 1): "date_format({0}, 'EEEE')",
    ("monthname", 1): "date_format({0}, 'MMMM')",
    ("week", 1): "weekofyear({0})",
    ("curdate", 0): "current_date()",
    ("curtime", 0): "date_format(current_timestamp(), 'HH:mm:ss')",
    ("current_time", 0): "date_format(current_timestamp(), 'HH:mm:ss')",
    ("epoch", 1): f"({_EPOCH.format('{0}')} / 1e6D)",
    ("from_millis", 1): "timestamp_millis({0})",
    ("to_millis", 1): "unix_millis(CAST({0} AS TIMESTAMP))",
    ("timestampcreate", 2): "to_timestamp_ntz(concat(CAST({0} AS STRING), ' ', {1}))",
    ("modifytimezone", 2): "convert_timezone({1}, current_timezone(), CAST({0} AS TIMESTAMP_NTZ))",
    ("modifytimezone", 3): "convert_timezone({2}, {1}, CAST({0} AS TIMESTAMP_NTZ))",
    **{(f"format{k}", 2): "date_format({0}, {1})" for k in ("timestamp", "date", "time")},
    ("parsetimestamp", 2): "to_timestamp_ntz({0}, {1})",
    ("parsedate", 2): "to_date({0}, {1})",
    ("parsetime", 2): "date_format(to_timestamp({0}, {1}), 'HH:mm:ss')",
    **{(f"format{k}", 2): "format_number({0}, {1})" for k in ("integer", "long", "double", "float", "biginteger", "bigdecimal")},
    ("ceiling", 1): "CAST(ceil({0}) AS DOUBLE)",
    ("floor", 1): "CAST(`floor`({0}) AS DOUBLE)",
    ("sign", 1): "CAST(signum({0}) AS INT)",
    ("log", 1): "ln({0})",
    ("bitand", 2): "(({0}) & ({1}))",
    ("bitor", 2): "(({0}) | ({1}))",
    ("bitxor", 2): "(({0}) ^ ({1}))",
    ("bitnot", 1): "(~({0}))",
    ("array_get", 2): "get({0}, ({1}) - 1)",
    ("array_length", 1): "(CASE WHEN ({0}) IS NOT NULL THEN size({0}) END)",
    ("md5", 1): "unhex(`md5`({0}))",
    ("sha1", 1): "unhex(`sha1`({0}))",
    ("sha2_256", 1): "unhex(sha2({0}, 256))",
    ("sha2_512", 1): "unhex(sha2({0}, 512))",
    ("aes_encrypt", 2): "`aes_encrypt`({0}, {1}, 'CBC', 'PKCS')",
    ("aes_decrypt", 2): "`aes_decrypt`({0}, {1}, 'CBC', 'PKCS')",
    ("jsonparse", 2): "(CASE WHEN {1} OR try_parse_json({0}) IS NOT NULL THEN {0} WHEN ({0}) IS NOT NULL THEN raise_error('jsonparse: not JSON') END)",
    ("xmlcomment", 1): "concat('<!--', {0}, '-->')",
    ("xmltext", 1): _XML.format("{0}"),
    ("xpathvalue", 2): "(CASE WHEN xpath_boolean({0}, {1}) THEN xpath_string({0}, {1}) END)",
    ("digit", 1): "regexp_replace({0}, '[^0-9]', '')",
    ("whitespaceindex", 1): "(regexp_instr({0}, '\\\\s') - 1)",
    ("levenshteindistance", 2): "(CASE WHEN greatest(length({0}), length({1})) = 0 THEN 0D ELSE `levenshtein`({0}, {1}) / CAST(nullif(greatest(length({0}), length({1})), 0) AS DOUBLE) END)",
    ("jaccarddistance", 2): f"(CASE WHEN size(array_union({_CHARS.format('{0}')}, {_CHARS.format('{1}')})) = 0 THEN 0D ELSE 1 - size(array_intersect({_CHARS.format('{0}')}, {_CHARS.format('{1}')})) / CAST(nullif(size(array_union({_CHARS.format('{0}')}, {_CHARS.format('{1}')})), 0) AS DOUBLE) END)",
    ("validemail", 1): f"rlike({{0}}, {_escaped(quality.EMAIL)})",
    ("validssn", 1): f"rlike({{0}}, {_escaped(quality.SSN)})",
    ("validphone", 1): f"rlike({{0}}, {_escaped(quality.PHONE)})",
    ("validcreditcard", 1): f"(CASE WHEN rlike({_DIGITS}, '^[0-9]{{{{13,19}}}}$') THEN aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END END), 0, (a, x) -> a + x) % 10 = 0 WHEN ({{0}}) IS NOT NULL THEN FALSE END)",
}


def _named(argument: str) -> tuple[str, str]:
    """``expr AS name``; without a name the expression's last part is it."""
    m = re.fullmatch(r"(?is)\s*(.*?)\s+AS\s+(?:\"([^\"]+)\"|`([^`]+)`|(\w+))\s*", argument)
    if m:
        return m[1], m[2] or m[3] or m[4]
    return argument.strip(), argument.strip().rpartition(".")[2].strip('`"')


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _regexp_replace(args: list[str]) -> str:
    """First match only, unless the flags hold g.  Pattern, replacement and flags must be literals for that."""
    flags = args[3].strip().strip("'") if len(args) == 4 else ""
    literal = re.fullmatch(r"\s*'((?:[^']|'')*)'\s*", args[1]), re.fullmatch(r"\s*'((?:[^']|'')*)'\s*", args[2])
    mode = "".join(f for f in "im" if f in flags)
    prefix = f"(?{mode})" if mode else ""
    if "g" in flags or not all(literal):
        return f"`regexp_replace`({args[0]}, concat('{prefix}', {args[1]}), {args[2]})"
    pattern, new = (m[1].replace("''", "'").replace("\\\\", "\\") for m in literal)
    shift = lambda m: m[1] + str(int(m[2]) + 1)
    own = prefix + r"\A([\s\S]*?)(?:" + re.sub(r"(\\)([1-9])", shift, pattern) + r")([\s\S]*)\z"
    return f"`regexp_replace`({args[0]}, {_quoted(own)}, {_quoted('$1' + re.sub(r'(\$)(\d+)', shift, new) + '$' + str(2 + re.compile(pattern).groups))})"


def _timestampdiff(unit: str, a: str, b: str) -> str:
    """Counts calendar boundaries; weeks begin on Sunday."""
    unit = UNITS[unit.strip().upper()]
    count = {
        "YEAR": "year({0})", "QUARTER": "(year({0}) * 4 + quarter({0}))", "MONTH": "(year({0}) * 12 + month({0}))", "DAY": "datediff({0}, DATE'1970-01-01')",
        "WEEK": "CAST(`floor`(datediff({0}, DATE'1970-01-04') / 7D) AS BIGINT)", "FRAC_SECOND": f"({_EPOCH.format('{0}')} * 1000)",
    } | {u: f"CAST(`floor`({_EPOCH.format('{0}')} / {n}BD) AS BIGINT)" for u, n in (("HOUR", 3_600_000_000), ("MINUTE", 60_000_000), ("SECOND", 1_000_000))}
    return f"CAST({count[unit].format(b)} - {count[unit].format(a)} AS BIGINT)"


def _timestampadd(unit: str, n: str, ts: str) -> str:
    unit = UNITS[unit.strip().upper()]
    return f"timestampadd(MICROSECOND, ({n}) div 1000, {ts})" if unit == "FRAC_SECOND" else f"timestampadd({unit}, {n}, {ts})"


def _encoded(name: str, data: str, encoding: str) -> str:
    """to_chars and to_bytes: HEX, BASE64 or a character set."""
    hexed, based, plain = ("hex", "base64", "decode") if name == "to_chars" else ("unhex", "unbase64", "encode")
    kind = (unquoted(encoding) or "").upper()
    if kind:
        return f"{hexed}({data})" if kind == "HEX" else f"{based}({data})" if kind == "BASE64" else f"`{plain}`({data}, {encoding})"
    other = f"`{plain}`({data}, CASE WHEN upper({encoding}) NOT IN ('HEX', 'BASE64') THEN {encoding} END)"
    return f"(CASE upper({encoding}) WHEN 'HEX' THEN {hexed}({data}) WHEN 'BASE64' THEN {based}({data}) ELSE {other} END)"


def _parsed(kind: str, text: str, pattern: str) -> str:
    """A number written by a decimal pattern.  A text that doesn't begin so is an error."""
    plain = unquoted(pattern)
    if plain is None:
        raise ValueError(f"parse{kind} needs a literal pattern")
    how = number_pattern(plain)
    digits = r"[0-9,]*" if how.grouped else r"[0-9]*"
    number = rf"({digits}(?:\.[0-9]*)?(?:E-?[0-9]+)?)"
    escaped = lambda t: re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", t)

    def sign(prefix: str, suffix: str, factor: str) -> str:
        found = f"replace(regexp_extract({text}, {literal('^' + escaped(prefix) + number + escaped(suffix))}, 1), ',', '')"
        return f"(CASE WHEN {found} <> '' THEN {factor}CAST({found} AS DECIMAL(38,18)) / {how.scale}BD END)"

    either = f"coalesce({sign(how.prefix, how.suffix, '')}, {sign(how.minus, how.minus_suffix, '-')})"
    value = f"CAST({either} AS {TYPES[kind]})" if kind in ("double", "float", "bigdecimal") else f"CAST(`floor`(abs({either})) * sign({either}) AS {TYPES[kind]})"
    return f"(CASE WHEN ({text}) IS NULL THEN NULL WHEN {either} IS NULL THEN raise_error('parse{kind}: the text does not fit the pattern') ELSE {value} END)"


def _point(argument: str, make: str = "lf_st_point", size: int = 2) -> list[str] | None:
    """The coordinates of a point (or box) that is made in the call."""
    ts = tokens(argument.strip())
    if len(ts) > 2 and ts[0] == make and ts[1] == "(" and closing(ts, 1) == len(ts) - 1:
        parts = split(ts[2:-1])
        return [f"CAST({p} AS DOUBLE)" for p in parts[:size]] if len(parts) == size else None
    return None


def _geometry(name: str, args: list[str]) -> str:
    """Plain arithmetic where both geometries are made in the call, else the UDF."""
    if name in ("st_x", "st_y") and (p := _point(args[0])):
        return p[name == "st_y"]
    if name == "st_distance" and (p := _point(args[0])) and (q := _point(args[1])):
        return f"hypot({q[0]} - {p[0]}, {q[1]} - {p[1]})"
    if name == "st_dwithin" and (p := _point(args[0])) and (q := _point(args[1])):
        return f"(hypot({q[0]} - {p[0]}, {q[1]} - {p[1]}) <= {args[2]})"
    box, dot = (args[1], args[0]) if name == "st_within" else (args[0], args[-1])
    if name in ("st_contains", "st_within") and (p := _point(dot)) and (b := _point(box, "lf_st_makeenvelope", 4)):
        return f"({p[0]} > {b[0]} AND {p[0]} < {b[2]} AND {p[1]} > {b[1]} AND {p[1]} < {b[3]})"
    if name == "st_relate" and len(args) == 3:
        name = "st_fits"
    if name == "st_extent":
        return "lf_st_makeenvelope(" + ", ".join(f"{f}(lf_{n}({args[0]}))" for f, n in (("min", "st_xmin"), ("min", "st_ymin"), ("max", "st_xmax"), ("max", "st_ymax"))) + ")"
    return f"lf_{name}({', '.join(args)})"


def _query_string(args: list[str]) -> str:
    """path?name=value&...: null values are left out."""
    code = "replace(url_encode(CAST({} AS STRING)), '+', '%20')"
    parts = ", ".join(f"concat({code.format(literal(n))}, '=', {code.format(e)})" for e, n in map(_named, args[1:]))
    if not parts:
        return args[0]
    return f"concat({args[0]}, CASE WHEN concat_ws('&', {parts}) <> '' THEN '?' ELSE '' END, concat_ws('&', {parts}))"


def _lookup(table: str, returns: str, key: str, value: str) -> str:
    table, returns, key = (unquoted(a) or a.strip() for a in (table, returns, key))
    return f"(SELECT max(lf_v) FROM (SELECT {key} AS lf_k, {returns} AS lf_v FROM {table}) WHERE lf_k = ({value}))"


def _text_agg(body: str) -> str:
    """TEXTAGG([FOR] a [AS n], ... [DELIMITER c] [QUOTE c | NO QUOTE] [HEADER] [ENCODING e] [ORDER BY ...])."""
    ts = tokens(body)
    depth, cut = 0, len(ts)
    for i, t in enumerate(ts):
        depth += {"(": 1, ")": -1}.get(t, 0)
        if depth == 0 and t.upper() in ("DELIMITER", "QUOTE", "NO", "HEADER", "ENCODING", "ORDER"):
            cut = i
            break
    head, tail = re.sub(r"(?i)^\s*FOR\s+", "", "".join(ts[:cut])), "".join(ts[cut:])
    pairs = [_named(a) for a in split(tokens(head))]
    option = lambda pattern: re.search(pattern, tail, re.IGNORECASE)
    delimiter = m[1] if (m := option(r"DELIMITER\s+'(.)'")) else ","
    quote = None if option(r"\bNO\s+QUOTE\b") else m[1] if (m := option(r"(?<!NO )QUOTE\s+'(.)'")) else '"'
    encoding = m[1] if (m := option(r"ENCODING\s+\"?([\w-]+)\"?")) else "UTF-8"
    cell = lambda e: f"coalesce(CAST({e} AS STRING), '')" if quote is None else f"(CASE WHEN ({e}) IS NULL THEN '' ELSE concat({literal(quote)}, replace(CAST({e} AS STRING), {literal(quote)}, {literal(quote * 2)}), {literal(quote)}) END)"
    line = f"concat_ws({literal(delimiter)}, {', '.join(cell(e) for e, _ in pairs)})"
    rows = _ordered("xmlagg", [f"concat({line}, char(10)){' ' + m[0] if (m := option(r'ORDER[ ]+BY.*')) else ''}"])
    mark = quote or ""
    names = literal(delimiter.join(f"{mark}{n}{mark}" for _, n in pairs)) + ", char(10)" if option(r"\bHEADER\b") else "''"
    return f"`encode`(concat({names}, {rows}), '{encoding}')"


def _json_path(name: str, args: list[str]) -> str | None:
    """Plain definite paths that may lead nowhere are built-in; others take the whole path language."""
    path = unquoted(args[1])
    if name == "jsonpathvalue" and path and js._PLAIN.fullmatch(path) and len(args) == 3 and args[2].strip().lower() == "true":
        return f"get_json_object({args[0]}, {args[1]})"
    return f"lf_{name}({', '.join(args)})"


def _call(name: str, args: list[str]) -> str | None:
    if (name, len(args)) in CALLS:
        return CALLS[name, len(args)].format(*(a.strip() for a in args))
    if name in GEO or name == "st_extent":
        return _geometry(name, [a.strip() for a in args])
    if name in ("to_chars", "to_bytes") and len(args) in (2, 3):
        return _encoded(name, *args[:2])
    if name.startswith("parse") and name[5:] in ("integer", "long", "double", "float", "biginteger", "bigdecimal") and len(args) == 2:
        return _parsed(name[5:], *args)
    if name in ("jsonpathvalue", "jsonquery") and len(args) in (2, 3):
        return _json_path(name, args)
    if name == "tokenize" and len(args) == 2:
        mark = unquoted(args[1])
        if mark is None or len(mark) != 1:
            raise ValueError("tokenize needs one literal character")
        parts = f"split(replace({args[0]}, {literal(mark * 2)}, char(0)), {literal(re.escape(mark))})"
        return f"transform(filter({parts}, x -> x <> ''), x -> replace(x, char(0), {literal(mark)}))"
    if name == "lookup" and len(args) == 4:
        return _lookup(*args)
    if name == "querystring" and args:
        return _query_string(args)
    if name in ("curtime", "current_time") and len(args) == 1 and args[0].strip().isdigit():
        return f"date_format(current_timestamp(), 'HH:mm:ss{'.' + 'S' * int(args[0]) if int(args[0]) else ''}')"
    if name == "current_timestamp" and len(args) == 1 and args[0].strip().isdigit():
        return f"to_timestamp(date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss{'.' + 'S' * int(args[0]) if int(args[0]) else ''}'))"
    if name == "any" and len(args) == 1 and not re.match(r"(?i)\s*(SELECT|WITH)\b", args[0]):
        return f"some({args[0]})"
    if name in UDFS:
        return f"lf_{name}({', '.join(args)})"
    if name == "convert" and len(args) == 2 and args[1].strip().lower() in TYPES:
        kind = args[1].strip().lower()
        return f"`left`(CAST({args[0]} AS STRING), 1)" if kind == "char" else f"CAST({args[0]} AS {TYPES[kind]})"
    if name == "regexp_replace" and len(args) in (3, 4):
        return _regexp_replace(args)
    if name in ("timestampdiff", "timestampadd") and len(args) == 3 and args[0].strip().upper() in UNITS and args[0].strip().upper().startswith("SQL_TSI"):
        return (_timestampdiff if name.endswith("diff") else _timestampadd)(*args)
    if name == "jsonarray":
        return f"concat('[', concat_ws(',', {', '.join(_PIECE.format(a, a) for a in args)}), ']')" if args else "'[]'"
    if name == "jsonobject":
        pairs = [_named(a) for a in args]
        return f"to_json(named_struct({', '.join(f'{_quoted(n)}, {e}' for e, n in pairs)}), map('ignoreNullFields', 'false'))"
    if name == "xmlforest":
        pairs = [_named(a) for a in args]
        body = "concat_ws('', " + ", ".join(f"concat('<{n}>', {_XML.format(e)}, '</{n}>')" for e, n in pairs) + ")"
        return f"(CASE WHEN {' OR '.join(f'({e}) IS NOT NULL' for e, _ in pairs)} THEN {body} END)"
    if name == "xmlconcat":
        return f"(CASE WHEN {' OR '.join(f'({a}) IS NOT NULL' for a in args)} THEN concat_ws('', {', '.join(args)}) END)"
    if name in ("xmlserialize", "xmlparse") and len(args) == 1:
        m = re.fullmatch(r"(?is)\s*(?:(DOCUMENT|CONTENT)\s+)?(.*?)(\s+WELLFORMED)?(?:\s+AS\s+(\w+))?(?:\s+ENCODING\s+\"?[\w-]+\"?)?(?:\s+VERSION\s+'[^']*')?(?:\s+(INCLUDING|EXCLUDING)\s+XMLDECLARATION)?\s*", args[0])
        if name == "xmlparse":  # reading the whole text by a path fails on what isn't XML
            whole = m[2] if (m[1] or "DOCUMENT").upper() == "DOCUMENT" else f"concat('<x>', {m[2]}, '</x>')"
            return m[2] if m[3] else f"(CASE WHEN ({m[2]}) IS NULL OR xpath_boolean({whole}, 'true()') THEN {m[2]} END)"
        declared = f"concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?>', {m[2]})" if (m[5] or "").upper() == "INCLUDING" else m[2]
        return f"CAST({declared} AS {TYPES.get((m[4] or 'string').lower(), 'string')})"
    if name in ("xmlquery", "xmlexists") and (m := re.fullmatch(r"(?is)\s*('(?:[^']|'')*')\s+PASSING\s+(.*?)(?:\s+(?:NULL|EMPTY)\s+ON\s+EMPTY)?\s*", ",".join(args))):
        return f"{'xpath' if name == 'xmlquery' else 'xpath_boolean'}({m[2]}, {m[1]})"
    if name == "xmlcast" and (m := re.fullmatch(r"(?is)\s*(.*)\s+AS\s+(\w+)\s*", args[0])):
        return f"CAST(xpath_string({m[1]}, '/*') AS {TYPES.get(m[2].lower(), m[2])})"
    if name == "xmlpi":
        target = re.sub(r"(?i)^\s*NAME\s+", "", args[0]).strip().strip("\"'`")
        return f"concat('<?{target} ', {args[1]}, '?>')" if len(args) > 1 else f"'<?{target}?>'"
    if name == "xmlelement":
        target, rest, head = re.sub(r"(?i)^\s*NAME\s+", "", args[0]).strip().strip("\"'`"), args[1:], "''"
        if rest and (m := re.fullmatch(r"(?is)\s*XMLATTRIBUTES\s*\((.*)\)\s*", rest[0])):
            pairs = [_named(a) for a in split(tokens(m[1]))]
            parts = [f"""concat(' {n}="', replace({_XML.format(e)}, '"', '&quot;'), '"')""" for e, n in pairs]
            head, rest = f"concat_ws('', {', '.join(parts)})", rest[1:]
        inner = [a if re.match(r"(?i)\s*(concat\('<|concat_ws\(''|\(CASE WHEN [^']* THEN concat_ws\('')", a) else _XML.format(a) for a in rest]
        return f"concat('<{target}', {head}, '>', concat_ws('', {', '.join(inner)}), '</{target}>')" if inner else f"concat('<{target}', {head}, '/>')"
    return None


def _ordered(name: str, args: list[str]) -> str | None:
    """array_agg, string_agg, jsonarray_agg and xmlagg with ORDER BY inside."""
    if name == "string_agg":
        m = re.fullmatch(r"(?is)(.*?)\s+ORDER\s+BY\s+(.*)", ",".join(args[1:]))
        return f"listagg({args[0]}, {m[1]}) WITHIN GROUP (ORDER BY {m[2]})" if m else None
    m = re.fullmatch(r"(?is)(.*?)\s+ORDER\s+BY\s+(.*)", ",".join(args))
    if name not in ("array_agg", "jsonarray_agg", "xmlagg") or len(args) > 1 and not m:
        return None
    value, keys = (m[1], split(tokens(m[2]))) if m else (args[0], [])
    compare = []
    for k, key in enumerate(keys):
        falling = re.search(r"(?i)\s+DESC\b", key)
        low, high = (f"l.k{k}", f"r.k{k}") if not falling else (f"r.k{k}", f"l.k{k}")
        compare.append(f"WHEN {low} IS NULL AND {high} IS NOT NULL OR {low} < {high} THEN -1 WHEN {high} IS NULL AND {low} IS NOT NULL OR {low} > {high} THEN 1")
    fields = ", ".join([*(f"'k{k}', {re.sub(r'(?i)\s+(ASC|DESC)\b', '', key)}" for k, key in enumerate(keys)), f"'v', {value}"])
    rows = f"collect_list(named_struct({fields}))"
    rows = f"array_sort({rows}, (l, r) -> CASE {' '.join(compare)} ELSE 0 END)" if keys else rows
    values = f"transform({rows}, x -> x.v)"
    if name == "jsonarray_agg":
        return f"to_json(filter({values}, x -> x IS NOT NULL))"
    return f"array_join({values}, '')" if name == "xmlagg" else f"(CASE WHEN count(1) > 0 THEN {values} END)"


def expand(text: str, context: object = None) -> str:
    """``context``: its ``value_of(name, args)`` gives the values of functions of the session."""
    ts = tokens(text)
    i = len(ts) - 1
    while i >= 0:  # from the right, so that arguments come before the call around them
        name = ts[i].lower()
        at = solid(ts, i + 1, 1)
        before = word(ts, solid(ts, i - 1, -1))
        if re.fullmatch(r"[a-z_]\w*", name) and at < len(ts) and ts[at] == "(" and before not in (".", "FUNCTION", "JOIN"):
            end = closing(ts, at)
            inner = ts[at + 1 : end]
            args = split(inner) if "".join(inner).strip() else []
            new = _text_agg("".join(inner)) if name == "textagg" else (_ordered(name, args) if args else None) or _call(name, args)
            if new is None and context is not None:
                plain = [unquoted(a) if unquoted(a) is not None else a.strip() for a in args]
                value = context.value_of(name, plain)
                new = None if value is NotImplemented else literal(value)
            if new is not None:
                ts[i : end + 1] = [new]
        elif name in ("curdate", "curtime", "current_time") and (at >= len(ts) or ts[at] != "("):
            ts[i] = CALLS[name, 0]
        i -= 1
    return "".join(ts)


def _each(f: Callable, returns: str) -> Callable:
    """A UDF of rows; any null gives null.  Equal arguments within a batch are taken once."""

    def make():
        @F.pandas_udf(returns)
        def run(*series: pd.Series) -> pd.Series:
            seen, out = {}, []
            for row in zip(*series):
                if row not in seen:
                    seen[row] = None if any(v is None or v != v for v in row) else f(*row)
                out.append(seen[row])
            return pd.Series(out, dtype=object)

        return run

    return make


#: Name: what makes the UDF.
UDFS: dict[str, Callable] = {
    "unescape": _each(strings.unescape_text, "string"),
    "cosinedistance": _each(quality.cosine, "double"),
    "jarowinklerdistance": _each(lambda a, b: 1 - quality.jaro_winkler(a, b), "double"),
    "jsonpathvalue": _each(lambda doc, path, leaf=False: js.path_value(doc, path, bool(leaf)), "string"),
    "jsonquery": _each(lambda doc, path, leaf=False: js.path_value(doc, path, bool(leaf), True), "string"),
    "jsontoxml": _each(lambda root, doc: js.to_xml(root, doc if isinstance(doc, str) else bytes(doc).decode()), "string"),
    "jsontoarray": _each(js.json_to_array, "array<array<string>>"),
} | {name: (lambda geo=geo: batched(geo)) for name, geo in GEO.items()}


def _random(s: pd.Series) -> pd.Series:
    return s.map(lambda t: "".join(random.sample(t, len(t))), na_action="ignore")


UDFS["random"] = lambda: F.pandas_udf(_random, "string").asNondeterministic()


def provide(spark: SparkSession, text: str) -> None:
    """Registers the UDFs that the text calls."""
    for name in {m[1] for t in tokens(text) if (m := re.fullmatch(r"lf_(\w+)", t))} | set(re.findall(r"\blf_(\w+)\(", text)):
        if name in UDFS:
            spark.udf.register(f"lf_{name}", UDFS[name]())


def _columns(parts: list[str]) -> list[tuple]:
    """COLUMNS items: name type [options] or name FOR ORDINALITY."""
    out = []
    for part in parts:
        if m := re.fullmatch(r"(?is)\s*(\w+)\s+FOR\s+ORDINALITY\s*", part):
            out.append((m[1], "ordinality"))
            continue
        m = re.fullmatch(r"(?is)\s*(\w+)\s+(\w+(?:\[\])?)(?:\s*\(\d+\))?(.*)", part)
        if not m:
            raise ValueError(f"can't read the column {part.strip()}")
        options, rest = {}, m[3]
        for key, pattern in (("width", r"WIDTH\s+(\d+)"), ("path", r"PATH\s+'((?:[^']|'')*)'"), ("header", r"HEADER\s+'([^']*)'"), ("default", r"DEFAULT\s+('(?:[^']|'')*'|\S+)")):
            if found := re.search(pattern, rest, re.IGNORECASE):
                options[key] = int(found[1]) if key == "width" else found[1].strip("'").replace("''", "'")
        if re.search(r"NO\s+TRIM", rest, re.IGNORECASE):
            options["no_trim"] = True
        if found := re.search(r"SELECTOR\s+'([^']*)'\s+(\d+)", rest, re.IGNORECASE):
            options |= {"selector": found[1], "position": int(found[2])}
        out.append((m[1], m[2].lower(), options))
    return out


def _clause(kind: str, body: str) -> tuple[str, list[tuple], object]:
    """(argument, columns, function from the argument to rows)."""
    head, _, rest = re.split(r"(?i)\b(COLUMNS)\b", body, maxsplit=1)
    if kind == "TEXTTABLE":
        tail = re.search(r"(?is)\s+(?=(?:NO\s+)?ROW\s+DELIMITER|(?<!ROW\s)DELIMITER\s|QUOTE\s|ESCAPE\s|HEADER\s*(?:\d|$)|SKIP\s)", rest)
        options = rest[tail.end() :] if tail else ""
        columns = _columns(split(tokens(rest[: tail.start()] if tail else rest)))
        how: dict = {}
        for key, pattern in (("delimiter", r"(?<!ROW )\bDELIMITER\s+'(.)'"), ("row_delimiter", r"ROW\s+DELIMITER\s+'(.)'"), ("quote", r"QUOTE\s+'(.)'"), ("escape", r"ESCAPE\s+'(.)'")):
            if m := re.search(pattern, options, re.IGNORECASE):
                how[key] = m[1]
        if "escape" in how:
            how["quote"] = None
        if re.search(r"NO\s+ROW\s+DELIMITER", options, re.IGNORECASE):
            how["row_delimiter"] = None
        if m := re.search(r"HEADER(?:\s+(\d+))?", options, re.IGNORECASE):
            how["header"] = int(m[1] or 1)
        if m := re.search(r"SKIP\s+(\d+)", options, re.IGNORECASE):
            how["skip"] = int(m[1])
        if m := re.search(r"(?is)(.*)\s+SELECTOR\s+'([^']*)'\s*$", head):
            head, how["selector"] = m[1], m[2]
        return head.strip(), columns, lambda text: tf.text_rows(text, columns, **how)
    columns = _columns(split(tokens(rest)))
    if kind == "JSONTABLE":
        argument, path, *leaf = split(tokens(head))
        row_path, null_leaf = path.strip().strip("'"), not leaf or leaf[0].strip().lower() != "false"
        return argument, columns, lambda doc: tf.json_rows(doc, row_path, columns, null_leaf)
    m = re.fullmatch(r"(?is)\s*'((?:[^']|'')*)'\s+PASSING\s+(.*?)\s*", head)
    if not m:
        raise ValueError("XMLTABLE needs 'path' PASSING value COLUMNS ...")
    row_path = m[1]
    return m[2], columns, lambda doc: tf.xml_rows(doc, row_path, columns)


def expand_tables(spark: SparkSession, text: str) -> str:
    ts = tokens(text)
    i = 0
    while i < len(ts):
        kind = ts[i].upper()
        at = solid(ts, i + 1, 1)
        if kind in ("TEXTTABLE", "JSONTABLE", "XMLTABLE") and at < len(ts) and ts[at] == "(":
            end = closing(ts, at)
            body = "".join(ts[at + 1 : end])
            argument, columns, rows = _clause(kind, body)
            name = f"lf_{kind.lower()}_{hashlib.md5(body.encode()).hexdigest()[:12]}"
            schema = ", ".join(f"{c[0]} string" for c in columns)
            spark.udtf.register(name, F.udtf(type(name, (), {"eval": lambda self, value, rows=rows: (tuple(None if v is None else str(v) for v in r) for r in (rows(value) if value is not None else ()))}), returnType=schema))
            casts = ", ".join(f"CAST({c[0]} AS {'int' if c[1] == 'ordinality' else TYPES.get(c[1], c[1])}) AS {c[0]}" for c in columns)
            ts[i : end + 1] = [f"LATERAL (SELECT {casts} FROM {name}({argument}))"]
        elif kind == "ARRAYTABLE" and at < len(ts) and ts[at] == "(":
            end = closing(ts, at)
            head, _, rest = re.split(r"(?i)\b(COLUMNS)\b", "".join(ts[at + 1 : end]), maxsplit=1)
            columns, many = _columns(split(tokens(rest))), re.match(r"(?is)\s*ROWS\s+(.*)", head)
            argument = re.sub(r"(?is)^\s*ROWS?\s+", "", head).strip()
            casts = ", ".join(f"CAST(try_element_at(r, {k}) AS {TYPES.get(c[1], c[1])}) AS {c[0]}" for k, c in enumerate(columns, 1))
            ts[i : end + 1] = [f"LATERAL (SELECT {casts} FROM explode({argument if many else f'array({argument})'}) AS x(r))"]
        i += 1
    return "".join(ts)
