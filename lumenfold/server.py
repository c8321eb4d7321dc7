"""A catalog over HTTP: SQL and procedures as JSON, and tables by OData queries.

Routes: POST /sql {"sql": ..., "args": {...}}; GET or POST /call/NAME with parameters; GET /odata/ (the tables),
/odata/$metadata, /odata/TABLE, /odata/TABLE(KEY) and /odata/TABLE/$count with $select, $filter, $orderby, $top, $skip and
$count.  Rows are written as they come, partition by partition.  ``engine_for`` gives the engine of a user, whose catalog has
that user's roles, so policies hold as anywhere; it raises PermissionError for one it doesn't know.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import re
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame

from .engine import Engine
from .sqltext import literal

_ODATA = re.compile(r"\s*('(?:[^']|'')*'|\d+(?:\.\d+)?|[A-Za-z_]\w*|[(),-])")
_OPERATORS = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<=", "and": "AND", "or": "OR", "not": "NOT", "add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%"}
#: OData function: the dialect's call of the same arguments.
_FUNCTIONS = {
    "contains": "(locate({1}, {0}) > 0)", "startswith": "(locate({1}, {0}) = 1)", "endswith": "endswith({1}, {0})", "length": "length({0})", "tolower": "lcase({0})", "toupper": "ucase({0})", "trim": "trim({0})", "concat": "concat({0}, {1})",
    "indexof": "(locate({1}, {0}) - 1)", "substring": "substring({0}, {1} + 1)", "year": "year({0})", "month": "month({0})", "day": "dayofmonth({0})", "hour": "hour({0})", "minute": "minute({0})", "second": "second({0})",
    "round": "round({0})", "floor": "floor({0})", "ceiling": "ceiling({0})",
}


def odata_expression(text: str, columns: list[str]) -> str:
    """An OData expression as SQL.  Names must be columns, and text is quoted anew."""
    ts, at = [], 0
    while at < len(text.rstrip()):
        m = _ODATA.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:][:40]}")
        ts.append(m[1])
        at = m.end()
    known = {c.lower(): c for c in columns}
    place = 0

    def until(stop: tuple[str, ...]) -> str:
        nonlocal place
        out = []
        while place < len(ts) and ts[place] not in stop:
            t = ts[place]
            place += 1
            if t == "(":
                out.append(f"({until((')',))})")
                place += 1
            elif t[0] == "'":
                out.append(literal(t[1:-1].replace("''", "'")))
            elif t[0].isdigit() or t == "-":
                out.append(t)
            elif t.lower() in _FUNCTIONS and place < len(ts) and ts[place] == "(":
                args = []
                while ts[place] != ")":
                    place += 1
                    args.append(until((",", ")")))
                place += 1
                out.append(_FUNCTIONS[t.lower()].format(*args))
            elif t in _OPERATORS:
                if t in ("eq", "ne") and place < len(ts) and ts[place] == "null":
                    place += 1
                    out.append("IS NULL" if t == "eq" else "IS NOT NULL")
                else:
                    out.append(_OPERATORS[t])
            elif t in ("true", "false", "null"):
                out.append(t.upper())
            elif t.lower() in known:
                out.append(f"`{known[t.lower()]}`")
            else:
                raise ValueError(f"{t} isn't a column")
        if place >= len(ts) and stop:
            raise ValueError("a parenthesis isn't closed")
        return " ".join(out)

    return until(())


def odata_query(table: str, columns: list[str], options: dict[str, str]) -> str:
    known = {c.lower(): c for c in columns}

    def name(c: str) -> str:
        if c.strip().lower() not in known:
            raise ValueError(f"{c} isn't a column")
        return f"`{known[c.strip().lower()]}`"

    text = f"SELECT {', '.join(map(name, options['$select'].split(','))) if options.get('$select', '*') != '*' else '*'} FROM {table}"
    if "$filter" in options:
        text += f" WHERE {odata_expression(options['$filter'], columns)}"
    if "$orderby" in options:
        keys = [k.split() for k in options["$orderby"].split(",")]
        text += " ORDER BY " + ", ".join(f"{name(k[0])} {'DESC' if k[1:] == ['desc'] else 'ASC'}" for k in keys)
    if "$top" in options:
        text += f" LIMIT {int(options['$top'])}"
    return text + (f" OFFSET {int(options['$skip'])}" if "$skip" in options else "")


def plain(value: object) -> object:
    """A value as JSON has it."""
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(bytes(value)).decode()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


class Server:
    """Serves in threads of its own from ``start`` to ``stop``; port 0 takes a free one."""

    def __init__(self, engine_for: Engine | Callable[[str | None], Engine], host: str = "127.0.0.1", port: int = 0):
        choose = (lambda user: engine_for) if isinstance(engine_for, Engine) else engine_for

        class Handler(_Handler):
            engine = staticmethod(choose)

        self.http = ThreadingHTTPServer((host, port), Handler)
        self.url = f"http://{host}:{self.http.server_address[1]}"

    def start(self) -> Server:
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.http.shutdown()
        self.http.server_close()


class _Handler(BaseHTTPRequestHandler):
    engine: Callable[[str | None], Engine]

    def log_message(self, *args) -> None:
        pass

    def _user(self) -> str | None:
        kind, _, code = self.headers.get("Authorization", "").partition(" ")
        return base64.b64decode(code).decode().partition(":")[0] if kind == "Basic" else None

    def _send(self, status: int, value: object) -> None:
        body = json.dumps(value).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def _rows(self, df: DataFrame, head: str) -> None:
        """``head`` opens an object whose last member takes the rows."""
        rows = df.toLocalIterator()
        first = next(rows, None)  # an error comes before the status
        self.send_response(200)
        self.send_header("Content-Type", "application/json")
        self.end_headers()
        self.wfile.write(head.encode())
        while first is not None:
            self.wfile.write(json.dumps(plain(first)).encode())
            first = next(rows, None)
            if first is not None:
                self.wfile.write(b",")
        self.wfile.write(b"]}")

    def _answer(self, out: DataFrame | int | None) -> None:
        if isinstance(out, DataFrame):
            self._rows(out, f'{{"columns": {json.dumps(out.columns)}, "rows": [')
        else:
            self._send(200, {"count": out})

    def _handle(self, method: str) -> None:
        url = urlsplit(self.path)
        path, options = unquote(url.path), dict(parse_qsl(url.query, keep_blank_values=True))
        try:
            engine = self.engine(self._user())
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)) if method == "POST" else b""
            if path == "/sql" and method == "POST":
                asked = json.loads(body)
                return self._answer(engine.execute(asked["sql"], asked.get("args")))
            if m := re.fullmatch(r"/call/([\w.]+)", path):
                options |= json.loads(body) if body else {}
                types = {n: t for _, n, t, _ in engine.procedures[m[1].lower()].parameters}
                given = ", ".join(f"{k} => {literal(v)}" for k, v in options.items() if k.lower() in types)
                return self._answer(engine.execute(f"CALL {m[1]}({given})"))
            if method == "GET" and path.startswith("/odata/"):
                return self._odata(engine, path[7:], options)
            self._send(404, {"error": f"nothing at {path}"})
        except PermissionError as error:
            self._send(403, {"error": str(error)})
        except (KeyError, ValueError) as error:
            self._send(400, {"error": str(error)})
        except Exception as error:  # what a query raises
            self._send(500, {"error": str(error).split("\n")[0]})

    def _odata(self, engine: Engine, path: str, options: dict[str, str]) -> None:
        catalog = engine.catalog
        names = {n.lower(): n for n in [*catalog.tables, *catalog.views]}
        if path in ("", "$metadata"):
            shown = {}
            for n in names.values():
                try:
                    shown[n] = dict(catalog._frame(n, ()).dtypes)
                except PermissionError:
                    continue  # the user may not know of it
            return self._send(200, {"value": [{"name": n, "url": n} for n in shown]} if not path else shown)
        m = re.fullmatch(r"([\w.]+)(?:\((.*)\))?(/\$count)?", path)
        if not m or m[1].lower() not in names:
            return self._send(404, {"error": f"no table {path}"})
        name = names[m[1].lower()]
        columns = catalog._frame(name, ()).columns
        if m[2]:
            key = catalog.keys.get(name) or []
            if len(key) != 1:
                raise ValueError(f"{name} has no key of one column")
            options = {**options, "$filter": f"{key[0]} eq {m[2]}"}
        if m[3] or options.get("$count") == "true":
            counted = {k: v for k, v in options.items() if k == "$filter"}
            n = catalog.sql(f"SELECT count(*) AS n FROM ({odata_query(name, columns, counted)}) AS q").first().n
            if m[3]:
                return self._send(200, n)
        head = f'{{"@odata.count": {n}, "value": [' if options.get("$count") == "true" else '{"value": ['
        self._rows(catalog.sql(odata_query(name, columns, options)), head)

    def do_GET(self) -> None:
        self._handle("GET")

    def do_POST(self) -> None:
        self._handle("POST")
