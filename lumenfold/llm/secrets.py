"""Secret scan with a recursive decoding worklist.

Three kinds are looked for in a text: assignments to telling names, access keys, and long runs of hex digits.  Then each
layer is unwrapped into new layers: percent escapes and Unicode or character escapes over the whole layer, and every
base64 run (plain or URL-safe, wrapped lines joined, from each of four phases) into bytes.  Bytes are read as UTF-8, else
as Latin-1, and as UTF-16 too if any is zero; gzip, zlib, bzip2 and xz streams that begin anywhere in them, or in bytes
from percent escapes, are inflated, all members.  New layers join a worklist until none is left; a layer whose text was seen before in the document is not taken again, which also ends
cycles.  Every layer maps each of its characters to a range of the whole text, so a finding at any depth has a span there.

Cases: a null text counts as empty; spans are code points, end exclusive; equal spans of one kind count once; ``budget``
bounds the characters that wait, not what is read: later layers are unwrapped at once, and a stream that inflates to more
is read in overlapping windows.  Then, and if a stream breaks off, ``complete`` is false.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import urllib.parse
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t>]*[A-Za-z0-9+/_-]{2,})*={0,2}")
_IN64 = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", np.uint8))
_PLAIN = bytes.maketrans(b"-_", b"+/")
_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2}|[!-$&-~])+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00")
_FORMATS = (("gzip", b"\x1f\x8b", lambda: zlib.decompressobj(31)), ("zlib", b"x", zlib.decompressobj), ("bzip2", b"BZh", bz2.BZ2Decompressor), ("xz", b"\xfd", lambda: lzma.LZMADecompressor(memlimit=256 << 20)))
WINDOW, OVERLAP = 1 << 20, 1 << 16
_LOW = bytes(range(256)).lower()


def scan(text: str) -> list[tuple[str, int, int]]:
    """Base findings (kind, start, end), leftmost and not overlapping within a kind."""
    out = []
    low = text.encode("utf-8", "surrogatepass").translate(_LOW)
    if any(n in low for n in _NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A text, and for each of its characters the range of the whole text that it stands for (None: itself)."""

    def __init__(self, text: str, low: np.ndarray | None = None, high: np.ndarray | None = None, path: tuple[str, ...] = ()):
        self.text, self.low, self.high, self.path = text, low, high, path

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.low is None else (int(self.low[start]), int(self.high[start:end].max()))

    def child(self, text: str, start: np.ndarray, end: np.ndarray, how: str) -> Layer:
        """start, end: for each character of the new text, its range in this one."""
        if self.low is None:
            return Layer(text, start, end, (*self.path, how))
        return Layer(text, self.low[start], self.high[end - 1], (*self.path, how))


def _character(escape: str) -> str:
    if escape[:2] == "\\u" and len(escape) == 12:
        return bytes.fromhex(escape[2:6] + escape[8:]).decode("utf-16-be")
    code = int(escape[3:-1], 16) if escape[1] == "u" and escape[2] == "{" else int(escape[2:], 16) if escape[0] == "\\" else int(escape[3:-1], 16) if escape[2] in "xX" else int(escape[2:-1])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _replaced(layer: Layer, pattern: re.Pattern, decode, how: str) -> Layer | None:
    """The whole layer with each match of the pattern decoded: ``decode`` gives [(characters, source length)]."""
    text, parts, start, end, at = layer.text, [], [], [], 0
    for m in pattern.finditer(text):
        parts.append(text[at : m.start()])
        start.append(np.arange(at, m.start()))
        end.append(start[-1] + 1)
        place = m.start()
        for chars, n in decode(m[0]):
            parts.append(chars)
            start.append(np.full(len(chars), place))
            end.append(np.full(len(chars), place + n))
            place += n
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    start.append(np.arange(at, len(text)))
    end.append(start[-1] + 1)
    return layer.child("".join(parts), np.concatenate(start), np.concatenate(end), how)


def _percent(run: str) -> list[tuple[str, int]]:
    data, out, at = bytes.fromhex(run.replace("%", "")), [], 0
    while at < len(data):
        n = 1 if data[at] < 0x80 else 2 if data[at] >> 5 == 6 else 3 if data[at] >> 4 == 14 else 4 if data[at] >> 3 == 30 else 1
        try:
            out.append((data[at : at + n].decode(), 3 * len(data[at : at + n])))
        except UnicodeDecodeError:
            n = 1
            out.append((chr(data[at]), 3))
        at += n
    return out


def _inflated(data: bytes, new: Callable, state: dict) -> Iterator[bytes]:
    """What all members of a compressed stream hold, piece by piece.  ``state`` says if it ended and if it failed."""
    reader = None
    for at in range(0, len(data), 4096):
        part = data[at : at + 4096]
        while part:
            if reader is None or reader.eof:
                if reader is not None and not (part := part.lstrip(b"\0")):
                    break
                state["members"] = state.get("members", -1) + 1
                reader = new()
            try:
                out = reader.decompress(part)
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                state["failed"] = not state["members"]  # what follows a whole member may be anything
                return
            if out:
                yield out
            part = reader.unused_data if reader.eof else b""
    state["cut"] = reader is not None and not reader.eof


def _texts(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Readings of bytes, with each character's range of bytes: UTF-8, else Latin-1; with zero bytes also UTF-16."""
    if not data:
        return
    try:
        start = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        yield data.decode(), start, np.append(start[1:], len(data))
    except UnicodeDecodeError:
        yield data.decode("latin-1"), np.arange(len(data)), np.arange(1, len(data) + 1)
    if b"\0" in data:
        for first in (0, 1):
            own = data[first : first + (len(data) - first) // 2 * 2]
            for name in ("utf-16-le", "utf-16-be"):
                if own:
                    text = own.decode(name, "surrogatepass")
                    end = first + np.cumsum(np.fromiter((4 if ord(c) > 0xFFFF else 2 for c in text), np.int64, len(text)))
                    yield text, np.append(first, end[:-1]), end


def _opened(layer: Layer, data: bytes, place: Callable, how: str, budget: int, opaque: list, base: bool = True) -> Iterator[Layer]:
    """Layers of the bytes and of the compressed streams in them; ``place`` maps ranges of bytes to ranges of the layer.  A
    stream of more than ``budget`` bytes comes in overlapping windows; the span of one that isn't read as a whole goes to
    ``opaque``."""
    if base:
        for text, start, end in _texts(data):
            yield layer.child(text, *place(start, end), how)
    for m in _MAGIC.finditer(data):
        name, new = next((n, f) for n, magic, f in _FORMATS if m[0].startswith(magic))
        low, high = (int(x[0]) for x in place(np.array([m.start()]), np.array([len(data)])))
        whole = lambda start, end, low=low, high=high: (np.full(len(start), low), np.full(len(end), high))
        state: dict = {}
        held, over = b"", False
        pieces: list[bytes] = []
        size = 0
        for piece in _inflated(data[m.start() :], new, state):
            pieces.append(piece)
            size += len(piece)
            if size > (WINDOW if over else budget):
                over = True
                held = b"".join(pieces)
                for at in range(0, len(held), WINDOW - OVERLAP):
                    yield from _opened(layer, held[at : at + WINDOW], whole, f"{how}>{name}", budget, opaque)
                pieces = [held[-OVERLAP:]]
                size = len(pieces[0])
        held = b"".join(pieces)
        if over or ((state.get("cut") or state.get("failed") and held) and (name != "zlib" or not m.start() and not state.get("failed"))):
            opaque.append(layer.span(low, high))
        if held:
            yield from _opened(layer, held, whole, f"{how}>{name}", budget, opaque)


def _unwrapped(layer: Layer, budget: int, opaque: list) -> Iterator[Layer]:
    text = layer.text
    if "%" in text and (new := _replaced(layer, _PERCENT, _percent, "url")):
        yield new
        for m in _ESCAPED.finditer(text):
            if "%" in m[0]:
                for own in {m[0], m[0].replace("+", "%20")}:
                    if _MAGIC.search(data := urllib.parse.unquote_to_bytes(own)):
                        yield from _opened(layer, data, lambda start, end, m=m: (np.full(len(start), m.start()), np.full(len(end), m.end())), "url", budget, opaque, False)
    if ("\\" in text or "&#" in text) and (new := _replaced(layer, _ESCAPE, lambda e: [(_character(e), len(e))], "unicode")):
        yield new
    for m in _BASE64.finditer(text):
        codes = np.frombuffer(m[0].encode(), np.uint8)
        at = np.flatnonzero(_IN64[codes])
        body, at = codes[at].tobytes().translate(_PLAIN), at + m.start()
        for phase in range(4):
            own = body[phase:]
            own = own[:-1] if len(own) % 4 == 1 else own
            data = binascii.a2b_base64(own + b"=" * (-len(own) % 4))

            def place(start: np.ndarray, end: np.ndarray, phase=phase, size=len(data), at=at, m=m) -> tuple[np.ndarray, np.ndarray]:
                high = at[np.minimum(phase - (-end * 4 // 3), len(at)) - 1] + 1
                return at[phase + start * 4 // 3], np.where(end == size, m.end(), high)  # the padding belongs to the last character

            yield from _opened(layer, data, place, "base64", budget, opaque)


def examined(text: str | None, budget: int = 64 << 20) -> tuple[list[tuple[str, int, int, str]], list[tuple[int, int]]]:
    """(kind, start, end, path) of every layer, sorted by start, kind and end; and the spans of the compressed blobs that
    weren't read as a whole.  The path of a base finding is empty."""
    seen, out, opaque, left = set(), {}, [], budget

    def new_layer(layer: Layer) -> bool:
        mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if mark in seen:
            return False
        seen.add(mark)
        for kind, start, end in scan(layer.text):
            out.setdefault((kind, *layer.span(start, end)), ">".join(layer.path))
        return True

    first = Layer(text or "")
    new_layer(first)
    work, depth = deque([first]), []
    while work or depth:
        if not depth:
            depth.append(_unwrapped(work.popleft(), left, opaque))
        layer = next(depth[-1], None)
        if layer is None:
            depth.pop()
        elif new_layer(layer):
            if len(layer.text) <= left:
                left -= len(layer.text)
                work.append(layer)
            else:  # no room to keep it waiting: unwrap it at once
                depth.append(_unwrapped(layer, left, opaque))
    return sorted(((*k, p) for k, p in out.items()), key=lambda f: (f[1], KINDS.index(f[0]), f[2])), sorted(set(opaque))


def findings(text: str | None, budget: int = 64 << 20) -> tuple[list[tuple[str, int, int, str]], bool]:
    """The findings of ``examined``, and whether every compressed blob was read as a whole."""
    found, opaque = examined(text, budget)
    return found, not opaque


def joined(found: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in found)


def find(docs: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """(doc_id, findings, complete) for each row."""
    each = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, complete = zip(*(findings(t.as_py(), budget) for t in batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("kind", "start", "end", "path"), f)) for f in fs] for fs in found], each), pa.array(complete)], ["doc_id", "findings", "complete"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, findings array<struct<kind: string, start: long, end: long, path: string>>, complete boolean")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of what ``find`` returned; counts are of base findings."""
    base = "filter(findings, f -> f.path = '')"
    text = "array_join(transform({}, f -> concat_ws(':', f.kind, f.start, f.end)), ',')"
    return found.selectExpr("doc_id", *(f"CAST(size(filter(findings, f -> f.path = '' AND f.kind = '{k}')) AS LONG) AS n_{k}" for k in KINDS), f"sha2(CAST({text.format(base)} AS BINARY), 256) AS base_sha256", f"{text.format('findings')} AS spans", "complete")


def redacted(text: str | None, mark: str = "[REDACTED]", budget: int = 64 << 20) -> str | None:
    """The text with every finding's span replaced; overlapping spans give one mark.  A compressed blob that
    wasn't read as a whole is replaced altogether.  Null stays null."""
    if text is None:
        return None
    found, opaque = examined(text, budget)
    spans = sorted([*((start, end) for _, start, end, _ in found), *opaque])
    out, at, reach = [], 0, -1
    for start, end in spans:
        if start >= reach:
            out += [text[at:start], mark]
        reach = at = max(reach, end)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame) -> DataFrame:
    """The documents, with all columns, without their secrets; n_chars, if there, follows the text."""
    where, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            was = batch.column(where).to_pylist()
            now = [redacted(t) for t in was]
            columns = list(batch.columns)
            columns[where] = pa.array(now, batch.schema.field(where).type)
            if count is not None:
                old = batch.column(count).to_pylist()
                columns[count] = pa.array([n if a == b else len(b) for n, a, b in zip(old, was, now)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
