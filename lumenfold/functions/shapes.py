"""Planar geometry in plain Python: text and binary forms, measures and predicates.

A geometry is (kind, coordinates, srid): POINT (x, y); LINESTRING [points]; POLYGON [rings]; MULTI kinds lists of those;
GEOMETRYCOLLECTION a list of geometries.  Empty ones have no coordinates.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")
_GEOJSON = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
EARTH = 6_371_008.8
_TOKEN = re.compile(r"[A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),]")


class Shape(NamedTuple):
    kind: str
    coords: object
    srid: int = 0
    z: float | None = None  # of a point


def from_text(text: str) -> Shape:
    """WKT, or EWKT with SRID=n; before it."""
    srid = 0
    if m := re.match(r"\s*SRID=(\d+);", text, re.IGNORECASE):
        srid, text = int(m[1]), text[m.end() :]
    tokens = _TOKEN.findall(text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ValueError(f"not WKT: {text[:60]}")
    at = 0

    def take(wanted: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or wanted and tokens[at].upper() != wanted:
            raise ValueError(f"not WKT: {text[:60]}")
        at += 1
        return tokens[at - 1]

    height = None

    def point() -> tuple[float, float]:
        nonlocal height
        xy = []
        while at < len(tokens) and tokens[at] not in (",", ")"):
            xy.append(float(take()))
        if not 2 <= len(xy) <= 4:
            raise ValueError(f"not WKT: {text[:60]}")
        height = xy[2] if len(xy) > 2 else None
        return tuple(xy[:2])

    def group(inner) -> list:
        nonlocal at
        take("(")
        out = [inner()]
        while at < len(tokens) and tokens[at] == ",":
            take(",")
            out.append(inner())
        take(")")
        return out

    def single() -> tuple[float, float]:
        return group(point)[0] if tokens[at] == "(" else point()

    def shape() -> Shape:
        nonlocal at
        kind = take().upper()
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        if at < len(tokens) and tokens[at].upper() in ("Z", "M", "ZM"):
            at += 1
        if at < len(tokens) and tokens[at].upper() == "EMPTY":
            at += 1
            return Shape(kind, None if kind == "POINT" else [], srid)
        line = lambda: group(point)
        reader = {"POINT": lambda: group(point)[0], "LINESTRING": line, "POLYGON": lambda: group(line), "MULTIPOINT": lambda: group(single), "MULTILINESTRING": lambda: group(line), "MULTIPOLYGON": lambda: group(lambda: group(line)), "GEOMETRYCOLLECTION": lambda: group(shape)}
        return Shape(kind, reader[kind](), srid, height if kind == "POINT" else None)

    out = shape()
    if at != len(tokens):
        raise ValueError(f"not WKT: {text[:60]}")
    if any(len(r) < 4 or r[0] != r[-1] for s in parts(out) if s.kind == "POLYGON" for r in s.coords):
        raise ValueError("a ring isn't closed")
    return out


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def to_text(g: Shape, extended: bool = False) -> str:
    point = lambda p: f"{_number(p[0])} {_number(p[1])}"
    line = lambda ps: f"({', '.join(map(point, ps))})"
    many = lambda xs, f: f"({', '.join(map(f, xs))})"
    if not g.coords:
        body = f"{g.kind} EMPTY"
    else:
        body = g.kind + " " + {"POINT": lambda c: f"({point(c)})" if g.z is None else f"({point(c)} {_number(g.z)})", "LINESTRING": line, "POLYGON": lambda c: many(c, line), "MULTIPOINT": lambda c: many(c, lambda p: f"({point(p)})"), "MULTILINESTRING": lambda c: many(c, line), "MULTIPOLYGON": lambda c: many(c, lambda p: many(p, line)), "GEOMETRYCOLLECTION": lambda c: many(c, to_text)}[g.kind](g.coords)
    return f"SRID={g.srid};{body}" if extended else body


def to_binary(g: Shape, extended: bool = False, little: bool = True) -> bytes:
    e = "<" if little else ">"
    order = bytes([little])

    def write(kind: str, c: object, srid: int | None) -> bytes:
        height = g.z if kind == "POINT" == g.kind else None
        code = KINDS.index(kind) + 1 | (0x20000000 if srid is not None else 0) | (0x80000000 if height is not None else 0)
        head = order + struct.pack(e + "I", code) + (struct.pack(e + "I", srid) if srid is not None else b"")
        pts = lambda ps: struct.pack(e + "I", len(ps)) + b"".join(struct.pack(e + "dd", *p) for p in ps)
        if kind == "POINT":
            return head + struct.pack(e + "dd", *(c or (math.nan, math.nan))) + (b"" if height is None else struct.pack(e + "d", height))
        if kind == "LINESTRING":
            return head + pts(c)
        if kind == "POLYGON":
            return head + struct.pack(e + "I", len(c)) + b"".join(map(pts, c))
        inner = [write(x.kind, x.coords, None) if kind == "GEOMETRYCOLLECTION" else write(kind[5:], x, None) for x in c]
        return head + struct.pack(e + "I", len(c)) + b"".join(inner)

    return write(g.kind, g.coords, g.srid if extended else None)


def from_binary(data: bytes) -> Shape:
    at = 0

    def read(fmt: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return out

    def shape() -> Shape:
        e = "<" if read("B")[0] else ">"
        (code,) = read(e + "I")
        srid = read(e + "I")[0] if code & 0x20000000 else 0
        kind = KINDS[(code & 0xFFFF) % 1000 - 1]
        each = "d" * (2 + bool(code & 0x80000000 or (code & 0xFFFF) // 1000 in (1, 3)) + bool(code & 0x40000000 or (code & 0xFFFF) // 1000 in (2, 3)))
        points = lambda: [read(e + each)[:2] for _ in range(read(e + "I")[0])]
        if kind == "POINT":
            p = read(e + each)
            return Shape(kind, None if math.isnan(p[0]) else p[:2], srid, p[2] if len(p) > 2 else None)
        if kind == "LINESTRING":
            return Shape(kind, points(), srid)
        if kind == "POLYGON":
            return Shape(kind, [points() for _ in range(read(e + "I")[0])], srid)
        inner = [shape() for _ in range(read(e + "I")[0])]
        return Shape(kind, inner if kind == "GEOMETRYCOLLECTION" else [s.coords for s in inner], srid)

    return shape()


def from_geojson(text: str) -> Shape:
    def read(o: dict) -> Shape:
        kind = KINDS[_GEOJSON.index(o["type"])]
        if kind == "GEOMETRYCOLLECTION":
            return Shape(kind, [read(x) for x in o["geometries"]], 4326)
        deep = lambda c: tuple(c[:2]) if c and not isinstance(c[0], list) else [deep(x) for x in c]
        return Shape(kind, deep(o["coordinates"]), 4326)

    return read(json.loads(text))


def to_geojson(g: Shape) -> str:
    def write(s: Shape) -> dict:
        name = _GEOJSON[KINDS.index(s.kind)]
        return {"type": name, "geometries": [write(x) for x in s.coords]} if s.kind == "GEOMETRYCOLLECTION" else {"type": name, "coordinates": s.coords or []}

    return json.dumps(write(g), separators=(",", ":"))


def parts(g: Shape) -> list[Shape]:
    """Points, lines and polygons."""
    if not g.coords:
        return []
    if g.kind == "GEOMETRYCOLLECTION":
        return [p for x in g.coords for p in parts(x)]
    return [Shape(g.kind[5:], c, g.srid) for c in g.coords] if g.kind.startswith("MULTI") else [g]


def points(g: Shape) -> list[tuple[float, float]]:
    out = []
    for p in parts(g):
        out += [p.coords] if p.kind == "POINT" else p.coords if p.kind == "LINESTRING" else [q for r in p.coords for q in r]
    return out


def segments(g: Shape) -> Iterator[tuple]:
    for p in parts(g):
        for line in [p.coords] if p.kind == "LINESTRING" else p.coords if p.kind == "POLYGON" else []:
            yield from pairwise(line)


def dimension(g: Shape) -> int:
    return max(({"POINT": 0, "LINESTRING": 1, "POLYGON": 2}[p.kind] for p in parts(g)), default=0)


def _signed(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in pairwise(ring)) / 2


def area(g: Shape) -> float:
    return sum(abs(_signed(p.coords[0])) - sum(abs(_signed(r)) for r in p.coords[1:]) for p in parts(g) if p.kind == "POLYGON")


def length(g: Shape) -> float:
    return sum(math.dist(a, b) for p in parts(g) if p.kind == "LINESTRING" for a, b in pairwise(p.coords))


def perimeter(g: Shape) -> float:
    return sum(math.dist(a, b) for p in parts(g) if p.kind == "POLYGON" for r in p.coords for a, b in pairwise(r))


def centroid(g: Shape) -> Shape:
    own = parts(g)
    top = dimension(g)
    x = y = w = 0.0
    for p in own:
        if p.kind == "POLYGON" and top == 2:
            for k, ring in enumerate(p.coords):
                turn = (-1 if k else 1) * (1 if _signed(ring) >= 0 else -1)
                for a, b in pairwise(ring):
                    c = turn * (a[0] * b[1] - b[0] * a[1])
                    x, y, w = x + c * (a[0] + b[0]) / 3, y + c * (a[1] + b[1]) / 3, w + c
        elif p.kind == "LINESTRING" and top == 1:
            for a, b in pairwise(p.coords):
                d = math.dist(a, b)
                x, y, w = x + d * (a[0] + b[0]) / 2, y + d * (a[1] + b[1]) / 2, w + d
        elif p.kind == "POINT" and top == 0:
            x, y, w = x + p.coords[0], y + p.coords[1], w + 1
    return Shape("POINT", (x / w, y / w) if w else None, g.srid)


def box(g: Shape) -> tuple[float, float, float, float] | None:
    ps = points(g)
    return (min(p[0] for p in ps), min(p[1] for p in ps), max(p[0] for p in ps), max(p[1] for p in ps)) if ps else None


def rectangle(x0: float, y0: float, x1: float, y1: float, srid: int = 0) -> Shape:
    return Shape("POLYGON", [[(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]], srid)


def envelope(g: Shape) -> Shape:
    b = box(g)
    if b is None:
        return g
    if b[:2] == b[2:]:
        return Shape("POINT", b[:2], g.srid)
    return Shape("LINESTRING", [b[:2], b[2:]], g.srid) if b[0] == b[2] or b[1] == b[3] else rectangle(*b, g.srid)


def boxes_meet(a: Shape, b: Shape) -> bool:
    p, q = box(a), box(b)
    return bool(p and q) and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]


def convex_hull(g: Shape) -> Shape:
    ps = sorted(set(points(g)))
    if len(ps) < 3:
        return Shape(("POINT", "LINESTRING")[len(ps) - 1], ps[0] if len(ps) == 1 else ps, g.srid) if ps else g
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(ps: list) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(ps) + half(ps[::-1])
    return Shape("POLYGON", [[*hull, hull[0]]], g.srid) if len(hull) > 2 else Shape("LINESTRING", [ps[0], ps[-1]], g.srid)


def _side(a: tuple, b: tuple, p: tuple) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(a: tuple, b: tuple, p: tuple) -> bool:
    return _side(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def place(p: tuple, polygon: list) -> int:
    """1 inside, 0 on the edge, -1 outside."""
    for k, ring in enumerate(polygon):
        inside = False
        for a, b in pairwise(ring):
            if _on(a, b, p):
                return 0
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
        if inside == bool(k):
            return -1
    return 1


def _touch(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    s, t, u, v = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    if ((s > 0) != (t > 0)) and ((u > 0) != (v > 0)) and s and t and u and v:
        return True
    return _on(a, b, c) or _on(a, b, d) or _on(c, d, a) or _on(c, d, b)


def _locate(p: tuple, g: Shape) -> int:
    """Place of a point against a geometry: 1 in its interior, 0 on its boundary, -1 outside."""
    best = -1
    for s in parts(g):
        if s.kind == "POINT":
            best = max(best, 1 if s.coords == p else -1)
        elif s.kind == "LINESTRING":
            if any(_on(a, b, p) for a, b in pairwise(s.coords)):
                best = max(best, 0 if p in (s.coords[0], s.coords[-1]) and s.coords[0] != s.coords[-1] else 1)
        else:
            best = max(best, place(p, s.coords))
    return best


def _probes(g: Shape, other: Shape) -> list[tuple]:
    """Points that tell all of g against other: its vertices, and the middles of its edges between crossings; for areas
    a point inside too."""
    out = points(g)
    cuts = list(segments(other))
    for a, b in segments(g):
        at = {0.0, 1.0}
        for c, d in cuts:
            r, s = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
            den = r[0] * s[1] - r[1] * s[0]
            if den:
                t = ((c[0] - a[0]) * s[1] - (c[1] - a[1]) * s[0]) / den
                if 0 <= t <= 1:
                    at.add(t)
            elif _side(a, b, c) == 0:
                n = r[0] ** 2 + r[1] ** 2
                at |= {t for p in (c, d) if n and 0 <= (t := ((p[0] - a[0]) * r[0] + (p[1] - a[1]) * r[1]) / n) <= 1}
        out += [(a[0] + (b[0] - a[0]) * m, a[1] + (b[1] - a[1]) * m) for s, e in pairwise(sorted(at)) for m in ((s + e) / 2,)]
    return out + [q for s in parts(g) if s.kind == "POLYGON" for q in [interior(s)] if q]


def interior(g: Shape) -> tuple | None:
    """A point inside a polygon: the middle of the widest stretch on a line through it."""
    ys = sorted({p[1] for p in g.coords[0]})
    for lo, hi in sorted(pairwise(ys), key=lambda e: e[0] - e[1]):
        y = (lo + hi) / 2
        xs = sorted(a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) for r in g.coords for a, b in pairwise(r) if (a[1] > y) != (b[1] > y))
        gaps = [(b - a, (a + b) / 2) for a, b in zip(xs[::2], xs[1::2]) if b > a]
        if gaps:
            return max(gaps)[1], y
    return None


def intersects(a: Shape, b: Shape) -> bool:
    if not boxes_meet(a, b):
        return False
    return any(_touch(*s, *t) for s in segments(a) for t in segments(b)) or any(_locate(p, b) >= 0 for p in points(a)) or any(_locate(p, a) >= 0 for p in points(b))


def covers(a: Shape, b: Shape) -> bool:
    ps = _probes(b, a)
    return bool(ps) and all(_near(p, a) >= 0 for p in ps)


def _near(p: tuple, g: Shape) -> int:
    """As _locate, with computed points on an edge taken as on it."""
    at = _locate(p, g)
    if at < 0:
        scale = max(1.0, abs(p[0]), abs(p[1]))
        if any(_point_segment(p, a, b) <= 1e-12 * scale for a, b in segments(g)):
            return 0
    return at


def contains(a: Shape, b: Shape) -> bool:
    return covers(a, b) and any(_locate(p, a) > 0 for p in _probes(b, a))


def within(a: Shape, b: Shape) -> bool:
    return contains(b, a)


def disjoint(a: Shape, b: Shape) -> bool:
    return not intersects(a, b)


def equals(a: Shape, b: Shape) -> bool:
    return not points(a) and not points(b) or dimension(a) == dimension(b) and covers(a, b) and covers(b, a)


def _interiors_meet(a: Shape, b: Shape) -> bool:
    """An area's interior is open, so any point of the other one in it has points of that one's interior beside it."""
    p, q = _probes(a, b), _probes(b, a)
    if dimension(b) == 2 and any(_locate(x, b) > 0 and _near(x, b) > 0 for x in p) or dimension(a) == 2 and any(_locate(x, a) > 0 for x in q):
        return True
    if dimension(a) == dimension(b) == 2:
        return False
    return any(_locate(x, a) > 0 and _near(x, b) > 0 for x in p) or any(_near(x, a) > 0 and _locate(x, b) > 0 for x in q) or any(_locate(x, a) > 0 and _locate(x, b) > 0 for x in _crossings(a, b))


def _crossings(a: Shape, b: Shape) -> list[tuple]:
    out = []
    for p, q in segments(a):
        for r, s in segments(b):
            den = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
            if den:
                t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / den
                u = ((r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0])) / den
                if 0 <= t <= 1 and 0 <= u <= 1:
                    out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def touches(a: Shape, b: Shape) -> bool:
    return intersects(a, b) and not _interiors_meet(a, b)


def _leaves(a: Shape, b: Shape) -> bool:
    return any(_near(p, b) < 0 for p in _probes(a, b))


def crosses(a: Shape, b: Shape) -> bool:
    if not intersects(a, b) or not _interiors_meet(a, b):
        return False
    m, n = dimension(a), dimension(b)
    if m == n == 1:
        return not any(_near(p, a) > 0 and _near(p, b) > 0 for p in _probes(a, b) if p not in points(a) and p not in _crossings(a, b))
    return m != n and _leaves(*((a, b) if m < n else (b, a)))


def overlaps(a: Shape, b: Shape) -> bool:
    if dimension(a) != dimension(b) or not _interiors_meet(a, b) or dimension(a) == 1 and crosses(a, b):
        return False
    return _leaves(a, b) and _leaves(b, a)


def _point_segment(p: tuple, a: tuple, b: tuple) -> float:
    n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / n)) if n else 0.0
    return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def distance(a: Shape, b: Shape) -> float | None:
    if not points(a) or not points(b):
        return None
    if intersects(a, b):
        return 0.0
    found = [_point_segment(p, *s) for p in points(a) for s in segments(b)] + [_point_segment(p, *s) for p in points(b) for s in segments(a)] + [math.dist(p, q) for p in points(a) for q in points(b)]
    return min(found)


def boundary(g: Shape) -> Shape:
    if dimension(g) == 2:
        rings = [r for p in parts(g) for r in p.coords]
        return Shape("LINESTRING", rings[0], g.srid) if len(rings) == 1 else Shape("MULTILINESTRING", rings, g.srid)
    if dimension(g) == 1 and points(g):
        ends: dict = {}
        for p in parts(g):
            for e in (p.coords[0], p.coords[-1]):
                ends[e] = ends.get(e, 0) + 1
        return Shape("MULTIPOINT", sorted(e for e, n in ends.items() if n % 2), g.srid)
    return Shape("GEOMETRYCOLLECTION", [], g.srid)


def simplify(g: Shape, tolerance: float) -> Shape:
    """Drops vertices nearer than the tolerance to the line between those that stay; rings keep four points."""

    def line(ps: list) -> list:
        keep, work = {0, len(ps) - 1}, [(0, len(ps) - 1)]
        while work:
            i, j = work.pop()
            far, at = max(((_point_segment(ps[k], ps[i], ps[j]), k) for k in range(i + 1, j)), default=(0, 0))
            if far > tolerance:
                keep.add(at)
                work += [(i, at), (at, j)]
        return [ps[k] for k in sorted(keep)]

    def ring(ps: list) -> list:
        mid = max(range(len(ps)), key=lambda k: math.dist(ps[0], ps[k]))
        out = line(ps[: mid + 1])[:-1] + line(ps[mid:])
        return out if len(out) > 3 else ps

    change = {"LINESTRING": line, "POLYGON": lambda c: [ring(r) for r in c], "MULTILINESTRING": lambda c: [line(x) for x in c], "MULTIPOLYGON": lambda c: [[ring(r) for r in p] for p in c], "GEOMETRYCOLLECTION": lambda c: [simplify(x, tolerance) for x in c]}
    return Shape(g.kind, change[g.kind](g.coords), g.srid) if g.coords and g.kind in change else g


def snapped(g: Shape, size: float) -> Shape:
    def deep(c):
        return tuple(round(v / size) * size for v in c) if isinstance(c, tuple) else [snapped(x, size) if isinstance(x, Shape) else deep(x) for x in c]

    return Shape(g.kind, deep(g.coords) if g.coords else g.coords, g.srid)


def great_circle(p: tuple, q: tuple) -> float:
    """Metres between two places (longitude, latitude) on a sphere."""
    a, b = math.radians(p[1]), math.radians(q[1])
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
    return 2 * EARTH * math.asin(min(1.0, math.sqrt(h)))


def _great_circle_segment(p: tuple, a: tuple, b: tuple) -> float:
    """Metres from a place to the nearest one of an arc."""
    def vector(q: tuple) -> tuple[float, float, float]:
        lon, lat = math.radians(q[0]), math.radians(q[1])
        return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)

    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    dot = lambda u, v: sum(x * y for x, y in zip(u, v))
    u, v, w = vector(a), vector(b), vector(p)
    pole = cross(u, v)
    size = math.sqrt(dot(pole, pole))
    if size and dot(cross(pole, u), w) >= 0 and dot(cross(v, pole), w) >= 0:
        return EARTH * abs(math.asin(max(-1.0, min(1.0, dot(pole, w) / size))))
    return min(great_circle(p, a), great_circle(p, b))


def geodetic_distance(a: Shape, b: Shape) -> float | None:
    """Metres on a sphere between the nearest places of two geometries; areas and lines count with all that they cover."""
    if not points(a) or not points(b):
        return None
    if intersects(a, b):
        return 0.0
    near = [great_circle(p, q) for p in points(a) for q in points(b)]
    return min(near + [_great_circle_segment(p, *s) for p in points(a) for s in segments(b)] + [_great_circle_segment(p, *s) for p in points(b) for s in segments(a)])


def geodetic_length(g: Shape) -> float:
    return sum(great_circle(a, b) for p in parts(g) if p.kind == "LINESTRING" for a, b in pairwise(p.coords))


def mercator(g: Shape, back: bool = False) -> Shape:
    """Between 4326 and 3857."""
    r = 6_378_137.0

    def one(p: tuple) -> tuple:
        if back:
            return math.degrees(p[0] / r), math.degrees(2 * math.atan(math.exp(p[1] / r)) - math.pi / 2)
        return math.radians(p[0]) * r, math.log(math.tan(math.pi / 4 + math.radians(p[1]) / 2)) * r

    def deep(c):
        return one(c) if isinstance(c, tuple) else [mercator(x, back) if isinstance(x, Shape) else deep(x) for x in c]

    return Shape(g.kind, deep(g.coords) if g.coords else g.coords, 4326 if back else 3857)
