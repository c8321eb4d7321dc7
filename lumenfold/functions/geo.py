"""Geospatial functions on columns of EWKB (binary).  The geometry itself is in ``shapes`` and ``overlay``; it runs in
Arrow batches.

``GEO`` names every function with what it does on values, so that SQL text calls the same ones.  Point measures that are
plain arithmetic have native forms (``point_distance``, ``in_box``), which stay in Catalyst; SQL text takes them for points
and boxes that are made in the call itself.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import overlay as ov
from . import shapes as sh
from .common import col
from .shapes import Shape


class Geo(NamedTuple):
    """A function of values; the first ``geometries`` are geometries.  Any null gives null."""

    apply: Callable
    returns: str
    geometries: int = 1


def _read(v: bytes | None) -> Shape | None:
    return None if v is None else sh.from_binary(bytes(v))


def _write(v: object) -> object:
    return sh.to_binary(v, extended=True) if isinstance(v, Shape) else v


def batched(geo: Geo):
    """The function as a UDF over Arrow batches."""

    @F.pandas_udf(geo.returns)
    def run(*series: pd.Series) -> pd.Series:
        def row(values: tuple) -> object:
            if any(v is None or v != v for v in values):
                return None
            return _write(geo.apply(*map(_read, values[: geo.geometries]), *values[geo.geometries :]))

        return pd.Series([row(v) for v in zip(*series)], dtype=object)

    return run


def _with_srid(read: Callable) -> Callable:
    return lambda v, srid=None: read(v) if srid is None else read(v)._replace(srid=int(srid))


def _pick(s: Shape, n: int) -> Shape | None:
    if not s.kind.startswith(("MULTI", "GEOM")):
        return s if n == 1 else None
    if not 1 <= n <= len(s.coords):
        return None
    return s.coords[n - 1] if s.kind == "GEOMETRYCOLLECTION" else Shape(s.kind[5:], s.coords[n - 1], s.srid)


def _turn(s: Shape, srid: int) -> Shape:
    """Between longitude/latitude (4326) and web Mercator (3857)."""
    if s.srid == srid:
        return s
    if {s.srid, srid} != {4326, 3857}:
        raise ValueError(f"no transformation from {s.srid} to {srid}")
    return sh.mercator(s, srid == 4326)


def _end(k: int) -> Callable:
    return lambda g: Shape("POINT", g.coords[k], g.srid) if g.kind == "LINESTRING" and g.coords else None


def _axis(k: int) -> Callable:
    return lambda g: g.coords[k] if g.kind == "POINT" and g.coords else None


def _side_of_box(k: int) -> Callable:
    return lambda g: (sh.box(g) or (None,) * 4)[k]


_text, _bytes = _with_srid(sh.from_text), _with_srid(lambda v: sh.from_binary(bytes(v)))

GEO: dict[str, Geo] = {
    "st_geomfromtext": Geo(_text, "binary", 0),
    "st_geomfromewkt": Geo(_text, "binary", 0),
    "st_geogfromtext": Geo(_text, "binary", 0),
    "st_geomfromwkb": Geo(_bytes, "binary", 0),
    "st_geomfromewkb": Geo(_bytes, "binary", 0),
    "st_geogfromwkb": Geo(_bytes, "binary", 0),
    "st_geomfromgeojson": Geo(_with_srid(sh.from_geojson), "binary", 0),
    "st_geomfromgml": Geo(ov.from_gml, "binary", 0),
    "st_point": Geo(lambda x, y: Shape("POINT", (float(x), float(y))), "binary", 0),
    "st_makeenvelope": Geo(lambda x0, y0, x1, y1, srid=0: sh.rectangle(float(x0), float(y0), float(x1), float(y1), int(srid)), "binary", 0),
    "st_astext": Geo(sh.to_text, "string"),
    "st_asewkt": Geo(lambda g: sh.to_text(g, True), "string"),
    "st_asbinary": Geo(lambda g: sh.to_binary(g), "binary"),
    "st_asewkb": Geo(lambda g: sh.to_binary(g, True), "binary"),
    "st_asgeojson": Geo(sh.to_geojson, "string"),
    "st_asgml": Geo(lambda g: ov.to_markup(g, "gml:", True), "string"),
    "st_askml": Geo(lambda g: ov.to_markup(g if g.srid in (0, 4326) else _turn(g, 4326), ""), "string"),
    "st_srid": Geo(lambda g: g.srid, "int"),
    "st_setsrid": Geo(lambda g, n: g._replace(srid=int(n)), "binary"),
    "st_transform": Geo(lambda g, n: _turn(g, int(n)), "binary"),
    "st_x": Geo(_axis(0), "double"),
    "st_y": Geo(_axis(1), "double"),
    "st_z": Geo(lambda g: g.z, "double"),
    "st_geometrytype": Geo(lambda g: "ST_" + sh._GEOJSON[sh.KINDS.index(g.kind)], "string"),
    "st_dimension": Geo(sh.dimension, "int"),
    "st_coorddim": Geo(lambda g: 2 if g.z is None else 3, "int"),
    "st_isempty": Geo(lambda g: not sh.points(g), "boolean"),
    "st_isclosed": Geo(lambda g: all(p.coords[0] == p.coords[-1] for p in sh.parts(g) if p.kind == "LINESTRING"), "boolean"),
    "st_isring": Geo(lambda g: g.kind == "LINESTRING" and len(g.coords) > 3 and g.coords[0] == g.coords[-1] and ov.is_simple(g), "boolean"),
    "st_issimple": Geo(ov.is_simple, "boolean"),
    "st_isvalid": Geo(ov.is_valid, "boolean"),
    "st_numpoints": Geo(lambda g: len(sh.points(g)), "int"),
    "st_numgeometries": Geo(lambda g: len(g.coords) if g.kind.startswith(("MULTI", "GEOM")) else int(bool(g.coords)), "int"),
    "st_numinteriorrings": Geo(lambda g: len(g.coords) - 1 if g.kind == "POLYGON" and g.coords else None, "int"),
    "st_area": Geo(sh.area, "double"),
    "st_length": Geo(sh.length, "double"),
    "st_perimeter": Geo(sh.perimeter, "double"),
    "st_centroid": Geo(sh.centroid, "binary"),
    "st_envelope": Geo(sh.envelope, "binary"),
    "st_convexhull": Geo(sh.convex_hull, "binary"),
    "st_boundary": Geo(sh.boundary, "binary"),
    "st_force_2d": Geo(lambda g: g._replace(z=None), "binary"),
    "st_curvetoline": Geo(lambda g: g, "binary"),
    "st_hasarc": Geo(lambda g: False, "boolean"),
    "st_startpoint": Geo(_end(0), "binary"),
    "st_endpoint": Geo(_end(-1), "binary"),
    "st_exteriorring": Geo(lambda g: Shape("LINESTRING", g.coords[0], g.srid) if g.kind == "POLYGON" and g.coords else None, "binary"),
    "st_interiorringn": Geo(lambda g, n: Shape("LINESTRING", g.coords[int(n)], g.srid) if g.kind == "POLYGON" and 1 <= n < len(g.coords) else None, "binary"),
    "st_geometryn": Geo(lambda g, n: _pick(g, int(n)), "binary"),
    "st_pointn": Geo(lambda g, n: Shape("POINT", g.coords[int(n) - 1], g.srid) if g.kind == "LINESTRING" and 1 <= n <= len(g.coords) else None, "binary"),
    "st_pointonsurface": Geo(lambda g: Shape("POINT", next((sh.interior(p) for p in sh.parts(g) if p.kind == "POLYGON"), None) or (sh.points(g) or [None])[0], g.srid), "binary"),
    "st_polygon": Geo(lambda g, n=None: Shape("POLYGON", [g.coords], g.srid if n is None else int(n)), "binary"),
    "st_simplify": Geo(lambda g, d: sh.simplify(g, float(d)), "binary"),
    "st_simplifypreservetopology": Geo(lambda g, d: ov.simplified(g, float(d)), "binary"),
    "st_snaptogrid": Geo(lambda g, d: sh.snapped(g, float(d)), "binary"),
    "st_buffer": Geo(lambda g, d, quarter=8: ov.buffer(g, float(d), int(quarter)), "binary"),
    "st_xmin": Geo(_side_of_box(0), "double"),
    "st_ymin": Geo(_side_of_box(1), "double"),
    "st_xmax": Geo(_side_of_box(2), "double"),
    "st_ymax": Geo(_side_of_box(3), "double"),
    "geodetic_length": Geo(sh.geodetic_length, "double"),
    "geodetic_distance": Geo(sh.geodetic_distance, "double", 2),
    "st_intersects": Geo(sh.intersects, "boolean", 2),
    "st_contains": Geo(sh.contains, "boolean", 2),
    "st_crosses": Geo(sh.crosses, "boolean", 2),
    "st_disjoint": Geo(sh.disjoint, "boolean", 2),
    "st_overlaps": Geo(sh.overlaps, "boolean", 2),
    "st_touches": Geo(sh.touches, "boolean", 2),
    "st_equals": Geo(sh.equals, "boolean", 2),
    "st_within": Geo(sh.within, "boolean", 2),
    "st_orderingequals": Geo(lambda a, b: a[:2] == b[:2], "boolean", 2),
    "boxes_meet": Geo(sh.boxes_meet, "boolean", 2),
    "st_relate": Geo(ov.relate, "string", 2),
    "st_fits": Geo(ov.relate, "boolean", 2),
    "st_distance": Geo(sh.distance, "double", 2),
    "st_dwithin": Geo(lambda a, b, reach: (d := sh.distance(a, b)) is not None and d <= float(reach), "boolean", 2),
    "st_union": Geo(lambda a, b: ov.overlay(a, b, "union"), "binary", 2),
    "st_intersection": Geo(lambda a, b: ov.overlay(a, b, "intersection"), "binary", 2),
    "st_difference": Geo(lambda a, b: ov.overlay(a, b, "difference"), "binary", 2),
    "st_symdifference": Geo(lambda a, b: ov.overlay(a, b, "symdifference"), "binary", 2),
}


def _column_function(name: str) -> Callable[..., Column]:
    def function(*args) -> Column:
        return batched(GEO[name])(*(col(a) for a in args if a is not None))

    function.__name__ = name
    return function


globals().update({name: _column_function(name) for name in GEO})


def st_relate(a, b, pattern=None) -> Column:  # noqa: F811
    """The matrix as text, or whether it fits the pattern."""
    return _column_function("st_relate")(a, b) if pattern is None else _column_function("st_fits")(a, b, pattern if isinstance(pattern, Column) else F.lit(pattern))


def st_extent(g) -> Column:
    """Aggregate: the box around all geometries of a group.  Corners are taken from each row, then combine before a shuffle."""
    least = lambda name: F.min(_column_function(name)(g))
    most = lambda name: F.max(_column_function(name)(g))
    return _column_function("st_makeenvelope")(least("st_xmin"), least("st_ymin"), most("st_xmax"), most("st_ymax"))


def point_distance(x0, y0, x1, y1) -> Column:
    return F.hypot(col(x1) - col(x0), col(y1) - col(y0))


def in_box(x, y, x0, y0, x1, y1) -> Column:
    """Within the box, its edge left out, as st_contains has it."""
    return (col(x) > col(x0)) & (col(x) < col(x1)) & (col(y) > col(y0)) & (col(y) < col(y1))
