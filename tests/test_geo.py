"""Geometry: round trips, measures and predicates."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import geo
from lumenfold.functions import shapes as sh

TEXTS = ["POINT (1 2.5)", "POINT EMPTY", "LINESTRING (0 0, 1 1, 2 0)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "MULTIPOINT ((0 0), (1 1))", "MULTILINESTRING ((0 0, 1 0), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "GEOMETRYCOLLECTION (POINT (1 1), LINESTRING (0 0, 1 1))"]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trips(text):
    g = sh.from_text(text)
    assert sh.to_text(g) == text
    for extended in (False, True):
        for little in (False, True):
            assert sh.to_text(sh.from_binary(sh.to_binary(g._replace(srid=4326), extended, little))) == text
    assert sh.from_binary(sh.to_binary(g._replace(srid=7), True)).srid == 7
    if "EMPTY" not in text:
        assert sh.to_text(sh.from_geojson(sh.to_geojson(g))) == text


@pytest.mark.parametrize("bad", ["POINT (1)", "POINT 1 2", "CIRCLE (1 2)", "LINESTRING (0 0, 1 1", "POLYGON ((0 0, 1 0, 1 1))", "POINT (1 2) x"])
def test_bad_text(bad):
    with pytest.raises(ValueError):
        sh.from_text(bad)


SQUARE, INNER, FAR, EDGE, PART = (sh.rectangle(*b) for b in ((0, 0, 4, 4), (1, 1, 2, 2), (10, 10, 12, 12), (4, 0, 8, 4), (2, 2, 6, 6)))
LINE = sh.from_text("LINESTRING (-1 2, 5 2)")
RELATIONS = {
    "intersects": [(SQUARE, INNER, True), (SQUARE, FAR, False), (SQUARE, EDGE, True), (SQUARE, LINE, True)],
    "contains": [(SQUARE, INNER, True), (INNER, SQUARE, False), (SQUARE, SQUARE, True), (SQUARE, sh.from_text("POINT (0 0)"), False), (SQUARE, sh.from_text("POINT (1 1)"), True), (SQUARE, sh.from_text("LINESTRING (0 0, 4 0)"), False)],
    "within": [(INNER, SQUARE, True)],
    "disjoint": [(SQUARE, FAR, True), (SQUARE, INNER, False)],
    "touches": [(SQUARE, EDGE, True), (SQUARE, PART, False), (SQUARE, FAR, False), (sh.from_text("POINT (0 2)"), SQUARE, True)],
    "crosses": [(LINE, SQUARE, True), (LINE, sh.from_text("LINESTRING (0 0, 4 4)"), True), (SQUARE, PART, False), (LINE, sh.from_text("LINESTRING (0 2, 9 2)"), False)],
    "overlaps": [(SQUARE, PART, True), (SQUARE, INNER, False), (SQUARE, EDGE, False), (LINE, sh.from_text("LINESTRING (0 2, 9 2)"), True)],
    "equals": [(SQUARE, sh.from_text("POLYGON ((4 4, 4 0, 0 0, 0 4, 2 4, 4 4))"), True), (SQUARE, PART, False), (LINE, sh.from_text("LINESTRING (5 2, -1 2)"), True)],
}


@pytest.mark.parametrize("name", RELATIONS)
def test_relations(name):
    for a, b, want in RELATIONS[name]:
        assert getattr(sh, name)(a, b) is want, (name, sh.to_text(a), sh.to_text(b))


def test_measures():
    holed = sh.from_text(TEXTS[3])
    assert sh.area(holed) == 15 and sh.perimeter(holed) == 20 and sh.length(LINE) == 6
    assert sh.centroid(SQUARE).coords == (2, 2) and sh.centroid(LINE).coords == (2, 2)
    assert sh.distance(SQUARE, FAR) == pytest.approx(72**0.5) and sh.distance(SQUARE, INNER) == 0
    assert sh.place((1.5, 1.5), holed.coords) == -1 and sh.place((1, 1), holed.coords) == 0
    assert len(sh.convex_hull(sh.from_text("MULTIPOINT ((0 0), (2 0), (1 1), (2 2), (0 2))")).coords[0]) == 5
    assert sh.to_text(sh.simplify(sh.from_text("LINESTRING (0 0, 1 0.01, 2 0)"), 0.1)) == "LINESTRING (0 0, 2 0)"
    assert sh.great_circle((0, 0), (0, 90)) == pytest.approx(sh.EARTH * 3.14159265358979 / 2)
    back = sh.mercator(sh.mercator(sh.from_text("POINT (12.5 41.9)")), True)
    assert back.coords == pytest.approx((12.5, 41.9))


@given(*[st.tuples(st.integers(-3, 3), st.integers(-3, 3), st.integers(1, 4), st.integers(1, 4))] * 2)
def test_boxes_agree(a, b):
    p, q = (sh.rectangle(x, y, x + w, y + h) for x, y, w, h in (a, b))
    dx, dy = (min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (0, 1))
    assert sh.intersects(p, q) == (dx >= 0 and dy >= 0)
    assert sh.touches(p, q) == (dx >= 0 and dy >= 0 and min(dx, dy) == 0)
    inside = all(a[k] <= b[k] and b[k] + b[k + 2] <= a[k] + a[k + 2] for k in (0, 1))
    assert sh.contains(p, q) == inside
    assert sh.distance(p, q) == pytest.approx((max(0, -dx) ** 2 + max(0, -dy) ** 2) ** 0.5)


def test_columns(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POINT (1 1)"), (None, "POINT (9 9)")], "a string, b string").select(geo.st_geomfromtext("a").alias("a"), geo.st_geomfromtext("b", 4326).alias("b"))
    r = df.select(geo.st_contains("a", "b").alias("c"), geo.st_area("a").alias("area"), geo.st_srid("b").alias("srid"), geo.st_asewkt("b").alias("t"), geo.st_x("b").alias("x"), geo.st_distance("a", "b").alias("d"), geo.st_geometrytype("a").alias("k"), geo.st_astext(geo.st_transform("b", 3857)).isNotNull().alias("m"), geo.st_dwithin("a", "b", 1.0).alias("w")).collect()
    assert tuple(r[0]) == (True, 16.0, 4326, "SRID=4326;POINT (1 1)", 1.0, 0.0, "ST_Polygon", True, True)
    assert r[1].c is None and r[1].area is None and r[1].x == 9
    box = df.agg(geo.st_astext(geo.st_extent("b")).alias("e")).first().e
    assert box == "POLYGON ((1 1, 1 9, 9 9, 9 1, 1 1))"
    assert spark.range(1).select(geo.point_distance(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)).alias("d"), geo.in_box(F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(2), F.lit(2)).alias("i")).first().asDict() == {"d": 5.0, "i": True}
