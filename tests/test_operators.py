"""Operators on small rows with expected results."""

import itertools
import operator

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.operators import aggregation as agg
from lumenfold.operators import dml, joins, predicates, setops, tables, windows
from lumenfold.plans import rewrites

G1 = [("a", 0, False, 2.0), (None, 1, False, 1.0), ("a", 3, True, 7.0), ("c", 1, True, None), ("b", 2, False, 0.0), ("a", 0, False, 2.0)]


@pytest.fixture(scope="module")
def g1(spark):
    return spark.createDataFrame(G1, "e1 string, e2 int, e3 boolean, e4 double")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def slow_quantified(x, op, quantifier, values):
    seen = [None if x is None or v is None else OPS[op](x, v) for v in values]
    if quantifier == "ANY":
        return True if True in seen else None if None in seen else False
    return False if False in seen else None if None in seen else True


@pytest.mark.parametrize("values", [[], [1], [1, 1], [1, 2], [1, None], [None], [0, 3, None]])
def test_quantified(spark, values):
    xs = [0, 1, 2, 3, None]
    left, sub = spark.createDataFrame([(x,) for x in xs], "x int"), spark.createDataFrame([(v,) for v in values], "v int")
    out = left
    names = {}
    for k, (op, q) in enumerate(itertools.product(OPS, ("ANY", "ALL"))):
        names[f"r{k}"] = op, q
        out = predicates.quantified(out, "x", op, q, sub, "v", f"r{k}")
    for r in out.collect():
        for name, (op, q) in names.items():
            assert r[name] == slow_quantified(r.x, op, q, values), (r.x, op, q, values)


@pytest.mark.parametrize(("pattern", "hits"), [("a%", ["abc", "a.c", "a\nc"]), ("a_c", ["abc", "a.c", "a\nc"]), ("a.c", ["a.c"]), ("(ab|x)c?", ["x", "abc"]), ("[a-c]{3}", ["abc"]), ("[^a]%", ["x"]), ("!%", [])])
def test_similar(spark, pattern, hits):
    df = spark.createDataFrame([(s,) for s in ("abc", "a.c", "x", "a\nc")], "s string")
    assert {r.s for r in df.where(predicates.similar_to("s", pattern, "!")).collect()} == set(hits)


def test_window_ranks(g1):
    w = Window.orderBy(F.asc_nulls_last("e1"), "e2")
    by = Window.orderBy(F.asc_nulls_last("e1"))
    got = rows(g1.select("e1", windows.row_number(w).alias("n"), windows.rank(by).alias("r"), windows.dense_rank(by).alias("d")))
    assert got == sorted([("a", 1, 1, 1), ("a", 2, 1, 1), ("a", 3, 1, 1), ("b", 4, 4, 2), ("c", 5, 5, 3), (None, 6, 6, 4)], key=repr)


def test_window_extras(g1):
    p = Window.partitionBy("e1")
    got = rows(g1.select("e1", windows.count_distinct_over("e2", p).alias("d"), windows.filtered_over(F.count, F.lit(1), F.col("e3"), p).alias("f"), F.size(windows.array_agg_over("e4", p)).alias("s")).distinct())
    assert got == sorted([("a", 2, 1, 3), ("b", 1, 0, 1), ("c", 1, 1, 1), (None, 1, 0, 1)], key=repr)


def test_aggregates(g1, spark):
    r = g1.agg(agg.array_agg("e1", [F.col("e2"), F.col("e1")]).alias("a"), agg.string_agg("e1", ",", [F.col("e1")]).alias("s"), agg.json_array_agg("e1", [F.col("e1")]).alias("j"), agg.sum_("e2", "integer").alias("t"), agg.avg_("e2", "integer").alias("m"), agg.where(F.sum, "e2", F.col("e3")).alias("w"), agg.every("e3").alias("ev"), agg.some("e3").alias("so"), agg.text_agg(["e1", "e2"], header=True, order_by=[F.col("e2"), F.col("e1")]).alias("c")).first()
    assert r.a == ["a", "a", None, "c", "b", "a"] and r.s == "a,a,a,b,c" and r.j == '["a","a","a","b","c"]'
    assert (r.t, round(float(r.m), 6), r.w, r.ev, r.so) == (7, 1.166667, 4, False, True)
    assert bytes(r.c).decode() == '"e1","e2"\n"a","0"\n"a","0"\n,"1"\n"c","1"\n"b","2"\n"a","3"\n'
    empty = g1.where("false").agg(agg.array_agg("e1").alias("a"), agg.string_agg("e1", ",").alias("s"), agg.json_array_agg("e1").alias("j"), agg.xml_agg("e1").alias("x")).first()
    assert tuple(empty) == (None,) * 4


def test_rollup(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "e1 string, e2 int")
    assert rows(agg.rollup(df, ["e1"], s=F.sum("e2"))) == sorted([("a", 3), ("b", 1), (None, 4)], key=repr)


def test_sum_overflow(spark):
    with pytest.raises(Exception, match="(?i)overflow"):
        spark.createDataFrame([(2**63 - 1,), (1,)], "x long").agg(agg.sum_("x", "long")).collect()


def test_set_operations(g1):
    a, b = g1.select("e1"), g1.where("e2 > 0").select("e1")
    assert rows(a.intersect(b)) == sorted([("a",), ("b",), ("c",), (None,)], key=repr)
    assert rows(a.subtract(g1.where("e1 IS NULL").select("e1"))) == [("a",), ("b",), ("c",)]
    assert setops.limit_offset(g1.orderBy("e2", "e1", "e4"), 2, 4).count() == 2
    with pytest.raises(ValueError):
        setops.limit_offset(g1, -1)


def test_recursive(spark):
    seed = spark.createDataFrame([(1,)], "k int")
    assert rows(setops.recursive_union(seed, lambda d: d.select(((F.col("k") * 2) % 7).alias("k")))) == [(1,), (2,), (4,)]
    assert rows(setops.recursive_union(seed, lambda d: d.where("k < 4").select((F.col("k") + 1).alias("k")), distinct=False)) == [(1,), (2,), (3,), (4,)]
    assert setops.recursive_union(seed, lambda d: d.where("k < 30").select((F.col("k") + 1).alias("k")), unroll=1, small=0).count() == setops.recursive_union(seed, lambda d: d.where("k < 30").select((F.col("k") + 1).alias("k")), unroll=50).count() == 30
    with pytest.raises(RuntimeError):
        setops.recursive_union(seed, lambda d: d, distinct=False, max_rounds=3)


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k int, y string")
    want = [(1, "a", "p"), (1, "a", "q")]
    for n in (10, 1):
        assert rows(joins.dependent_join(left, right, "k", max_keys=n)) == want
    assert rows(joins.dependent_join(left.where("false"), right, "k")) == []
    assert rows(joins.salted_join(left, right, ["k"], 3)) == want
    parts = [(1, left.where("k = 1")), (2, left.where("k = 2"))]
    assert rows(joins.union_partition_join(parts, [(1, right.where("k = 1")), (3, right.where("k = 3"))], ["k"])) == want
    assert rows(joins.union_partition_join(parts, [(1, right.where("k = 1"))], ["k"], "left")) == [*want, (2, "b", None)]
    assert rows(joins.lateral_topk(left, right, ["k"], [F.desc("y")], 1)) == [(1, "a", "q")]
    assert "Join" not in rewrites.explain(joins.optional_join(left, right, ["k"], ["x"]))
    assert rows(joins.optional_join(left, right, ["k"], ["x", "y"])) == sorted([("a", "p"), ("a", "q"), ("b", None), ("c", None)], key=repr)


def test_prune_branches(spark):
    branches = [({"s": k}, spark.createDataFrame([(k, 1)], "s string, v int")) for k in "ab"]
    assert rows(rewrites.prune_branches(branches, {"s": "b"})) == [("b", 1)]
    assert rewrites.prune_branches(branches, {"s": "z"}).count() == 0


def table(spark, text):
    return spark.createDataFrame([(7, text), (8, None)], "id int, t string")


def test_texttable(spark):
    spec = [("x", "integer"), ("y", "string"), ("n", "ordinality")]
    assert rows(tables.texttable(table(spark, '1,"a,""b"\n2,c'), "t", spec)) == [(7, 1, 'a,"b', 1), (7, 2, "c", 2)]
    assert rows(tables.texttable(table(spark, "skip\nY;X\nv;5"), "t", [("x", "integer"), ("y", "string")], delimiter=";", header=1, skip=1)) == [(7, 5, "v")]
    assert rows(tables.texttable(table(spark, "1,a\\,b"), "t", spec[:2], quote=None, escape="\\")) == [(7, 1, "a,b")]
    assert rows(tables.texttable(table(spark, "ab cd ef "), "t", [("a", "string", {"width": 3, "no_trim": True})], row_delimiter=None)) == [(7, "ab "), (7, "cd "), (7, "ef ")]
    picked = tables.texttable(table(spark, "H,9\nD,1\nD,2\nX,3"), "t", [("v", "integer"), ("h", "integer", {"selector": "H", "position": 1})], selector="D")
    assert rows(picked) == [(7, 1, 9), (7, 2, 9)]
    with pytest.raises(Exception, match="quoted"):
        tables.texttable(table(spark, '"open'), "t", spec).collect()


def test_jsontable(spark):
    df = table(spark, '{"a": [{"x": 1, "y": {"z": "p"}}, {"x": 2}]}')
    got = tables.jsontable(df, "t", "$.a", [("x", "integer"), ("z", "string", {"path": "@.y.z", "default": "none"}), ("n", "ordinality")])
    assert rows(got) == [(7, 1, "p", 1), (7, 2, "none", 2)]
    assert rows(tables.jsontable_native(table(spark, '[{"x": 1}, {"x": null}]'), "t", [("x", "integer"), ("n", "ordinality")])) == sorted([(7, 1, 1), (7, None, 2)], key=repr)


def test_xmltable(spark):
    df = table(spark, '<r xmlns="u"><i k="1"><v>a</v></i><i k="2"/></r>')
    got = tables.xmltable(df, "t", "/r/i", [("k", "integer", {"path": "@k"}), ("v", "string", {"default": "-"}), ("n", "ordinality")])
    assert rows(got) == [(7, 1, "a", 1), (7, 2, "-", 2)]


def test_arraytable(spark):
    df = spark.sql("SELECT array(array('1', 'a'), array('2', 'b'), array('3')) AS a")
    assert rows(tables.arraytable(df, "a", [("x", "integer"), ("y", "string")], rows=True)) == sorted([(1, "a"), (2, "b"), (3, None)], key=repr)
    assert rows(tables.array_iterate(spark.sql("SELECT array(1, 2) AS a"), "a")) == [(1,), (2,)]


def test_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert rows(dml.update(base, "v = 'a'", {"v": F.lit("z")})) == sorted([(1, "z"), (2, None)], key=repr)
    assert rows(dml.delete(base, "v = 'a'")) == [(2, None)]
    assert rows(dml.upsert(base, spark.createDataFrame([(2, "b"), (3, "c")], base.schema), ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    t = dml.VersionedTable(base, ["k"])
    t.savepoint("s")
    t.insert(spark.createDataFrame([(3, "c")], base.schema)).delete("k = 1")
    assert rows(t.df) == sorted([(2, None), (3, "c")], key=repr)
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(3, "d")], base.schema))
    with pytest.raises(ValueError):
        t.batch([lambda x: x.delete("k = 2"), lambda x: x.insert(spark.createDataFrame([(3, "d")], base.schema))])
    assert t.df.count() == 2
    t.rollback("s")
    assert rows(t.df) == rows(base)
    seen = []
    t.instead_of("delete", lambda old: seen.extend(rows(old)))
    t.delete("k = 1")
    assert seen == [(1, "a")] and t.df.count() == 2
