"""Catalog, SQL rewrites, materialized views, procedures, sources, streams, UDFs."""

import pytest
from pyspark.sql import functions as F

from lumenfold import udf
from lumenfold.catalog import Catalog, Policy
from lumenfold.operators.matview import MaterializedViews
from lumenfold.operators.procedures import Procedures, ResultCache
from lumenfold.sources import files, generated
from lumenfold.sources.jdbc import DIALECTS, Source
from lumenfold.sqlcompat import rewrite
from lumenfold.streaming import asynchronous, continuous, windows


@pytest.fixture
def catalog(spark):
    made = Catalog(spark, "ann", ["reader"])
    made.register("t", spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, None, 7.0)], "k int, s string, v double"), "k int, s string", ["k"])
    made.register("u", spark.createDataFrame([(1,), (3,), (None,)], "k int"))
    return made


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT k FROM t WHERE k = ANY (SELECT k FROM u)", [(1,), (3,)]),
        ("SELECT k FROM t WHERE k > ALL (SELECT k FROM u WHERE k < 2)", [(2,), (3,)]),
        ("SELECT k FROM t WHERE k >= ALL (SELECT k FROM u)", []),
        ("SELECT k FROM t WHERE NOT (k < ALL (SELECT k FROM u WHERE k > 5))", []),
        ("SELECT k FROM t WHERE s SIMILAR TO '(a|c)%'", [(1,)]),
        ("SELECT k FROM t WHERE s NOT LIKE_REGEX '^a'", [(2,)]),
        ("SELECT k FROM t ORDER BY k OFFSET 1 ROWS FETCH NEXT 1 ROWS ONLY", [(2,)]),
        ("SELECT k FROM t ORDER BY k LIMIT 1, 2", [(2,), (3,)]),
        ("SELECT x.k FROM t x JOIN u ON x.k = u.k", [(1,), (3,)]),
        ("SELECT t.k FROM t, u WHERE t.k = u.k", [(1,), (3,)]),
        ("SELECT k, COUNT(DISTINCT s) OVER () AS n FROM t", [(1, 2), (2, 2), (3, 2)]),
        ("SELECT k, sum(v) FILTER (WHERE k > 1) OVER () AS n FROM t", [(1, 7.0), (2, 7.0), (3, 7.0)]),
        ("SELECT 'ANY (SELECT' AS q, k FROM t WHERE k = 1 -- OFFSET 1 ROW\n", [("ANY (SELECT", 1)]),
    ],
)
def test_sql(catalog, text, want):
    assert rows(catalog.sql(text)) == sorted(want, key=repr)


def test_rewrite_leaves_plain_sql():
    plain = "SELECT max(x) FROM t WHERE a IN (SELECT b FROM c) AND d = 'it''s ALL (SELECT 1)' LIMIT 5"
    assert rewrite(plain) == plain


def test_views_and_system_tables(catalog):
    catalog.create_view("named", "SELECT k, s FROM t WHERE s IS NOT NULL")
    catalog.create_view("few", "SELECT s FROM named WHERE k = 2")
    assert rows(catalog.sql("SELECT * FROM few")) == [("b",)]
    with pytest.raises(ValueError):
        catalog.create_view("few", "SELECT 1")
    catalog.create_view("a", "SELECT * FROM b")
    catalog.create_view("b", "SELECT * FROM a")
    with pytest.raises(ValueError, match="each other"):
        catalog.sql("SELECT * FROM a")
    catalog.drop("a")
    catalog.drop("b")
    system = catalog.system_tables()
    assert ("", "few", "View") in [tuple(x or "" for x in r) for r in system["Tables"].collect()]
    assert system["KeyColumns"].first().Name == "k"
    assert "Physical Plan" in catalog.explain("SELECT * FROM few")
    assert "isFinalPlan=true" in catalog.explain("SELECT s, count(*) FROM t GROUP BY s", "analyze")
    with pytest.raises(TypeError):
        catalog.register("x", catalog.tables["u"], "k string")


def test_policies(catalog):
    catalog.grant("t", Policy("reader", "k < 3", {"v": (1, "coalesce(v, -1)")}, frozenset({"SELECT", "INSERT"})))
    catalog.grant("t", Policy("other", "k > 0"))
    assert rows(catalog.sql("SELECT k, v FROM t")) == [(1, 5.0), (2, -1.0)]
    new = catalog.tables["t"].where("k = 3")
    with pytest.raises(Exception, match="policy"):
        catalog.constrain("t", new).collect()
    assert catalog.constrain("t", catalog.tables["t"].where("k = 1")).count() == 1
    catalog.roles = {"nobody"}
    with pytest.raises(PermissionError):
        catalog.sql("SELECT k FROM t")
    assert not catalog.has_role("reader")


def test_access_patterns_and_multi_source(spark, catalog):
    catalog.register("guarded", catalog.tables["t"], access_patterns=[["k"]])
    with pytest.raises(ValueError, match="condition"):
        catalog.sql("SELECT s FROM guarded")
    assert catalog.sql("SELECT s FROM guarded WHERE k = 1").count() == 1
    catalog.multi_source("m", {"x": catalog.tables["u"], "y": catalog.tables["u"]})
    plan = catalog.explain("SELECT k FROM m WHERE SOURCE_NAME = 'x'", "simple")
    assert "Union" not in plan
    assert catalog.sql("SELECT k FROM m").count() == 6


def test_materialized_views(spark, tmp_path):
    now = [100.0]
    source = {"df": spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")}
    views = MaterializedViews(spark, f"file://{tmp_path}", lambda: now[0])
    views.create("v", lambda: source["df"], ttl=10, key=["k"])
    assert views.stale("v") and views.read("v").count() == 2
    source["df"] = spark.createDataFrame([(1, "A"), (3, "c")], "k int, v string")
    assert rows(views.read("v")) == [(1, "a"), (2, "b")] and views.read("v", no_cache=True).count() == 2
    views.refresh_rows("v", spark.createDataFrame([(1,), (2,)], "k int"))
    assert rows(views.read("v")) == [(1, "A")]
    now[0] = 111
    assert rows(views.read("v")) == [(1, "A"), (3, "c")]
    good = source["df"]
    source["df"] = good.select(F.raise_error(F.lit("boom")).alias("k"))
    with pytest.raises(Exception, match="boom"):
        views.refresh("v")
    assert rows(views.read("v")) == [(1, "A"), (3, "c")] and views.report().first().LoadState == "LOADED"


def test_procedures(spark):
    p = Procedures(spark)
    p.create("twice", lambda s, n: s.range(n).selectExpr("id * 2 AS x"))
    assert p.call("TWICE", n=3).count() == 3
    p.create("pick", "BEGIN IF :n > 1 THEN SELECT 'many' AS w; ELSE SELECT 'one' AS w; END IF; END")
    assert p.call("pick", n=5).first().w == "many" and p.call("pick", n=1).first().w == "one"
    inputs = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "n int, t string")
    assert rows(p.dependent("twice", inputs, "n")) == [(1, "a", 0), (1, "c", 0), (2, "b", 0), (2, "b", 2)]
    with pytest.raises(ValueError):
        p.dependent("twice", inputs, "n", bound=1)
    p.execute_immediate("SELECT 1 AS x WHERE 1 = ANY (SELECT 0 + :v)", {"v": 1}, into="made")
    assert spark.table("made").count() == 1


def test_result_cache(spark):
    now = [0.0]
    cache = ResultCache(spark, 10, lambda: now[0])
    first = cache.sql("SELECT  1 AS x")
    assert cache.sql("SELECT 1 AS x") is first
    now[0] = 11
    assert cache.sql("SELECT 1 AS x") is not first
    cache.clear()


def test_files(spark, tmp_path):
    base = f"file://{tmp_path}"
    files.save_file(spark, f"{base}/d/a.txt", "x,1\ny,2\n")
    files.save_file(spark, f"{base}/d/b.txt", b"\xe9")
    assert {r.filePath: bytes(r.file) for r in files.get_files(spark, f"{base}/d/*").collect()} == {"a.txt": b"x,1\ny,2\n", "b.txt": b"\xe9"}
    assert files.get_text_files(spark, f"{base}/d/b.txt", "ISO-8859-1").first().file == "é"
    assert rows(files.read_delimited(spark, f"{base}/d/a.txt", "s string, n int")) == [("x", 1), ("y", 2)]
    assert files.delete_file(spark, f"{base}/d/b.txt") and files.get_files(spark, f"{base}/d/*").count() == 1
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    files.write_parquet(df, f"{base}/t", ["p"])
    read = files.read_parquet(spark, f"{base}/t", ["k"], "p = 'b' AND k > 0")
    assert rows(read) == [(2,)] and "PartitionFilters: [isnotnull(p" in read._sc._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "simple")
    files.write_delimited(df, f"{base}/c")
    assert rows(files.read_delimited(spark, f"{base}/c", "k int, p string", header=True)) == [(1, "a"), (2, "b")]


def test_generated(spark):
    assert generated.loopback(spark, "a int, b string, c date, d boolean", 2).distinct().count() == 1
    assert generated.loopback(spark, "a int, b timestamp, c double, d binary", 3, True).distinct().count() == 3


def test_jdbc(spark, tmp_path):
    s = Source(DIALECTS["derby"], f"jdbc:derby:{tmp_path}/db;create=true")
    data = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "ID int, NAME string")
    s.write(data, "PEOPLE", "overwrite")
    got = s.table(spark, "PEOPLE").where("ID > 17").select("NAME")
    assert rows(got) == [("n18",), ("n19",)]
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,17)]" in got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert s.native(spark, "SELECT COUNT(*) AS N FROM PEOPLE WHERE ID <> $1", [3]).first().N == 19
    assert s.table(spark, "PEOPLE", "use an index").where("ID = 4").count() == 1
    keys = spark.createDataFrame([(3,), (3,), (5,), (None,), (99,)], "ID int")
    assert rows(s.pushed_join(spark, keys, "PEOPLE", "ID", "STAGED").select("NAME")) == [("n3",), ("n5",)]
    assert s.parallel(spark, "PEOPLE", "ID", 0, 20, 4).rdd.getNumPartitions() == 4
    assert DIALECTS["sqlserver"].identifier("a]b") == "[a]]b]" and DIALECTS["mysql"].identifier("a`b") == "`a``b`"
    assert DIALECTS["ansi"].literal("it's") == "'it''s'"


def test_udfs(spark):
    udf.scalar(spark, "plus_len", lambda s, n: len(s) + n, "int")
    assert spark.sql("SELECT plus_len('abc', 2) AS a, plus_len(NULL, 2) AS b").first().asDict() == {"a": 5, "b": None}
    udf.aggregate(spark, "most", lambda s: int(s.max()), "long")
    assert spark.sql("SELECT most(id) AS m FROM range(5)").first().m == 4
    udf.table(spark, "upto", lambda n: ((i,) for i in range(n)), "i int")
    assert spark.sql("SELECT id, i FROM range(3), LATERAL upto(CAST(id AS INT))").count() == 3
    udf.sql_function(spark, "plus_one", "x INT", "INT", "x + 1")
    assert spark.sql("SELECT plus_one(2) AS x").first().x == 3


def test_mergeable_aggregate(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 5, i) for i in range(1000)], "g int, v int").repartition(7)
    got = udf.mergeable(df, ["g"], "v", lambda s: (float(s.sum()), len(s)), lambda states: (sum(a for a, _ in states), sum(n for _, n in states)), lambda state: state[0] / state[1], "double")
    assert rows(got) == rows(df.groupBy("g").agg(F.avg("v").alias("result")))
    assert udf.mergeable(df.limit(0), ["g"], "v", sum, sum, float, "double").count() == 0


def test_streams(spark, tmp_path):
    source, seen = f"file://{tmp_path}/in", []
    spark.createDataFrame([("2024-01-01 00:10:00", 1), ("2024-01-01 00:50:00", 2), ("2024-01-01 03:00:00", 3)], "ts string, v int").select(F.col("ts").cast("timestamp"), "v").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, v int").parquet(source)
    continuous.on_change(stream, lambda df, n: seen.append(df.count()), f"file://{tmp_path}/ck", once=True).awaitTermination(60)
    assert sum(seen) == 3
    hours = windows.tumbling(stream, "ts", "1 hour", [], late="10 minutes", n=F.count("*"), s=F.sum("v"))
    hours.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r.n, r.s) for r in spark.table("hours").collect()) == [(1, 3), (2, 3)]
    batch = spark.read.parquet(source)
    assert windows.sessions(batch, "ts", "1 hour", [], n=F.count("*")).count() == 2
    assert [(r, o, row and row.v) for r, o, row in continuous.rerun(lambda: batch.orderBy("v").limit(1), rounds=2)] == [(0, 0, 1), (0, 1, None), (1, 1, 1), (1, 2, None)]


def test_asynchronous(spark):
    seen, errors = [], []
    assert asynchronous.submit(spark.range(5), lambda r: seen.append(r.id)).result(60) == 5 and seen == [0, 1, 2, 3, 4]
    assert asynchronous.submit(spark.range(50), lambda r: r.id < 2).result(60) == 3
    bad = spark.range(1).select(F.raise_error(F.lit("boom")).alias("x"))
    assert asynchronous.submit(bad, seen.append, on_error=errors.append).result(60) == 0 and "boom" in str(errors[0])
    with pytest.raises(Exception, match="boom"):
        asynchronous.submit(bad, seen.append).result(60)
