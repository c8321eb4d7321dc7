"""Queries against their SQL on made tables: keys beyond those of the test tables, ties, nulls."""

import math
import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenfold.functions import math as num
from lumenfold.operators import joins
from lumenfold.sqlcompat import limited_windows

from .test_contract import plain


@pytest.fixture
def agrees(spark, tmp_path):
    def check(name, **tables):
        duck = duckdb.connect()
        duck.execute("SET timezone = 'UTC'")
        for table, rows in tables.items():
            pq.write_table(rows, f"{tmp_path}/{table}.parquet")
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        got = entry.queries()[name](spark, str(tmp_path))
        assert plain(got.toPandas()) == plain(duck.execute(entry.oracle_sql()[name]).df())
        return got

    return check


def test_fn_math_of_large_keys(agrees, spark):
    keys = [*range(6_537_200, 6_537_260), *range(1_349_880, 1_349_920), 8_999_992]
    agrees("fn_math", orders=pa.table({"o_orderkey": keys, "o_totalprice": [1000.25 + k % 97 for k in keys]}))
    values = spark.createDataFrame([(1.0,), (800.0,), (-800.0,), (None,)], "x double")
    assert [r.v for r in values.select(num.exp("x").alias("v")).collect()] == [math.e, math.inf, 0.0, None]
    assert [spark.range(1).select(num.round_scaled(F.lit(v), 2).alias("v")).first().v for v in (-0.125, 0.125, 1e307, math.inf)] == [-0.13, 0.13, 1e307, math.inf]


def test_upsert_beside_suppliers_of_the_new_numbers(agrees):
    keys = [*range(12), *range(10_004, 10_013)]
    agrees("upsert", supplier=pa.table({"s_suppkey": keys, "s_name": [f"s{k}" for k in keys], "s_nationkey": pa.array([k % 25 for k in keys], pa.int32()), "s_acctbal": [k / 4 for k in keys]}))


def test_range_counts_without_a_pass_for_each_row(agrees):
    n = 60_000  # takes minutes if each frame is counted anew
    days = pa.array([(k * 7919 % n // 3) * 86_400_000_000 // 40 for k in range(n)], pa.timestamp("us"))
    began = time.time()
    agrees("win_frame_range", orders=pa.table({"o_orderkey": range(n), "o_orderpriority": ["low" if k % 9 else None for k in range(n)], "o_orderdate": days}))
    assert time.time() - began < 60


def test_one_value_joins_spread(spark, agrees):
    n = 5000
    lines = pa.table({"l_returnflag": ["ANR"[k % 3] for k in range(n)], "l_extendedprice": [k / 4 for k in range(n)]})
    plan = agrees("union_partition_join", lineitem=lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 2
    left = spark.range(40).selectExpr("'A' AS f", "id % 7 AS k", "id AS x")
    right = spark.range(6).selectExpr("'A' AS f", "id AS k", "id * 10 AS y")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(left.join(right, ["f", "k"], how).collect(), key=str)
        assert [sorted(joins._one_value_join(left, right, ["f", "k"], how, most).collect(), key=str) for most in (3, 10)] == [want] * 2


def test_counts_of_matches_without_making_them(agrees):
    n = 100_000  # 10,000,000,000 matches
    nation = pa.array([7] * (n - 2) + [8, None], pa.int32())
    agrees("natural_using", customer=pa.table({"c_custkey": range(n), "c_nationkey": nation}), supplier=pa.table({"s_suppkey": range(n), "s_nationkey": nation}))


def test_limit_reaches_running_windows(spark):
    rows = spark.createDataFrame([(None if k % 50 == 0 else k * 7919 % 1000 // 3, k, k % 4) for k in range(2000)], "k int, v int, g int")
    rows.createOrReplaceTempView("limited_windows_rows")
    text = "SELECT v, k, sum(v) OVER (ORDER BY k) AS run, count(*) OVER (PARTITION BY g ORDER BY k ASC) + 1 AS n FROM limited_windows_rows WHERE v > 3 OR v = 1 ORDER BY k, v LIMIT {} OFFSET 2"
    for n in (20, 55, 5000):
        plain_text = text.format(n)
        less = limited_windows(plain_text)
        assert less != plain_text and spark.sql(less).collect() == spark.sql(plain_text).collect()
    for old, new in (("sum(", "lead("), ("ORDER BY k)", "ORDER BY k DESC)"), ("ORDER BY k, v", "ORDER BY k DESC, v"), ("v > 3", "v > rand()"), ("v, k,", "v, g AS k,"), ("ORDER BY k)", "ORDER BY k ROWS 1 PRECEDING)"), (" LIMIT {} OFFSET 2", "")):
        other = text.replace(old, new).format(20)
        assert other != text.format(20) and limited_windows(other) == other
