"""The in-memory database with executors in processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

SCRIPT = """
import datetime, decimal, sys
import duckdb
import __spark_entry__ as entry
from pyspark.sql import SparkSession
from lumenfold.sources.jdbc import DIALECTS, Embedded
from tests.test_contract import SF, plain

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
duck = duckdb.connect()
for table in ("nation", "customer"):
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
for name in ("jdbc_pushdown", "jdbc_native", "jdbc_pushed_join", "jdbc_parallel"):
    assert plain(entry.queries()[name](spark, SF).toPandas()) == plain(duck.execute(entry.oracle_sql()[name]).df()), name
source = Embedded(DIALECTS["derby"], "jdbc:derby:memory:kinds;create=true")
rows = [(1, "a", decimal.Decimal("1.50"), datetime.datetime(2024, 1, 2, 3, 4, 5), True, b"x"), (None,) * 6, (3, "c", None, None, False, None)]
made = spark.createDataFrame(rows, "A LONG, B STRING, C DECIMAL(9,2), D TIMESTAMP, E BOOLEAN, F BINARY")
source.write(made, "KINDS", "overwrite", 2)
source.write(made.limit(1), "KINDS", batch=2)
got = source.table(spark, "KINDS")
assert sorted(map(str, got.collect())) == sorted(map(str, [*made.collect(), *made.limit(1).collect()]))
assert "PushedFilters: [*IsNotNull(A), *GreaterThan(A,2)]" in got.where("A > 2")._jdf.queryExecution().executedPlan().toString()
print("whole")
"""


def test_embedded_database(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    root = str(Path(__file__).parents[1])
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))}
    env |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": root, "TZ": "UTC"}
    ran = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert ran.stdout.strip().endswith("whole"), ran.stderr[-3000:]
