"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.  Only a session whose master is local may leave that setting out; it then
    gets a temporary folder, which goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lumenfold-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/lumenfold-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cuts lineage: writes the rows as Parquet and reads them back, so that a lost executor costs a read.  Columns may
    have any names."""
    path = scratch(df.sparkSession, name)
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
