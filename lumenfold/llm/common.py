"""What the operators share: scratch tables in the shared folder, and Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share.

    Only a session whose master is local may leave that setting out; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lumenfold-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/lumenfold-{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows as Parquet into the shared folder and reads them back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow for a step that turns one batch into a dict of columns; ``schema`` is Spark DDL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield to_batch(step(batch), types)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def to_batch(columns: dict, types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in types], schema=types)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
