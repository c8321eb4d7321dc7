"""File sources and sinks on any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, filePath, lastModified, size, content) of each file that the path or glob names."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("content").alias("file"), F.element_at(F.split("path", "/"), -1).alias("filePath"), F.col("modificationTime").alias("lastModified"), F.col("length").alias("size"))


def get_text_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, filePath, lastModified, size) with the content as text."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.decode("content", encoding).alias("file"), F.element_at(F.split("path", "/"), -1).alias("filePath"), F.col("modificationTime").alias("lastModified"), F.col("length").alias("size"))


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def save_file(spark: SparkSession, path: str, content: str | bytes) -> None:
    """Writes one file; the content comes from the driver."""
    where, fs = _path(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        out.close()


def delete_file(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.delete(where, False)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | str | None = None, schema: str | None = None) -> DataFrame:
    """Filters and columns reach the scan; partition columns of the path prune folders."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def read_delimited(spark: SparkSession, path: str, schema: str, delimiter: str = ",", header: bool = False, quote: str = '"', escape: str = '"', multiline: bool = False) -> DataFrame:
    """Delimited files in parallel; ``operators.tables.texttable`` takes text that is in a column."""
    return spark.read.csv(path, schema=schema, sep=delimiter, header=header, quote=quote, escape=escape, multiLine=multiline)


def read_json(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = False) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=multiline)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, header_row: int = 0) -> DataFrame:
    """One sheet of a workbook, through pandas in the driver; a sheet has a million rows at most.  Needs an engine such as
    openpyxl."""
    import pandas as pd

    frame = pd.read_excel(path, sheet_name=sheet, header=header_row)
    frame.insert(0, "ROW_ID", range(1, len(frame) + 1))
    return spark.createDataFrame(frame)


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep=delimiter, header=header, escape='"')


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def insert_into(df: DataFrame, name: str) -> None:
    """INSERT INTO name SELECT: by position, as SQL does."""
    df.write.insertInto(name)


def select_into(df: DataFrame, name: str) -> None:
    df.write.saveAsTable(name)
