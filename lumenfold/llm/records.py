"""Token ids as length-delimited binary records, with a separate offset index.

File format (every number little-endian)::

    file   := frame(header) frame(record)* 0x0A
    frame  := length u64 | masked crc32 of those 8 bytes u32 | payload | masked crc32 of the payload u32
    header := "LFREC1" | part u32 | chunk u32 | end id u32
    record := id i64 | flags u8 (1: the id is null) | width u8 (2 or 4) | n u32 | n token ids of that width

The mask rotates the checksum right by 15 bits and adds a constant, so that a checksum of data that holds
checksums stays useful.  A file is one row of Spark's text sink (which ends it with a line feed), so files are
committed, retried and placed on any Hadoop file system as any other table; a file holds ``chunk_bytes`` or one
record more.  Ids that fit take two bytes each.

Cases: a null text counts as empty and gives just the end id; a null id sorts first and stays null; rows with one id
are ordered by the text's checksum; an empty table gives no file, an empty index and no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .wordpiece import encoder

MAGIC = b"LFREC1"
#: Fixed value of the format.
MASK_DELTA = 0xA282EAD8
INDEX = "part long, chunk long, seq long, doc_id long, byte_offset long, byte_length long, start_in_file long, n_tokens long, ids_crc32 long, file string"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each frame; raises ValueError on a checksum that doesn't hold or a cut file."""
    at, end = 0, len(data) - 1
    if data[-1:] != b"\n":
        raise ValueError("the file is cut short")
    while at < end:
        if at + 12 > end or struct.unpack_from("<I", data, at + 8)[0] != masked(data[at : at + 8]):
            raise ValueError(f"bad length at byte {at}")
        n = struct.unpack_from("<Q", data, at)[0]
        payload = data[at + 12 : at + 12 + n]
        if at + 16 + n > end or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
            raise ValueError(f"bad record at byte {at}")
        yield at, payload
        at += 16 + n


def record(doc_id: int | None, ids: bytes) -> bytes:
    """ids: unsigned 32-bit."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 65536
    return struct.pack("<qBBI", doc_id or 0, doc_id is None, 2 if narrow else 4, len(wide)) + (wide.astype("<u2").tobytes() if narrow else ids)


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width, n = struct.unpack_from("<qBBI", payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", n, 14).astype("<u4")


class Bounds(NamedTuple):
    """Keys that end all partitions but the last."""

    keys: np.ndarray

    @staticmethod
    def key(doc_id: np.ndarray, null: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Ids, null first, then marks, as byte strings that sort alike."""
        out = np.zeros(len(doc_id), [("has", "u1"), ("id", ">u8"), ("mark", ">u8"), ("end", "u1")])
        out["has"], out["id"], out["mark"], out["end"] = ~null, np.where(null, 0, doc_id).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), mark, 1
        return out.view("S18")

    def place(self, key: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The partition of each key; keys that end several partitions are dealt over them."""
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        return low + turn % np.maximum(1, high - low)


def _bounds(rows: DataFrame, part_bytes: int, most_parts: int = 50_000, sample: int = 1_000_000) -> tuple[Bounds, int, int]:
    """Bounds of partitions of about ``part_bytes`` of text each, from a sample of keys of bounded size, their number, and in
    how many tasks the rows are read."""
    sized = rows.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("mark"), (F.octet_length("text") + 16).alias("size"))
    each = sized.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(16))).alias("size"))
    n, total, tasks = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = int(max(1, min(most_parts, -(-total // part_bytes))))
    if parts == 1:
        return Bounds(np.zeros(0, "S18")), 1, tasks
    share = min(1.0, min(sample, 64 * parts) / n)
    drawn = sized.where(F.rand(11) < share).toArrow()  # so many rows at most, but for chance
    null = drawn["doc_id"].is_null().to_numpy()
    key = Bounds.key(drawn["doc_id"].fill_null(0).to_numpy(), null, drawn["mark"].fill_null(0).to_numpy())
    order = np.argsort(key, kind="stable")
    reach = np.cumsum(drawn["size"].fill_null(16).to_numpy()[order])
    at = np.searchsorted(reach, reach[-1] * np.arange(1, parts) / parts) if len(reach) else np.zeros(0, np.int64)
    return Bounds(key[order][at]), len(at) + 1, tasks


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, chunk_bytes: int = 4 << 20, part_bytes: int = 24 << 20) -> None:
    """Encodes each whole text (columns doc_id, text) and writes the records in ascending doc_id order under path/data.

    Texts are encoded where they are read; only framed records go through the exchange, to partitions whose bounds come
    from the ids and checksums, so nothing is encoded twice.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds, parts, tasks = _bounds(rows, part_bytes)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if tasks < cores:  # a file of few row groups
        rows = rows.repartition(cores)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, seen = encoder(tokenizer), struct.pack("<I", end_id), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            held, size, first = [], 0, 0
            for i, (doc_id, text) in enumerate(zip(ids.to_pylist(), texts)):
                held.append(frame(record(doc_id, enc.bytes_of(text.as_py()) + end)))
                size += len(held[-1])
                if size >= chunk_bytes or i == len(ids) - 1:
                    mark = batch.column(2).slice(first, len(held)).fill_null(0).to_numpy()
                    own = ids.slice(first, len(held))
                    key = Bounds.key(own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), mark)
                    part = bounds.place(key, seen + np.arange(len(held)))
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), own, pa.array(mark, pa.int64()), pa.array(held, pa.binary())], ["part", "doc_id", "mark", "frame"])
                    seen, first, held, size = seen + len(held), i + 1, [], 0

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = 0, [], 0
        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else 0
            for f in batch.column(1):
                held.append(f.as_py())
                size += len(held[-1])
                if size >= chunk_bytes:
                    yield file(part, chunk, held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield file(part, chunk, held)

    def file(part: int, chunk: int, held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([frame(MAGIC + struct.pack("<III", part, chunk, end_id)) + b"".join(held)], pa.binary())], ["value"])

    marked = rows.select("doc_id", "text", F.crc32(F.col("text").cast("binary")).alias("mark")).mapInArrow(encode, "part int, doc_id long, mark long, frame binary")
    ordered = marked.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "mark").select("part", "frame")
    ordered.mapInArrow(join, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/data")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select("path", "content")


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Walks every file, checks both checksums of each frame, and writes path/index: a row for each record."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                data, rows, start = content.as_py(), [], 0
                for at, payload in frames(data):
                    if at == 0:
                        if payload[:6] != MAGIC:
                            raise ValueError(f"not a record file: {name}")
                        part, chunk, _ = struct.unpack_from("<III", payload, 6)
                        continue
                    doc_id, ids = parse(payload)
                    rows.append((len(rows), doc_id, at, len(payload) + 16, start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                for i in range(0, len(rows), 50_000):
                    cols = list(zip(*rows[i : i + 50_000]))
                    n = len(cols[0])
                    yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int64()) for v in (part, chunk)] + [pa.array(c, pa.int64()) for c in cols] + [pa.array([name.as_py()] * n)], names)

    names = [c.split()[0] for c in INDEX.split(", ")]
    _files(spark, path).mapInArrow(walk, INDEX).write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with ``start``: the ids of all records before, in file order.  One row a file meets in one task."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    files = index.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("ids"))
    before = files.select("part", "chunk", F.coalesce(F.sum("ids").over(Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return index.join(before, ["part", "chunk"]).withColumn("start", F.col("before") + F.col("start_in_file")).drop("before")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the index rows in ``wanted``: only those byte ranges are decoded, each checked."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1).to_pylist()):
                data = content.as_py()
                for i in range(0, len(places), 256):
                    got = [parse(next(frames(data[p["byte_offset"] : p["byte_offset"] + p["byte_length"]] + b"\n"))[1]) for p in places[i : i + 256]]
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([x for _, x in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    places = wanted.groupBy("file").agg(F.collect_list(F.struct("byte_offset", "byte_length")).alias("places"))  # as many as one file holds
    return _files(spark, path).join(places, F.col("path") == F.col("file")).select("content", "places").mapInArrow(cut, "doc_id long, ids array<long>")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """Every record (doc_id, ids) in an order that the seed decides, through the index."""
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return fetch(spark, path, read_index(spark, path)).repartitionByRange(rank, "doc_id").sortWithinPartitions(rank, "doc_id")
