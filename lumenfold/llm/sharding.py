"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``nodes`` points on a ring of 2^32 places; a point owns the arc that ends at it.  A document's place is a
hash of its id and its text's checksum.  It goes to the owner of its arc unless that shard is full: then it continues
clockwise to the next point whose shard has room.  A shard's capacity is an equal share of all bytes times 1 + ``slack``; with no slack all
shards end full, that is equal but for the documents at the cuts.

The walk runs over arcs, not documents: Spark sums the bytes of each arc (at most shards * nodes rows, a bound that the
input doesn't change) and the driver fills the shards.  The heaviest arcs go first.  An arc stays at home if it fits; else it
moves clockwise to the first point whose shard can take it.  Where no shard has room for a whole arc it is cut at byte
marks among those with room, clockwise; its documents, in order of size and place, find theirs by the bytes before
them.  Those are the lightest arcs, so a shard exceeds its capacity by less than one document of each.

A slot counts the shard's documents before this one: those of earlier arcs, from the counts of whole or cut arcs, and
those before it in its own arc.  All windows are over single arcs.

Cases: a null text has no bytes (size 8) and no checksum; a null id hashes as such; repeated rows lie side by side on the
ring and are ordered arbitrarily among themselves; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

RING = 1 << 32


def ring(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the points in ring order, and the shard of each.  A shard's points don't depend on the other shards."""
    place = np.array([xxhash.xxh32_intdigest(b"%d:%d" % (s, v), 1) for s in range(shards) for v in range(nodes)], np.int64)
    owner = np.repeat(np.arange(shards), nodes)
    order = np.lexsort((owner, place))
    return place[order], owner[order]


def fill(load: np.ndarray, owner: np.ndarray, shards: int, slack: float) -> list[list[tuple[int, int]]]:
    """For each arc the shards that take its bytes in turn, [(shard, bytes)], clockwise from its own."""
    room = np.full(shards, -(-int(load.sum() * (1 + slack)) // shards), np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in load]
    over = []
    for arc in np.argsort(-load, kind="stable").tolist():
        n, s = int(load[arc]), int(owner[arc])
        if n <= room[s]:
            room[s] -= n
            out[arc].append((s, n))
        else:
            over.append((arc, n))
    for arc, n in over:  # clockwise: from its own point on to the next points
        whole, at = room.max() >= n, arc
        while n:
            s = int(owner[at])
            here = min(n, int(room[s]))
            if here == n or here and not whole:
                room[s] -= here
                n -= here
                out[arc].append((s, here))
            at = (at + 1) % len(load)
    return out


def located(docs: DataFrame, shards: int, nodes: int) -> DataFrame:
    """(doc_id, size, text_crc32, place, arc) for each row."""
    text = F.col("text").cast("string").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("place", F.xxhash64(F.lit(2), "doc_id", "text_crc32").bitwiseAND(RING - 1))
    held = docs.sparkSession.sparkContext.broadcast(ring(shards, nodes)[0])  # shards * nodes numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arc = np.searchsorted(held.value, batch.column(3).to_numpy(), "left") % max(1, len(held.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arc, pa.int32())], ["doc_id", "size", "text_crc32", "place", "arc"])

    return rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, place long, arc int")


def shard(docs: DataFrame, shards: int = 24, nodes: int = 2048, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, home) for each row; ``home``: the owner of the row's arc."""
    spark = docs.sparkSession
    rows = save(located(docs, shards, nodes), "located")
    load, (_, owner) = np.zeros(shards * nodes, np.int64), ring(shards, nodes)
    for r in rows.groupBy("arc").agg(F.sum("size").alias("n")).collect():  # at most shards * nodes rows
        load[r["arc"]] = r["n"]
    plan = fill(load, owner, shards, slack)
    marks, to, first = [], [], np.zeros(len(plan) + 1, np.int64)
    for arc, parts in enumerate(plan):
        marks += np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
        to += [s for s, _ in parts]
        first[arc + 1] = len(to)
    held = spark.sparkContext.broadcast((first, np.array(marks, np.int64), np.array(to, np.int32), owner.astype(np.int32)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, marks, to, owner = held.value
        for batch in batches:
            arc, before = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            part, last = first[arc].copy(), first[arc + 1] - 1
            while (on := (part < last) & (marks[np.minimum(part + 1, len(marks) - 1)] <= before)).any():
                part += on
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(to[part]), pa.array(owner[arc])], ["doc_id", "size", "text_crc32", "place", "arc", "shard", "home"])

    inside = Window.partitionBy("arc").orderBy(F.desc("size"), "place", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    ordered = rows.withColumn("before", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = save(ordered.mapInArrow(assign, "doc_id long, size long, text_crc32 long, place long, arc int, shard int, home int"), "placed")
    counts = placed.groupBy("arc", "shard").agg(F.count("*").alias("n"))
    base = np.zeros(shards, np.int64)
    starts = []
    for r in sorted(counts.collect()):  # as many as arcs and their cuts
        starts.append((r["arc"], r["shard"], int(base[r["shard"]])))
        base[r["shard"]] += r["n"]
    start = spark.createDataFrame(starts, "arc int, shard int, base long")
    nth = F.row_number().over(Window.partitionBy("arc", "shard").orderBy("place", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"))
    return placed.withColumn("nth", nth).join(start, ["arc", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"), "home")
