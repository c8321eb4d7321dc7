"""Vector best-fit packing of token sequences.

A piece of ``l`` tokens takes (l tokens, 1 place, l*l attention cost) of a bin; a bin has a residual capacity in each.
Pieces come in falling length.  Each goes to the open bin that fits it in all three dimensions and scores best, by the
weighted norm of what would be left (``rule="norm"``, least wins) or by the weighted dot product of demand and residual
(``rule="dot"``, greatest wins); where none fits, a bin opens.

Pieces of one length are alike, and so are bins of one residual, so the rule runs on counts: at most ``capacity``
length classes against classes of bins, in the driver, whatever the number of documents.  The cost that is left is
rounded down to 1/``grains`` of its capacity, but not below the square of the tokens left if it is more, which keeps the
bin classes few, never overfills and shuts out no piece that the tokens left have room for.
The plan says for each length: pieces with ranks [lo, lo + n) go to bins [bin, bin + n) at one offset.  Its size depends
on the number of classes, not of rows.  Executors give each piece its rank within its length from per-task counts.

Cases: a null or empty text is one piece, the end id alone; repeated rows are packed one by one; an empty table gives
no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .wordpiece import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def plan_bins(counts: dict[int, int], capacity: int, max_docs: int, max_cost: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.5, 0.5), grains: int = 16) -> tuple[np.ndarray, int]:
    """Rows (length, lo, n, bin, offset), and the number of bins.  Raises ValueError on a piece that no bin can hold."""
    caps = np.array([capacity, max_docs, max_cost], float)
    w, grain = np.array(weights), max(1, max_cost // grains)
    places: list[tuple[int, int, int, int, int]] = []
    ids: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    keys, number = np.zeros((0, 3)), {}
    size = np.zeros(0, np.int64)
    opened = 0

    def clip(t: int, d: int, a: int) -> tuple[int, int, int]:
        rounded = a // grain * grain
        return (t, d, max(rounded, t * t) if a >= t * t else rounded) if t else (0, 0, 0)

    def put(key: tuple[int, int, int], spans: list[tuple[int, int]]) -> None:
        nonlocal keys, size
        if key not in number:
            if len(number) == len(keys):
                keys, size = np.vstack([keys, np.zeros((max(64, len(keys)), 3))]), np.concatenate([size, np.zeros(max(64, len(size)), np.int64)])
            number[key] = len(number)
            keys[number[key]] = key
        ids.setdefault(key, []).extend(spans)
        size[number[key]] += sum(n for _, n in spans)

    def take(key: tuple[int, int, int], n: int) -> list[tuple[int, int]]:
        size[number[key]] -= n
        out, spans = [], ids[key]
        while n:
            at, m = spans.pop()
            if m > n:
                spans.append((at + n, m - n))
                m = n
            out.append((at, m))
            n -= m
        return out

    for length in sorted(counts, reverse=True):
        left, lo = counts[length], 0
        item = np.array([length, 1, length * length], float)
        if left and (item > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while left:
            live = np.flatnonzero((size[: len(number)] > 0) & (keys[: len(number)] >= item).all(axis=1))
            if len(live):
                have = keys[live]
                score = ((w * ((have - item) / caps) ** 2).sum(axis=1)) if rule == "norm" else -(w * (item / caps) * (have / caps)).sum(axis=1)
                key = tuple(int(x) for x in have[np.lexsort((*have.T, score))[0]])
                most = int(size[number[key]])
            else:
                key, most = clip(capacity, max_docs, max_cost), None
            each = min(key[0] // length, key[1], key[2] // (length * length)) if most is None or rule == "norm" else 1  # by the norm a bin just filled stays the best
            bins = left // each if most is None else min(most, left // each)
            if not bins:
                each, bins = left, 1
            if most is None:
                spans, opened = [(opened, bins)], opened + bins
            else:
                spans = take(key, bins)
            for k in range(each):
                for at, n in spans:
                    places.append((length, lo, n, at, capacity - key[0] + k * length))
                    lo += n
            left -= each * bins
            put(clip(key[0] - each * length, key[1] - each, key[2] - each * length * length), spans)
    return np.array(places, np.int64).reshape(-1, 5), opened


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Token pieces of each whole text.  part and nth: the task, and the piece's rank there among pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, end, seen = encoder(tokenizer), TaskContext.get().partitionId(), end_id.to_bytes(4, "little"), {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(enc.bytes_of(text.as_py()) + end)
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * at : 4 * (at + capacity)]
                    n = len(own) // 4
                    rows.append((doc_id, k, at, n, zlib.crc32(own), part, seen.get(n, 0)))
                    seen[n] = seen.get(n, 0) + 1
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j == 1 else pa.int64()) for j, c in enumerate(zip(*rows[i : i + 20_000]))], names)

    names = [c.split()[0] for c in PIECES.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, max_docs: int = 128, max_cost: int = 2048 * 2048, end_id: int = 0, rule: str = "norm") -> DataFrame:
    """Packs documents (doc_id, text) into sequences; a row for each piece (``PACKED``).

    With the defaults a sequence holds 128 pieces at most, which binds where many short documents meet; a whole piece takes
    all the attention cost, so cost can't bind beyond the tokens, but what is left of it steers the choice."""
    spark = docs.sparkSession
    pieces = save(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan, _ = plan_bins(totals, capacity, max_docs, max_cost, rule)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    held = spark.sparkContext.broadcast(plan)  # bounded by the classes of lengths and residuals

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        key = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {f.name: batch.column(f.name) for f in batch.schema}
            length, rank = col["length"].to_numpy(), col["nth"].to_numpy() + col["base"].to_numpy()
            row = np.searchsorted(key, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(col[n] for n in names[:5]), pa.array(plan[row, 3] + rank - plan[row, 1]), pa.array(plan[row, 4])], names)

    names = [c.split()[0] for c in PACKED.split(", ")]
    return pieces.join(base, ["part", "length"]).mapInArrow(assign, PACKED)
