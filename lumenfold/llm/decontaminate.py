"""Benchmark decontamination with suffix arrays of the training texts.

The benchmark's words get numbers.  Each batch of documents is a shard: its words become numbers (0 for a word that no
item has, which also ends a document), and its suffix array lists, in the order of their first ``window`` words, the
places where a match could start at all.  Every suffix of every item is then searched for by bisection; the range of
equal places is every verbatim occurrence of the suffix's first ``window`` words.  Occurrences one word further on in
both texts continue a match, so joining them along diagonals gives the longest verbatim matches and where they are.

The benchmark is a stated query set.  The driver numbers its words and cuts its windows in blocks of at most
``block_bytes`` of text each, one after the other, and each block is shipped as arrays, once to a worker.  With one block
no row is shuffled; with several the blocks' findings of a document meet by its row.

Cases: a null text or item has no words; an item of fewer than ``window`` words is searched for as a whole; repeated
items with one id count once; repeated documents are judged one by one; empty tables give no findings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOW = bytes(range(256)).lower()
#: Digits, a to z and every byte of a non-ASCII character stay; the rest parts words.
TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in _LOW)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


class Benchmark:
    """Word numbers and suffixes of one block of items [(item id as text, text)]."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = 8):
        self.window, self.vocabulary = window, {}
        self.names, self.texts = [], []
        for name, text in items:
            if words := words_of(text):
                self.names.append(name)
                self.texts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], ">u4"))
        #: For each window length: item numbers, places in the items, and the windows as comparable bytes.
        self.windows = {}
        lengths = np.array([min(window, len(t)) for t in self.texts], np.int64)
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            count = np.array([len(self.texts[k]) - n + 1 for k in own], np.int64)
            ids = np.concatenate([self.texts[k] for k in own])
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            first = np.cumsum([0, *(len(self.texts[k]) for k in own[:-1])])
            self.windows[n] = np.repeat(own, count), at, _keys(np.lib.stride_tricks.sliding_window_view(ids, n)[np.repeat(first, count) + at])
        self.least = min(self.windows, default=0)
        del self.texts


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class Shard:
    """The suffix array of a batch of texts against one block."""

    def __init__(self, texts: list[list[bytes]], bench: Benchmark):
        self.bench, number = bench, bench.vocabulary.get
        self.lengths = [len(t) for t in texts]
        self.starts = np.cumsum([0, *(n + 1 for n in self.lengths)])
        self.ids = np.zeros(int(self.starts[-1]) + bench.window, np.int64)
        for at, words in zip(self.starts, texts):
            self.ids[at : at + len(words)] = np.fromiter((number(w, 0) for w in words), np.int64, len(words))
        live = np.ones(len(self.ids) - bench.window, bool)
        for k in range(bench.least):
            live &= self.ids[k : len(live) + k] > 0
        place = np.flatnonzero(live)
        rows = self.ids[place[:, None] + np.arange(bench.window)]
        rows[np.cumsum(rows == 0, axis=1) > 0] = 0  # nothing counts beyond an unknown word
        keys = _keys(rows) if len(place) else np.zeros(0, f"S{4 * bench.window}")
        order = np.argsort(keys, kind="stable")
        self.keys, self.place = keys[order], place[order]

    def occurrences(self) -> np.ndarray:
        """Rows (item number, place in the item, place in the shard, words): each window wherever it occurs."""
        found = []
        for n, (item, at, keys) in self.bench.windows.items():
            low = np.searchsorted(self.keys, keys, "left")
            high = np.searchsorted(self.keys, _after(keys, n, self.bench.window), "left")
            count = high - low
            which = np.repeat(np.arange(len(keys)), count)
            spot = self.place[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
            found.append(np.stack([item[which], at[which], spot, np.full(len(which), n)], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def _after(keys: np.ndarray, n: int, window: int) -> np.ndarray:
    """The first key beyond all that start with these ``n`` words."""
    rows = np.frombuffer(keys.tobytes(), ">u4").reshape(len(keys), n).astype(np.int64)
    rows[:, -1] += 1
    return _keys(np.pad(rows, ((0, 0), (0, window - n))))


def longest(occurrences: np.ndarray) -> np.ndarray:
    """Rows (item number, place in the item, place in the shard, words) of the longest matches: occurrences on one
    diagonal that touch or overlap are one."""
    if not len(occurrences):
        return occurrences
    item, at, spot, n = occurrences.T
    order = np.lexsort((spot, spot - at, item))
    item, at, spot, n = (x[order] for x in (item, at, spot, n))
    new = np.ones(len(order), bool)
    new[1:] = (item[1:] != item[:-1]) | ((spot - at)[1:] != (spot - at)[:-1]) | (spot[1:] != spot[:-1] + 1)
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(order)) - 1
    return np.stack([item[first], at[first], spot[first], spot[last] + n[last] - spot[first]], axis=1)


def _judge(shard: Shard) -> list[tuple[int, list[tuple[int, int]], list[str], list[tuple]]]:
    """For each text: words, hit intervals [start, end), items found, matches (item, place there, place here, words)."""
    out = [(n, [], set(), []) for n in shard.lengths]
    for k, at, spot, n in longest(shard.occurrences()).tolist():
        doc = int(np.searchsorted(shard.starts, spot, "right")) - 1
        own, name = spot - int(shard.starts[doc]), shard.bench.names[k]
        out[doc][1].append((own, own + n))
        out[doc][2].add(name)
        out[doc][3].append((name, at, own, n))
    return [(n, spans, sorted(items), sorted(matches)) for n, spans, items, matches in out]


def covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items (item_id, text) that have an id and a text, sorted, in blocks; one block is held at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("text")).where("name IS NOT NULL AND text IS NOT NULL")
    block, size = [], 0
    for r in rows.orderBy("name", "text").toLocalIterator():
        if block and size + len(r.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.name, r.text))
        size += len(r.text)
    yield block


def _shards(batch: pa.RecordBatch, column: int, bench: Benchmark, words: int) -> Iterator[tuple[int, list]]:
    """(first row, findings) of runs of rows of about so many words each; a long text is one shard, whole."""
    texts, first, held = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        texts.append(words_of(text.as_py()))
        held += len(texts[-1])
        if held >= words or i == batch.num_rows - 1:
            yield first, _judge(Shard(texts, bench))
            texts, first, held = [], i + 1, 0


FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>, matches array<struct<item_id: string, item_start: long, doc_start: long, words: long>>"


def find(docs: DataFrame, benchmark: DataFrame, window: int = 8, block_bytes: int = 8 << 20, shard_words: int = 500_000) -> DataFrame:
    """(doc_id, n_words, n_hit, items, matches) for each document; ``matches`` holds its longest verbatim matches."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, parts = docs.sparkSession, []
    for block in blocks_of(benchmark, block_bytes):
        held = spark.sparkContext.broadcast(Benchmark(block, window))  # a block's windows, some ten times block_bytes at most

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bench = held.value
            for batch in batches:
                for first, rows in _shards(batch, 1, bench, shard_words):
                    n, spans, items, matches = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array(n, pa.int64()), pa.array([covered(s) for s in spans], pa.int64()), *(pa.array(c, t) for c, t in zip((([{"start": a, "end": b} for a, b in s] for s in spans), items, ([dict(zip(("item_id", "item_start", "doc_start", "words"), m)) for m in ms] for ms in matches)), types))], names)

        names = ["doc_id", "n_words", "n_hit", "spans", "items", "matches"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = (span, pa.list_(pa.string()), pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("words", pa.int64())])))
        parts.append((own, run))
    schema = f"doc_id long, {FOUND.replace('n_words long, ', 'n_words long, n_hit long, ')}"
    if len(parts) == 1:
        return own.mapInArrow(parts[0][1], schema).drop("spans")
    from .common import save

    rows = save(own.withColumn("row", F.monotonically_increasing_id()), "documents")  # the row's number must not change between blocks
    whole = None
    for _, run in parts:
        part = rows.select(F.col("row").alias("doc_id"), "text").mapInArrow(run, schema)
        whole = part if whole is None else whole.unionByName(part)
    flat = whole.groupBy(F.col("doc_id").alias("row")).agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).cast("long").alias("n"), F.greatest(a["reach"], s["end"]).alias("reach"))
    hit = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")), step, lambda a: a["n"])
    return rows.select("row", "doc_id").join(flat, "row").select("doc_id", "n_words", hit.alias("n_hit"), "items", "matches")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, **how) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = find(docs, benchmark, **how)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, window: int = 8, block_bytes: int = 8 << 20, shard_words: int = 500_000) -> DataFrame:
    """The documents, with all columns, in which fewer than ``min_items`` items occur."""
    spark, where = docs.sparkSession, docs.columns.index("text")
    blocks = [spark.sparkContext.broadcast(Benchmark(b, window)) for b in blocks_of(benchmark, block_bytes)]

    def items_of(batch: pa.RecordBatch, column: int, bench: Benchmark) -> Iterator[tuple[int, list[str]]]:
        for first, rows in _shards(batch, column, bench, shard_words):
            for i, (_, _, found, _) in enumerate(rows):
                yield first + i, found

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([len(found) < min_items for _, found in items_of(batch, where, blocks[0].value)], pa.bool_()))

    if len(blocks) == 1:
        return docs.mapInArrow(keep, docs.schema)
    from .common import save

    row = "row_number"
    while row in docs.columns:
        row += "_"
    rows, found = save(docs.withColumn(row, F.monotonically_increasing_id()), "documents"), None
    for held in blocks:

        def name(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [(batch.column(0)[i].as_py(), item) for i, own in items_of(batch, 1, held.value) for item in own]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.string())], ["row", "item"])

        part = rows.select(row, F.col("text").cast("string").alias("text")).mapInArrow(name, "row long, item string")
        found = part if found is None else found.unionByName(part)
    bad = found.groupBy("row").agg(F.count_distinct("item").alias("n")).where(F.col("n") >= min_items).select(F.col("row").alias(row))
    return rows.join(bad, row, "left_anti").select(docs.columns)
