"""Approximate nearest neighbours by inner product: an adaptive dimension scan within probed lists.

Vectors get one more component so that all have one norm; then the largest inner product is the smallest distance.  All
are turned by one random rotation, which spreads a distance evenly over the components.  Rows go to the nearest of
``lists`` centroids (as many as half the square root of the rows, 1,024 at most, unless given), fitted on at most ``sample``
rows, the documented bound; every row is indexed.  A query reads a ``share`` of the lists, nearest first, and goes on to
further ones until they hold ``k`` other rows; unless given, the share is the least that holds ``recall`` of the
neighbours of 256 sampled rows within the sample.  Within a list its best so far come from the first rows; for the others
the distance is summed over blocks of columns, and after each block a row is abandoned if the distance so far, scaled
up, exceeds the bound of a hypothesis test at the ``confidence`` factor.  What survives is measured on the original
vectors, in double precision.

A list is cut into blocks of ``block`` rows and its queries into blocks of as many, so no list, however large, meets in
one task; a task keeps each query's best ``k`` of its block, and a window merges those.

Cases: vectors that are null, zero, hold a null or non-finite component or have another length than most take no part,
nor do rows without an id; rows with the query's id are its own; ties go to the smaller id; with no valid row the result
is empty; fewer candidates than ``k`` are all given.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

STEPS = (16, 32, 48)
CHUNKS = (0, 64, 512)
#: Queries whose distances to a block are held at once, pairs gathered at once, and the share of live pairs below which pairs are followed singly.
GROUP, PAIRS, SPARSE = 256, 65_536, 0.1


def rotation(size: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def centroids_of(x: np.ndarray, lists: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k-means centres of the rows; a centre that loses its rows stays where it was."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, centre)[:, 0]
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.bincount(own, minlength=len(centre))
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the ``n`` nearest centres, nearest first."""
    score = (centre**2).sum(axis=1)[None, :] - 2 * x @ centre.T
    return np.argmin(score, axis=1)[:, None] if n == 1 else np.argsort(score, axis=1, kind="stable")[:, :n]


def widened(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, norm * norm - (x * x).sum(axis=1)))
    return np.hstack([x, extra[:, None]])


def scan(ids: np.ndarray, x: np.ndarray, turned: np.ndarray, own: np.ndarray, q: np.ndarray, tq: np.ndarray, k: int, confidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the best ``k`` of a block of rows for each of a block of queries.

    The rows come in ``CHUNKS``.  Those before give each query its edge, the distance of its k-th best so far; a pair
    whose distance over the first columns, scaled up, exceeds the test's bound is abandoned.  Distances of the pairs that
    live are sums of products of whole blocks while those are many, and of single pairs after that.
    """
    got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    reach, size, norm2 = np.full(len(q), -np.inf), tq.shape[1], float((turned[0] ** 2).sum()) if len(turned) else 0.0
    asked, ordered = (tq**2).sum(axis=1), np.sort(ids)
    copies = int((np.searchsorted(ordered, own, "right") - np.searchsorted(ordered, own, "left")).max(initial=0))  # rows with a query's own id
    for low, high in pairwise((*(c for c in CHUNKS if c < len(ids)), len(ids))):
        edge = np.maximum(0.0, norm2 + asked - 2 * reach)
        i, j = _live(tq, turned[low:high], edge, confidence, k + copies)
        more = np.concatenate([(x[low + j[at : at + PAIRS]] * q[i[at : at + PAIRS]]).sum(axis=1) for at in range(0, len(i), PAIRS)] or [np.zeros(0)])
        other = ids[low + j] != own[i]
        i, found, score = (np.concatenate([was, now[other]]) for was, now in zip(got, (i, ids[low + j], more)))
        order = np.lexsort((found, -score, i))
        i, found, score = i[order], found[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        reach[i[rank == k - 1]] = score[rank == k - 1]
        got = tuple(c[rank < k] for c in (i, found, score))
    return got


def _live(tq: np.ndarray, turned: np.ndarray, edge: np.ndarray, confidence: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that no test abandons, of each query's the ``k`` nearest and what is as near but for rounding; an
    infinite edge lets every row through."""
    size, out = tq.shape[1], []
    steps = [*(s for s in STEPS if s < size), size]
    for first in range(0, len(tq), GROUP):
        q, e = tq[first : first + GROUP], edge[first : first + GROUP]
        far, at, i, j = np.zeros((len(q), len(turned))), 0, None, None
        for to in steps:
            bound = e * (1 + (confidence / np.sqrt(to) if to < size else 1e-9)) ** 2 * (to / size) + 1e-9
            a, b = q[:, at:to], turned[:, at:to]
            if i is None:
                far += (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
                live = far <= bound[:, None]
                if live.mean() < SPARSE:
                    i, j = np.nonzero(live)
                    far = far[i, j]
                else:
                    far[~live] = np.inf
            else:
                for start in range(0, len(i), PAIRS):
                    own = slice(start, start + PAIRS)
                    far[own] += ((b[j[own]] - a[i[own]]) ** 2).sum(axis=1)
                live = far <= bound[i]
                i, j, far = i[live], j[live], far[live]
            at = to
        if i is None:
            if far.shape[1] > k:
                far[far > np.partition(far, k, axis=1)[:, k, None] * (1 + 1e-9) + 1e-9] = np.inf
            i, j = np.nonzero(np.isfinite(far))
        elif len(i) > k:
            order = np.lexsort((far, i))
            start = np.searchsorted(i[order], i[order])
            last = np.minimum(start + k, np.searchsorted(i[order], i[order], "right") - 1)
            near = order[far[order] <= far[order][last] * (1 + 1e-9) + 1e-9]
            i, j = i[near], j[near]
        out.append((i + first, j))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def share_for(x: np.ndarray, norm: float, turn: np.ndarray, centre: np.ndarray, k: int, recall: float, queries: int = 256) -> float:
    """The least share of the lists that holds ``recall`` of the true neighbours of some sampled rows among the sample.  A
    sample is sparser than the table, so its neighbours lie farther apart and the share is rather too large."""
    q = x[:: max(1, len(x) // queries)]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q)) * max(1, len(x) // queries)] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, : max(1, min(k, len(x) - 1))]
    own = nearest(widened(x, norm, False) @ turn, centre)[:, 0]
    place = np.argsort(nearest(widened(q, norm, True) @ turn, centre, len(centre)), axis=1)
    depth = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return (depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))] + 1) / len(centre)


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks] or [np.zeros(0)]).astype(np.float64).reshape(-1, size)


def search(vectors: DataFrame, is_query: Column, k: int = 20, lists: int | None = None, share: float | None = None, recall: float = 0.96, confidence: float = 2.5, sample: int = 20_000, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (vec_id, embedding) that ``is_query`` marks, against all others."""
    spark = vectors.sparkSession
    v = F.col("embedding")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(sound)
    norm2 = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy(F.size(v).alias("size")).agg(F.count("*").alias("n"), F.max(norm2).alias("norm2")).orderBy(F.desc("n"), "size").limit(1).collect()
    out = "query_id long, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, norm, n = sizes[0]["size"], float(sizes[0]["norm2"]) ** 0.5, sizes[0]["n"]
    rows = rows.where(F.size(v) == size)
    drawn = F.pmod(F.xxhash64(F.lit(13), "vec_id"), F.lit(1_000_000)) / 1_000_000
    some = rows.where(drawn < min(1.0, 1.2 * sample / n)).orderBy(drawn, "vec_id").limit(sample).select("embedding").collect()
    turn, drawn_rows = rotation(size + 1), np.array([r[0] for r in some])
    centre = centroids_of(widened(drawn_rows, norm, False) @ turn, lists or max(1, min(1024, round(n**0.5 / 2))))
    share = share_for(drawn_rows, norm, turn, centre, k, recall) if share is None else share
    held = spark.sparkContext.broadcast((turn, centre))  # (size + 1 + lists) * (size + 1) numbers
    reach = max(1, min(len(centre), int(np.ceil(share * len(centre)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centre = held.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(nearest(widened(_matrix(batch.column(0), size), norm, False) @ turn, centre)[:, 0], pa.int32())], ["list"])

    filled = np.zeros(len(centre), np.int64)
    for r in rows.select("embedding").mapInArrow(assign, "list int").groupBy("list").count().collect():  # a row for each list
        filled[r["list"]] = r["count"]
    own = rows.where("asks").select("vec_id").distinct().join(rows, "vec_id").groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    needed = k + own  # rows with the query's id are no candidates

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centre = held.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), size)
                own = nearest(widened(x, norm, False) @ turn, centre)[:, 0]
                asks = batch.column(2).to_numpy(zero_copy_only=False)
                probed = nearest(widened(x, norm, True) @ turn, centre, len(centre)) if asks.any() else np.zeros((len(x), 0), np.int64)
                enough = np.maximum(reach, (np.cumsum(filled[probed], axis=1) < needed).sum(axis=1) + 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array([p[:e].tolist() if a else [] for p, e, a in zip(probed, enough, asks)], pa.list_(pa.int32()))], ["vec_id", "embedding", "list", "probes"])

    placed = save(rows.mapInArrow(place, "vec_id long, embedding array<double>, list int, probes array<int>"), "placed")
    asked = placed.where(F.size("probes") > 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.explode("probes").alias("list"))
    count = lambda df: {r["list"]: -(-r["count"] // block) for r in df.groupBy("list").count().collect()}  # noqa: E731  a row for each list
    row_blocks, query_blocks = count(placed), count(asked)
    pick = lambda blocks: F.element_at(F.create_map(*(F.lit(i) for kv in blocks.items() for i in kv)), F.col("list"))
    if not query_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    deal = lambda c, blocks: F.pmod(F.xxhash64(F.lit(17), c), pick(blocks).cast("long")).cast("int")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), pick(blocks) - 1))
    data = placed.where(F.col("list").isin(list(query_blocks))).select("list", deal("vec_id", row_blocks).alias("rb"), spread(query_blocks).alias("qb"), "vec_id", "embedding")
    asked = asked.where(F.col("list").isin(list(row_blocks))).select("list", spread(row_blocks).alias("rb"), deal("query_id", query_blocks).alias("qb"), "query_id", "q")

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        got: tuple = ([], [], [])
        if rows.num_rows and queries.num_rows:
            ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding"), size)
            turned = widened(x, norm, False) @ held.value[0]
            order = np.lexsort((ids, ((turned - turned.mean(axis=0)) ** 2).sum(axis=1)))  # the first rows give the first bound
            ids, x, turned = ids[order], x[order], turned[order]
            q, own = _matrix(queries.column("q"), size), queries.column("query_id").to_numpy()
            i, found, score = scan(ids, x, turned, own, q, widened(q, norm, True) @ held.value[0], k, confidence)
            got = own[i], found, score
        return pa.table([pa.array(g, t) for g, t in zip(got, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    keys = ["list", "rb", "qb"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
