"""Quality classifier: a generalised additive model with pairwise interactions.

A document has some 20 numbers, all counted over its whole text.  Each number falls into one of its quantile bins.  The
model is an intercept, a lookup table for each number and one for each chosen pair of numbers; a score is the sigmoid of
the sum of the looked-up values.  The tables are learned by cyclic boosting: round after round, each number in turn gets
a shallow tree on the current gradient, of which a small share is added to its table.  Then the pairs whose two-way cut
lowers the loss most are boosted the same way.

Fitting takes at most ``rows`` labelled rows (the documented bound), chosen by a hash of the id.  Rows weigh so that both
labels count alike, up to ``balance``.

Cases: null and empty texts have all-zero counts and are scored as any other; unlabelled rows teach nothing; several
labels of one id count as several rows; with no label the score is 0.5 everywhere; with one, the model leans to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_share", "top_share", "repeat_share", "long_share", "short_share",
    "upper_share", "lower_share", "digit_share", "space_share", "bar_share", "bang_share", "comma_stop_share", "symbol_share",
    "other_share", "words_a_line", "distinct_line_share", "odd_word_share", "upper_word_share", "words_a_sentence",
)
_SYMBOLS = np.frombuffer(b"#$%&*@^~`<>{}[]\\/_=+", np.uint8)
_ODD = re.compile(rb"^[^A-Za-z0-9\x80-\xff]+$|[#$%&*@!|]{2,}")


def features_of(text: str | None) -> list[float]:
    """The numbers of ``FEATURES``, over the whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = np.zeros(256)
    for at in range(0, len(data), 1 << 20):
        size += np.bincount(np.frombuffer(data, np.uint8, min(1 << 20, len(data) - at), at), minlength=256)
    n = max(1, len(data))
    words = data.split()
    count, w = Counter(words), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    odd = sum(k for x, k in count.items() if _ODD.search(x))
    upper = sum(k for x, k in count.items() if len(x) > 1 and x.isupper())
    ends = size[46] + size[33] + size[63]
    return [
        np.log1p(len(data)), np.log1p(len(words)), lengths.sum() / w, len(count) / w, max(count.values(), default=0) / w, repeats / w, (lengths > 12).sum() / w, (lengths < 4).sum() / w,
        size[65:91].sum() / n, size[97:123].sum() / n, size[48:58].sum() / n, size[[32, 9, 10, 13]].sum() / n, size[124] / n, size[33] / n, (size[44] + size[46]) / n, size[_SYMBOLS].sum() / n,
        size[128:].sum() / n, w / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), odd / w, upper / w, w / max(1.0, ends),
    ]


def grow(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, size: int, leaves: int, ridge: float) -> np.ndarray:
    """A tree of so many leaves on one binned number: its value for each bin."""
    g, h = np.bincount(bins, gradient, size), np.bincount(bins, hessian, size)
    cuts, parts = [0, size], []

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        left, lh = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        total, th = g[a:b].sum(), h[a:b].sum()
        gain = left**2 / (lh + ridge) + (total - left) ** 2 / (th - lh + ridge) - total**2 / (th + ridge)
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    parts = [(*best(0, size), 0, size)]
    while len(cuts) <= leaves:
        gain, at, a, b = max(parts)
        if gain <= 1e-9:
            break
        parts.remove((gain, at, a, b))
        cuts.append(at)
        parts += [(*best(a, at), a, at), (*best(at, b), at, b)]
    out = np.zeros(size)
    cuts = sorted(cuts)
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def grow_pair(i: np.ndarray, j: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, size: int, ridge: float) -> tuple[np.ndarray, float]:
    """The best tree of depth two on a pair: one cut on the first number, and on each side its own on the second."""
    at = i * size + j
    g, h = (np.bincount(at, v, size * size).reshape(size, size) for v in (gradient, hessian))
    best, table = 0.0, np.zeros((size, size))
    up_g, up_h = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    total = g.sum() ** 2 / (h.sum() + ridge)
    sides = []
    for sg, sh in ((up_g[:-1], up_h[:-1]), (up_g[-1] - up_g[:-1], up_h[-1] - up_h[:-1])):
        lg, lh = np.cumsum(sg, axis=1)[:, :-1], np.cumsum(sh, axis=1)[:, :-1]
        rg, rh = sg.sum(axis=1, keepdims=True) - lg, sh.sum(axis=1, keepdims=True) - lh
        sides.append((lg**2 / (lh + ridge) + rg**2 / (rh + ridge), lg / (lh + ridge), rg / (rh + ridge)))
    gain = sides[0][0].max(axis=1) + sides[1][0].max(axis=1) - total
    if len(gain) and gain.max() > 1e-9:
        k = int(np.argmax(gain))
        best = float(gain[k])
        for (score, low, high), rows in zip(sides, (slice(0, k + 1), slice(k + 1, size))):
            c = int(np.argmax(score[k]))
            table[rows, : c + 1], table[rows, c + 1 :] = low[k, c], high[k, c]
    return table, best


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 12, pairs: int = 8, rounds: int = 250, pair_rounds: int = 100, rate: float = 0.08, leaves: int = 3, ridge: float = 2.0, balance: float = 4.0):
        x, y = np.asarray(x, float).reshape(-1, len(FEATURES)), np.asarray(y, float)
        cut = lambda k: [np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.edges, self.pair_edges = cut(bins), cut(pair_bins)
        ones = y.sum()
        if not len(y):
            self.intercept, self.tables, self.pairs = 0.0, [np.zeros(len(e) + 1) for e in self.edges], []
            return
        few = min(ones, len(y) - ones)
        heavy = min(balance, max(ones, len(y) - ones) / max(1, few))
        weight = np.where(y == (0 if ones > len(y) / 2 else 1), heavy, 1.0)
        p = ((weight * y).sum() + 1) / (weight.sum() + 2)
        self.intercept = float(np.log(p / (1 - p)))
        b = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        logit = np.full(len(y), self.intercept)

        def slope() -> tuple[np.ndarray, np.ndarray]:
            q = 1 / (1 + np.exp(-logit))
            return weight * (y - q), weight * q * (1 - q)

        for _ in range(rounds):
            for k, table in enumerate(self.tables):
                if len(table) > 1:
                    step = rate * grow(b[k], *slope(), len(table), leaves, ridge)
                    table += step
                    logit += step[b[k]]
        c = [np.searchsorted(e, v, "right") for e, v in zip(self.pair_edges, x.T)]
        slopes = slope()
        gains = sorted(((grow_pair(c[i], c[j], *slopes, pair_bins, ridge)[1], -i, -j) for i, j in combinations(range(len(c)), 2)), reverse=True)
        self.pairs = [(-i, -j, np.zeros((pair_bins, pair_bins))) for gain, i, j in gains[:pairs] if gain > 0]
        for _ in range(pair_rounds):
            for i, j, table in self.pairs:
                step = rate * grow_pair(c[i], c[j], *slope(), pair_bins, ridge)[0]
                table += step
                logit += step[c[i], c[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Bin additions over a block of rows."""
        x = np.asarray(x, float).reshape(-1, len(FEATURES))
        logit = np.full(len(x), self.intercept)
        for e, t, v in zip(self.edges, self.tables, x.T):
            logit += t[np.searchsorted(e, v, "right")]
        for i, j, t in self.pairs:
            logit += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-logit))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = 8000) -> Model:
    """Learns ``quality`` of labels (doc_id, quality) from documents (doc_id, text), with at most ``rows`` labels."""
    known = labels.where(usable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    n = known.count()
    if not n:
        return Model(np.zeros((0, len(FEATURES))), np.zeros(0))
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) / 1_000_000
    some = known.where(drawn < min(1.0, 1.3 * rows / n)).orderBy(drawn, "doc_id", "quality").limit(rows)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text")  # at most ``rows`` rows of two numbers

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array([features_of(t.as_py()) for t in batch.column(2)], pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    got = sorted(picked.mapInArrow(measure, "doc_id long, quality long, x array<double>").orderBy("doc_id", "quality", F.xxhash64("x")).limit(rows).collect())  # an id that repeats can't bring more
    return Model(np.array([r["x"] for r in got]), np.array([r["quality"] for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score([features_of(t.as_py()) for t in batch.column(1)]))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, with all columns, that score ``least`` or more."""
    held, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(held.value.score([features_of(t.as_py()) for t in batch.column(where)]) >= least))

    return docs.mapInArrow(run, docs.schema)
