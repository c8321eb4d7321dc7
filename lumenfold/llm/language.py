"""Language identification in two levels: the family first, then a one-versus-one vote of linear support vector machines
among the languages of that family.

Features are hashed byte n-grams (n = 1 to 3) of the lower-cased letters of the whole text, as shares of the text's
n-grams.  All machines are linear in them, so a text's scores are means of rows of one weight table, looked up by hash
and summed block by block; no vector of the text is ever built, however long it is.

Fitting takes at most ``per_language`` labelled rows of each language (the documented bound), chosen by a hash of the id
and drawn in proportion to what is there.  Each machine is fitted by dual coordinate descent on the hinge loss.

Cases: text that is null or has no letter is ``und`` with score 0; rows without a language teach nothing; with one
language learned every other text gets it; with none every text is ``und``; ties go to the first name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Family of each ISO 639-1 code; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "da de en is nl no nb nn sv af",
    "romance": "ca es fr gl it pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "turkic": "az kk tr uz",
    "semitic": "ar he mt",
    "indic": "bn gu hi mr ne pa ur",
    "sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BITS = 13
_LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())


def hashes_of(text: str, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """Feature numbers of the text's byte n-grams, block by block."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_KEEP) + b" ", np.uint8)
    mask = (1 << BITS) - 1
    for at in range(0, len(data), block):
        own = data[at : at + block + 2].astype(np.uint32)
        one = own[:block]
        yield one
        two = own[:-1][:block] << 8 | own[1:][:block]
        yield 256 + ((two * np.uint32(2654435761)) >> 17 & mask)
        if len(own) > 2:
            three = (own[:-2] << 16 | own[1:-1] << 8 | own[2:])[:block]
            yield 256 + (1 << BITS) + ((three * np.uint32(2246822519)) >> 16 & mask)


WIDTH = 256 + (2 << BITS)


def features_of(text: str) -> np.ndarray:
    """Shares of the text's n-grams."""
    counts = np.zeros(WIDTH)
    for h in hashes_of(text):
        counts += np.bincount(h, minlength=WIDTH)
    return counts / max(1, counts.sum())


def _packed(x: np.ndarray) -> bytes:
    """The features that aren't zero: their numbers, then their values."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n, x = len(data) // 6, np.zeros(WIDTH, np.float32)
    x[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    return x


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Weights of a linear machine by dual coordinate descent on the squared hinge loss; y is +1 or -1."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(x.shape[1], x.dtype), np.zeros(len(y))
    norm = np.einsum("ij,ij->i", x, x) + 1 / (2 * cost)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * float(x[i] @ w) - 1 + alpha[i] / (2 * cost)
            new = max(0.0, alpha[i] - g / norm[i])
            if step := new - alpha[i]:
                w += x.dtype.type(step * y[i]) * x[i]
                alpha[i], most = new, max(most, abs(step))
        if most < 1e-3:
            break
    return w


class Model:
    """``table``: a column of weights for each machine; ``pairs``: (level, first, second) of each."""

    def __init__(self, texts_x: np.ndarray, langs: list[str], cost: float = 10.0):
        self.langs = sorted(set(langs))
        self.family = {g: FAMILY_OF.get(g, g) for g in self.langs}
        self.families = sorted(set(self.family.values()))
        own, fam = np.array(langs), np.array([self.family[g] for g in langs])
        scale = 1 / np.maximum(np.sqrt((texts_x**2).mean(axis=0)), 1e-4) if len(texts_x) else np.ones(WIDTH)
        x = texts_x * scale
        unit = 1 / max(float(np.sqrt((x**2).sum(axis=1).mean())), 1e-9) if len(x) else 1.0
        x = np.hstack([x * unit, np.ones((len(x), 1))]).astype(np.float32)
        self.pairs, columns, self.bias = [], [], []
        jobs = [("family", a, b, fam) for a, b in combinations(self.families, 2)]
        for f in self.families:
            jobs += [(f, a, b, own) for a, b in combinations([g for g in self.langs if self.family[g] == f], 2)]
        for level, a, b, labels in jobs:
            rows = np.flatnonzero((labels == a) | (labels == b))
            w = fit_svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0), cost)
            self.pairs.append((level, a, b))
            columns.append(w[:-1] * scale * unit)
            self.bias.append(float(w[-1]))
        self.table = np.ascontiguousarray(np.array(columns, np.float32).reshape(-1, WIDTH).T)

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.pairs)), 0
        if self.pairs:
            for h in hashes_of(text):
                counts = np.bincount(h, minlength=WIDTH) if len(h) > 3000 else None
                total += counts @ self.table if counts is not None else self.table[h].sum(axis=0, dtype=np.float64)
                n += len(h)
        return total / max(1, n) + np.array(self.bias)

    def vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """Most pairwise wins, then the larger sum of margins, then the first name; and a confidence."""
        wins, sums, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), {}
        for (at, a, b), m in zip(self.pairs, margins):
            if at == level:
                wins[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
                sure[a, b] = m
        best = min(names, key=lambda g: (-wins[g], -sums[g], g))
        own = [m if a == best else -m for (a, b), m in sure.items() if best in (a, b)]
        return best, float(np.prod([1 / (1 + np.exp(-2 * np.clip(m, -30, 30))) for m in own]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        margins = self.margins(text)
        family, p = self.vote("family", self.families, margins)
        lang, q = self.vote(family, [g for g in self.langs if self.family[g] == family], margins)
        return lang, min(1.0, p * q)


def fit(docs: DataFrame, usable: Column, per_language: int = 400) -> Model:
    """Learns from (doc_id, text, lang) rows where ``usable`` holds, at most ``per_language`` rows of each language."""
    known = docs.where(usable & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, min(1.0, 1.5 * per_language / n)).otherwise(chance)
    drawn = F.pmod(F.xxhash64(F.lit(7), "doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(1_000_000)) / 1_000_000
    some = known.where("text IS NOT NULL").where(drawn < chance).select("lang", "text", drawn.alias("at"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(g, a, x) for g, t, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()) if _LETTER.search(t) and (x := _packed(features_of(t)))]
            for i in range(0, len(kept), 100):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept[i : i + 100]), (pa.string(), pa.float64(), pa.binary()))], ["lang", "at", "x"])

    rows = some.mapInArrow(measure, "lang string, at double, x binary").orderBy("at").limit(2 * per_language * max(1, len(counts))).collect()
    taken: dict[str, list[bytes]] = {}
    for r in rows:
        if len(own := taken.setdefault(r["lang"], [])) < per_language:
            own.append(bytes(r["x"]))
    x = np.array([_unpacked(b) for g in sorted(taken) for b in taken[g]], np.float32).reshape(-1, WIDTH)
    return Model(x, [g for g in sorted(taken) for _ in taken[g]])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            if batch.num_rows:
                lang, score = zip(*(model.predict(t.as_py()) for t in batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
