"""The pipeline's stages, each on its own input, against brute force."""

import re

import pytest

import corpus_pipeline
from lumenfold.llm import quality, secrets
from lumenfold.llm.common import save

from .test_text_scans import WORD, low

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(save(stage(spark, out[-1], SF), name))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(stages[-1].columns)


def test_quality_follows_labels(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    known = [k for k in labels if labels[k] is not None]
    assert sum((k in kept) == bool(labels[k]) for k in known) / len(known) > 0.95
    assert quality.FEATURES and stages[1].subtract(stages[0]).isEmpty()


def grams(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low(text)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_dedup(stages):
    before, after = (sorted((r.doc_id, r.text) for r in df.collect()) for df in stages[1:3])
    kept, sets = {k for k, _ in after}, {k: grams(t) for k, t in before}
    best = {}
    for k, s in sets.items():
        for j, o in sets.items():
            if j != k and s & o:
                best.setdefault(k, []).append((len(s & o) / len(s | o), j))
    for k in sets:
        if k not in kept:  # something much like it went before or stays
            assert max(best.get(k, [(0, 0)]))[0] >= 0.7
    for k in kept:
        assert not any(v >= 0.9 and j in kept for v, j in best.get(k, []))


def test_decontamination(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = WORD.findall(low(r.text))
        windows |= {tuple(words[i : i + 8]) for i in range(len(words) - 7)}

    def leaks(text):
        words = WORD.findall(low(text))
        return any(tuple(words[i : i + 8]) in windows for i in range(len(words) - 7))

    want = {r.doc_id for r in stages[2].collect() if not leaks(r.text)}
    assert {r.doc_id for r in stages[3].collect()} == want and len(want) < stages[2].count()


def test_secrets_are_gone(spark, stages):
    leak = spark.createDataFrame([(-1, 'so token = "0123456789abcdef0123456789" it is', "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    given = stages[3].unionByName(leak)
    before = {r.doc_id: r.text for r in given.collect()}
    rows = {r.doc_id: r for r in corpus_pipeline.redaction(spark, given, SF).collect()}
    assert set(before) == set(rows)
    assert not any(secrets.scan(r.text) for r in rows.values())
    assert all(rows[k].text == t for k, t in before.items() if not secrets.findings(t)[0])
    assert rows[-1].text == "so [REDACTED]\" it is" and rows[-1].n_chars == len(rows[-1].text)
    assert {r.doc_id: r.text for r in stages[4].collect()} == {k: r.text for k, r in rows.items() if k != -1}


def test_packing_takes_everything(stages):
    pieces = stages[5].collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in stages[4].collect()}
    fill = {}
    for p in pieces:
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    assert max(fill.values()) <= 2048 and len(fill) <= sum(fill.values()) // 2048 + 2


def test_odd(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 2 * docs.count() + 40
