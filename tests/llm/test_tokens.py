"""Tokenizer cache, record files and packing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenfold.llm import packing, records
from lumenfold.llm.common import scratch
from lumenfold.llm.wordpiece import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH, bound=50)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aA eéÉç'sSt.,!?\n\t\x1c\x85\xa0ªµ²½ßİΣσς日本́​01<|startofex>…'lre#$\xad\x7f\x80", max_size=60))
def test_encoder_equals_library(text):
    assert np.frombuffer(ENCODER.bytes_of(text), "<u4").tolist() == ids_of(text)


def test_a_stop_costs_no_second_tokenization():
    class Counted:
        seen = []

        def tokenize(self, part):
            self.seen.append(part)
            return LIBRARY.model.tokenize(part)

    encoder = WordEncoder(PATH)
    encoder.model = Counted()
    text = "Wherever wherever, wherever. wherever; wherever' wherever9 it's"
    assert np.frombuffer(encoder.bytes_of(text), "<u4").tolist() == ids_of(text)
    assert Counted.seen.count("wherever") == 1


def test_encoder_special_strings():
    for text in ("<|endoftext|>", "a<|startoftext|>b", "x <|EndOfText|> y"):
        assert np.frombuffer(ENCODER.bytes_of(text), "<u4").tolist() == ids_of(text)


def expected(rows, end):
    return {i: ids_of(t) + [end] for i, t in rows}


def test_records_round_trip(spark, docs):
    path = scratch(spark, "records")
    records.write_records(docs, path, PATH, chunk_bytes=20_000)  # many files
    index = records.build_index(spark, path)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = expected(rows, 1)
    start = 0
    got = {r.doc_id: r for r in index.collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        a = np.array(want[i], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(a), zlib.crc32(a))
        start += len(a)
    assert index.select("file").distinct().count() > 4
    shuffled = records.read_shuffled(spark, path, 7).collect()
    assert {r.doc_id: r.ids for r in shuffled} == want
    assert [r.doc_id for r in shuffled] != sorted(r.doc_id for r in shuffled)
    some = records.fetch(spark, path, records.read_index(spark, path).where("doc_id % 10 = 3")).collect()
    assert {r.doc_id for r in some} == {i for i, _ in rows if i % 10 == 3}


def test_records_odd(spark, odd_docs, no_docs):
    path = scratch(spark, "records")
    records.write_records(odd_docs, path, PATH)
    got = records.build_index(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert sum(r.n_tokens for r in got) == sum(len(ids_of(r.text)) + 1 for r in odd_docs.collect())
    path = scratch(spark, "records")
    records.write_records(no_docs, path, PATH)
    assert records.build_index(spark, path).count() == 0


def test_frames_find_damage():
    good = records.frame(b"abc") + records.frame(b"") + b"\n"
    assert [p for _, p in records.frames(good)] == [b"abc", b""]
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.frames(good[:-5] + b"\n"))


def test_record_widths():
    for ids in ([], [1, 65_535], [1, 65_536]):
        assert records.parse(records.record(-5, np.array(ids, "<u4").tobytes()))[1].tolist() == ids
    assert records.parse(records.record(None, b""))[0] is None


def check_packing(rows, docs, capacity, max_docs=10**9, max_cost=10**12):
    want = defaultdict(list)
    for r in docs.collect():
        ids = ids_of(r.text) + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[at : at + capacity], "<u4")
            want[r.doc_id].append((k, at, len(own), zlib.crc32(own)))
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and len(own) <= max_docs and sum(n * n for _, n in own) <= max_cost
    return len(bins)


def test_packing(spark, docs):
    rows = packing.pack(docs, PATH).collect()
    used = check_packing(rows, docs, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_constraints(spark, docs, rule):
    rows = packing.pack(docs, PATH, capacity=512, max_docs=3, max_cost=200_000 + 512 * 512, rule=rule).collect()
    check_packing(rows, docs, 512, 3, 200_000 + 512 * 512)


def test_packing_odd(spark, odd_docs, no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
    rows = packing.pack(odd_docs, PATH).collect()
    check_packing(rows, odd_docs, 2048)


def one_by_one(lengths, capacity, max_docs, max_cost, weights, rule):
    """Vector best fit of single pieces, the slow way."""
    caps, w = np.array([capacity, max_docs, max_cost], float), np.array(weights)
    bins = np.zeros((0, 3))
    for n in sorted(lengths, reverse=True):
        item = np.array([n, 1, n * n], float)
        fit = np.flatnonzero((bins >= item).all(axis=1))
        if len(fit):
            have = bins[fit]
            score = (w * ((have - item) / caps) ** 2).sum(axis=1) if rule == "norm" else -(w * (item / caps) * (have / caps)).sum(axis=1)
            best = fit[np.lexsort((*have.T, score))[0]]
        else:
            bins, best = np.vstack([bins, caps]), len(bins)
        bins[best] -= item
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.sampled_from([(64, 64 * 64), (3, 64 * 64), (5, 70 * 70)]), st.sampled_from(["norm", "dot"]))
def test_plan_equals_single_best_fit(lengths, caps, rule):
    counts = {n: lengths.count(n) for n in lengths}
    plan, opened = packing.plan_bins(counts, 64, *caps, rule, grains=caps[1])
    assert opened == one_by_one(lengths, 64, *caps, (1.0, 0.5, 0.5), rule)
    for n, c in counts.items():
        ranks = sorted(r for _, lo, m, *_ in plan[plan[:, 0] == n] for r in range(lo, lo + m))
        assert ranks == list(range(c))


def test_the_choice_is_of_vectors(docs):
    """On the real lengths the document count and the cost change which bins are chosen, at no more sequences."""
    counts = defaultdict(int)
    for r in docs.collect():
        n = len(ids_of(r.text)) + 1
        counts[2048] += n // 2048
        counts[n % 2048] += 1
    counts.pop(0, None)
    plans = [packing.plan_bins(dict(counts), 2048, most, 2048 * 2048, "norm", w) for most, w in ((2048, (1.0, 0.0, 0.0)), (128, (1.0, 0.5, 0.5)))]
    assert plans[0][1] == plans[1][1]
    assert {tuple(r) for r in plans[0][0].tolist()} != {tuple(r) for r in plans[1][0].tolist()}
