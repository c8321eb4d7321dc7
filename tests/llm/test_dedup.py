"""SimHash against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenfold.llm import simhash

from .conftest import same


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(points, near):
    label = np.arange(len(points))
    while True:
        new = np.where(near, label[None, :], len(points)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_fingerprints(docs):
    for r in docs.limit(40).collect() + [type("R", (), {"text": t}) for t in (None, "", "One", "one TWO", "a\x0bb\x1cc", "é " * 700)]:
        assert simhash.fingerprint(r.text) % 2**64 == slow_fingerprint(r.text)


@pytest.mark.parametrize(("segments", "radius", "hot", "giant"), [(2, 3, 256, 256), (2, 3, 3, 256), (2, 3, 3, 3), (3, 5, 3, 256), (3, 5, 3, 3)])
def test_links_and_components(spark, segments, radius, hot, giant):
    rng = np.random.default_rng(segments)
    points = []
    for base in rng.integers(0, 2**64, 12, dtype=np.uint64):
        for _ in range(25):
            v = base
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                v ^= np.uint64(1) << np.uint64(k)
            points.append(v)
    points = np.unique(np.array(points + [np.uint64(0), np.uint64(7), np.uint64(2**64 - 1)], np.uint64))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    label = closed(points, near)
    signed = points.view(np.int64)
    nodes = spark.createDataFrame([(int(v),) for v in signed], "fp long").withColumn("node", F.col("fp")).withColumn("t", F.lit(0))
    edges = simhash.links(nodes, segments, radius, hot, giant)
    if hot > 100:
        want = {tuple(sorted((int(signed[i]), int(signed[j])))) for i, j in zip(*np.nonzero(near)) if i < j}
        assert {(r.u, r.v) for r in edges.collect()} == want
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    for own in np.unique(label):
        members = [int(v) for v in signed[label == own]]
        assert {got.get(m, m) for m in members} == {min(members)}


def test_too_wide_a_radius(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "node long, t int, fp long"), 2, 4)


def test_near_duplicates(docs):
    rows = docs.collect()
    points = np.array([slow_fingerprint(r.text) for r in rows], np.uint64)
    label = closed(points, np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    least = {k: min(r.doc_id for r, own in zip(rows, label) if own == k) for k in set(label)}
    want = sorted(((r.doc_id, least[own]) for r, own in zip(rows, label)), key=repr)
    assert same(simhash.near_duplicates(docs), "doc_id", "component_id") == want


def test_odd(odd_docs, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    got = same(simhash.near_duplicates(odd_docs), "doc_id", "component_id")
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (None, None), (None, 3), (5, 5), (6, 6), (7, 7)], key=repr)


def test_keep_one(spark, odd_docs, no_docs):
    assert simhash.keep_one(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 5, 6, 7]
    assert kept.where("doc_id IS NULL").count() == 2


@pytest.mark.parametrize("hot", [64, 2])
def test_keep_one_finds_copies(spark, hot):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, group = [], {}
    for base in range(25):
        words = [word() for _ in range(300)]
        for copy in range(6):
            own = list(words)
            for _ in range(copy):  # each changed word takes five of 296 shingles
                own[rng.integers(300)] = word()
            group[len(rows)] = base
            rows.append((len(rows), " ".join(own)))
    kept = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()]
    assert len({group[k] for k in kept}) == 25
    assert len(kept) <= 27


def jaccard(a, b, width=5):
    a, b = ({tuple(t.split()[k : k + width]) for k in range(max(1, len(t.split()) - width + 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_cut_and_appended_copies_are_proposed(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for base in range(60):
        words = [word() for _ in range(int(rng.integers(100, 600)))]
        keep = int(len(words) * rng.uniform(0.83, 0.95))  # similarity 0.83 to 0.95, or a little less
        rows += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(words[:keep] if base % 2 else words + [word() for _ in range(len(words) - keep)]))]
    want = [k for k in range(60) if jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.84]
    assert len(want) > 30
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [k for k in want if 2 * k + 1 in kept]
    assert len(missed) <= len(want) // 10


@pytest.mark.parametrize("hot", [16, 2])
def test_similarity_is_exact(spark, hot):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for base in range(40):
        words = [word() for _ in range(int(rng.choice([8, 9, 10, 14, 24, 44, 104])))]
        for copy in range(5):
            own = words + [word() for _ in range(int(rng.integers(0, len(words) // 3)))] if copy % 2 else words[: len(words) - int(rng.integers(0, len(words) // 4 + 1))]
            rows.append((len(rows), " ".join(own)))
    near = np.array([[i == j or (i // 5 == j // 5 and jaccard(rows[i][1], rows[j][1]) >= 0.8) for j in range(len(rows))] for i in range(len(rows))])
    label = closed(np.arange(len(rows)), near)
    got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)
    assert same(got, "doc_id", "component_id") == sorted(((k, int(own)) for k, own in enumerate(label)), key=repr)


def test_probes_are_never_broadcast(spark):
    nodes = spark.range(50).selectExpr("id * 7919 AS node", "0 AS t", "id * 7919 AS fp")
    assert "BroadcastHashJoin" not in simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()


def test_tables_of_nodes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 3, raising=False)
    plans, save = [], simhash.save
    monkeypatch.setattr(simhash, "save", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(df, name))
    marked = spark.range(40).selectExpr("id AS doc_id", "id AS node")
    out = simhash.name_groups(marked, lambda _: spark.range(39).selectExpr("id AS u", "id + 1 AS v"))
    assert {r.component_id for r in out.collect()} == {0}
    assert "BroadcastHashJoin" not in "".join([*plans, out._jdf.queryExecution().executedPlan().toString()])
