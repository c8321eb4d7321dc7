"""Decontamination, secrets and licenses against brute force."""

import base64
import bz2
import gzip
import hashlib
import itertools
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import decontaminate, licenses, secrets

from .conftest import SF, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow_report(docs, items, window=8, least=2):
    texts = [(str(i), WORD.findall(low(t))) for i, t in items if i is not None]
    out = []
    for doc_id, text in docs:
        words, hit, found = WORD.findall(low(text)), set(), set()
        for name, own in texts:
            n = min(window, len(own))
            wins = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in wins:
                    found.add(name)
                    hit |= set(range(k, k + n))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= least))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("how", [{}, {"block_bytes": 700}, {"shard_words": 200}])
def test_decontamination(spark, docs, how):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = slow_report([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert same(decontaminate.report(docs, bench, **how), *COLUMNS) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("abé ,", max_size=60), max_size=6), st.lists(st.text("abé ,", max_size=40), max_size=6), st.integers(1, 4))
def test_decontamination_small(texts, items, window):
    named = [(str(k), t) for k, t in enumerate(items)]
    bench = decontaminate.Benchmark(named, window)
    shard = decontaminate.Shard([decontaminate.words_of(t) for t in texts], bench)
    got = [(k, n, decontaminate.covered(s), len(found)) for k, (n, s, found, _) in enumerate(decontaminate._judge(shard))]
    assert got == [r[:4] for r in sorted(slow_report(list(enumerate(texts)), named, window))]
    for k, (_, _, _, matches) in enumerate(decontaminate._judge(shard)):
        words = WORD.findall(texts[k])
        for name, at, here, n in matches:
            own = WORD.findall(dict(named)[name])
            assert own[at : at + n] == words[here : here + n]
            assert not (at and here and own[at - 1] == words[here - 1]) and not (at + n < len(own) and here + n < len(words) and own[at + n] == words[here + n])


def test_decontamination_odd(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "sat on"), (2, "sat on"), (2, "sat on"), (3, None), (None, "cat"), (4, ""), (5, "!!")], "item_id long, text string")
    want = slow_report([(r.doc_id, r.text) for r in odd_docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert same(decontaminate.report(odd_docs, bench), *COLUMNS) == want
    assert decontaminate.report(no_docs, bench).count() == 0
    assert same(decontaminate.report(odd_docs, bench.limit(0)), "n_items") == [(0,)] * 10
    kept = decontaminate.remove(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == 7
    assert decontaminate.remove(odd_docs, bench, block_bytes=5).count() == 7


def slow_base(text):
    out = []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda f: (f[1], secrets.KINDS.index(f[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "ToKen", "passw", "password", "api_key", "=", ":", " ", '"', "'", "abc123", "AKIA", "Z9Z9Z9Z9Z9Z9Z9Z9", "0123456789abcdef", "secret", "ſecret", "toKen", "\n", "x", ".", "-"]), max_size=14).map("".join))
def test_base_spans(text):
    found, complete = secrets.findings(text)
    assert complete
    assert sorted([f[:3] for f in found if not f[3]], key=lambda f: (f[1], secrets.KINDS.index(f[0]))) == slow_base(text)


KEY = "AKIA" + "Q7" * 9
LAYERS = {
    "url": lambda t: urllib.parse.quote(t, safe="").replace("A", "%41"),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "urlsafe": lambda t: base64.urlsafe_b64encode(("~~~" + t + "???").encode()).decode(),
    "gzip": lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
    "zlib": lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
}


@pytest.mark.parametrize("outer", LAYERS)
@pytest.mark.parametrize("inner", LAYERS)
def test_nested_layers(inner, outer):
    blob = LAYERS[outer](LAYERS[inner](KEY))
    text = f"é before {blob} after"
    found, _ = secrets.findings(text)
    hits = [f for f in found if f[0] == "access"]
    assert hits and all(9 <= a < b <= 9 + len(blob) for _, a, b, _ in hits)
    assert KEY not in secrets.redacted(text)
    assert all(KEY not in str(f) for f in secrets.findings(secrets.redacted(text))[0])


def test_layer_positions_and_cycles():
    blob = "%41" + KEY[1:]
    assert [f[:3] for f in secrets.findings(f"see {blob} end")[0]] == [("access", 4, 4 + len(blob))]
    assert secrets.findings("%2525252525")[1]
    bomb = base64.b64encode(gzip.compress(b"a" * 3_000_000)).decode()
    assert secrets.findings(bomb, budget=100_000)[1] is False


def test_secrets_frame(spark, odd_docs, no_docs, docs):
    assert secrets.digest(secrets.find(no_docs)).count() == 0
    got = secrets.digest(secrets.find(odd_docs)).collect()
    assert len(got) == 10 and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()} and {r.spans for r in got} == {""}
    for r in secrets.digest(secrets.find(docs)).join(docs.select("doc_id", "text"), "doc_id").collect():
        base = slow_base(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[0] == k for f in base) for k in secrets.KINDS)
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
    assert all(not slow_base(r.text) for r in clean.collect())
    assert secrets.redact(odd_docs).count() == 10


def slow_increasing(places):
    best = [1] * len(places)
    for i in range(len(places)):
        best[i] = 1 + max((best[j] for j in range(i) if places[j] < places[i]), default=0)
    return max(best, default=0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=25, unique=True))
def test_increasing(places):
    chosen = licenses.increasing(places)
    own = [places[k] for k in chosen]
    assert chosen == sorted(chosen) and own == sorted(own) and len(own) == slow_increasing(places)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=14), st.lists(st.sampled_from("abcde"), max_size=14))
def test_alignment_is_sound(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(licenses.common(a, b)) >= len(pairs)
    assert licenses.align(a, a) == [(i, i) for i in range(len(a))]


def slow_lengths(a, b):
    """How many pairs patience alignment can give by its definition, over all longest sequences of anchors."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y:
        return {head + tail}
    both = [(k, y.index(w)) for k, w in enumerate(x) if x.count(w) == 1 and y.count(w) == 1]
    rising = [own for n in range(len(both) + 1) for own in itertools.combinations(both, n) if all(p[1] < q[1] for p, q in zip(own, own[1:]))]
    most = max(map(len, rising))
    if not most:
        return {head + tail + len(licenses.common(x, y))}
    out = set()
    for own in rising:
        if len(own) == most:
            sums = {head + tail + most}
            for (p, q), (r, s) in zip([(-1, -1), *own], [*own, (len(x), len(y))]):
                sums = {n + m for n in sums for m in slow_lengths(x[p + 1 : r], y[q + 1 : s])}
            out |= sums
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=9), st.lists(st.sampled_from("abcdefgh"), max_size=9))
def test_alignment_equals_its_definition(a, b):
    got = licenses.align(a, b)
    assert len(got) in slow_lengths(a, b)
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        assert len(got) == len(licenses.common(a, b))


def test_scan_equals_looking_everywhere():
    """Every place where a template stands whole, or with a word in five missing at most, by trying all windows."""
    scanner, template = licenses.Scanner({"T": "one two three four five six seven eight nine ten"}), "one two three four five six seven eight nine ten".split()
    rng = random.Random(4)
    for _ in range(60):
        words, planted = [], 0
        for _ in range(rng.randrange(1, 5)):
            words += [rng.choice(["x", "y", "two", "z"]) for _ in range(rng.randrange(12, 30))]
            own = list(template)
            for _ in range(rng.randrange(0, 3)):
                own.pop(rng.randrange(len(own)))
            words += own
            planted += 1
        words += ["x"] * 12
        got = scanner.matches(" ".join(words))
        best = max(len(licenses.common(words[k : k + 20], template)) for k in range(len(words)))
        assert len(got) == planted and max(m[3] for m in got) <= best and all(m[4] >= 0.8 for m in got)


def test_many_notices_stay_apart():
    text = "Released under the MIT License. " * 500
    got = licenses.Scanner().matches(text)
    assert len(got) == 500 and all(a[2] <= b[1] for a, b in zip(got, got[1:]))


def test_licenses_are_found():
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        body = f"lorem é ipsum. {text} dolor."
        assert [m[0] for m in scanner.matches(body)] == [name]
        (_, start, end, _, coverage), = scanner.matches(body)
        assert coverage == 1 and body[start:end].startswith(text[:10])
    twice = "Released under the MIT License. and then released under\nan MIT license"
    assert [m[0] for m in scanner.matches(twice)] == ["MIT-notice"] * 2
    assert scanner.matches("the license of the poem under the bridge, released") == []
    assert scanner.matches(None) == scanner.matches("") == []


def test_licenses_frame(spark, odd_docs, no_docs, docs):
    assert licenses.scan(no_docs).count() == 0
    assert all(r.matches == [] for r in licenses.scan(odd_docs).collect())
    notices = {"Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.", "MIT-notice": "Released under the MIT License.", "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0."}
    for r in licenses.scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        for name, text in notices.items():
            if text in r.text:
                assert name in {m.license for m in r.matches}


@pytest.mark.parametrize("data", ["\ufeff", "中\u3000文", "a\xa0b", "\u200b", "\u2028", "\x0c", "\x00"], ids=ascii)
def test_blobs_of_any_text(data):
    for raw in (f"{data} {KEY} x".encode(), f"{data} {KEY} x".encode("utf-16"), f"caf\xe9 {KEY} x".encode("latin-1"), b"\xff\x00\x81" + KEY.encode()):
        for blob in (base64.b64encode(raw).decode(), base64.b64encode(gzip.compress(raw)).decode()):
            assert any(f[0] == "access" for f in secrets.findings(f"see {blob} end")[0])
            assert not any(f[0] == "access" for f in secrets.findings(secrets.redacted(f"see {blob} end"))[0])


@pytest.mark.parametrize("prefix", ["", "blob/", "v1_", "-", "a-b_c/", "xy"])
@pytest.mark.parametrize("width", [0, 64, 76])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress, lzma.compress, lambda d: gzip.compress(d[:40]) + gzip.compress(d[40:])])
def test_prefixed_and_wrapped_blobs(prefix, width, pack):
    raw = ("~~??>> text " * 4 + KEY + " " + "".join(map(chr, range(33, 127)))).encode()
    blob = base64.b64encode(pack(raw)).decode()
    blob = "\n".join(blob[k : k + width] for k in range(0, len(blob), width)) if width else blob
    text = f"see {prefix}{blob} end"
    hits = [f for f in secrets.findings(text)[0] if f[0] == "access"]
    assert hits and all(4 <= a < b <= len(text) - 4 for _, a, b, _ in hits)
    assert not any(f[0] == "access" for f in secrets.findings(secrets.redacted(text))[0])


def test_compressed_bytes_in_url_escapes():
    text = f"q={urllib.parse.quote(gzip.compress(KEY.encode()))} end"
    assert [f[0] for f in secrets.findings(text)[0]] == ["access"]


def test_large_streams_are_read_and_broken_ones_removed():
    bomb = base64.b64encode(gzip.compress(b"a " * 1_500_000 + KEY.encode() + b" b" * 1_500_000)).decode()
    found, complete = secrets.findings(bomb, budget=100_000)
    assert [f[0] for f in found] == ["access"] and not complete
    wide = base64.b64encode(gzip.compress(("é" * 90_000 + KEY).encode())).decode()
    assert [f[0] for f in secrets.findings(wide, budget=100_000)[0]] == ["access"]
    both = "x%41" * 30 + "\\u0041" * 30 + base64.b64encode(KEY.encode()).decode()
    assert "access" in {f[0] for f in secrets.findings(both, budget=60)[0]}
    cut = base64.b64encode(gzip.compress(bytes(range(256)) * 40)).decode()[:200]
    assert not secrets.findings(f"see {cut} end")[1]
    assert secrets.redacted(f"see {cut} end") == "see [REDACTED] end"


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_licenses_after_prose(name):
    prose = "The use of a tool in the world is a matter of the people that make it and of the work to be done, as in any other art. "
    text = licenses.TEMPLATES[name]
    for before in ("the a b c d e f g ", prose, prose * 4):
        body = f"{before}{text} The end of it."
        found = scanner_of().matches(body)
        assert [(m[0], m[4]) for m in found] == [(name, 1)]
        assert licenses.words_of(body[found[0][1] : found[0][2]])[0][-1] == licenses.words_of(text)[0][-1]
        assert found[0][1] <= len(before)


def scanner_of():
    return licenses.Scanner()


@pytest.mark.parametrize("text", ["https://x.org/p/{}", "user/{}", "ab{}", "{}"])
def test_base64_in_paths(text):
    whole = text.format(base64.b64encode(b"password=hunter2abc").decode())
    assert any(f[0] == "assign" for f in secrets.findings(whole)[0]), whole
    assert not any(f[0] == "assign" for f in secrets.findings(secrets.redacted(whole))[0])


def test_a_small_budget_loses_no_layer():
    text = "x" * 4000 + " %70assword=hunter2abc " + base64.b64encode(gzip.compress(b"y" * 300_000 + KEY.encode())).decode()
    for budget in (100, 1000, 64 << 20):
        kinds = {f[0] for f in secrets.findings(text, budget)[0]}
        assert {"assign", "access"} <= kinds


def test_decontamination_in_blocks(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = (sorted(r.doc_id for r in decontaminate.remove(docs, bench, block_bytes=b).collect()) for b in (8 << 20, 900))
    assert one == many and 0 < len(one) < docs.count()
    assert decontaminate.remove(docs.withColumn("row_number", docs.doc_id), bench, block_bytes=900).columns == [*docs.columns, "row_number"]
