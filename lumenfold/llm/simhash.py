"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint is the bitwise majority of its shingles' XXH64.  It is cut into m segments; of two that differ
in 2m - 1 bits at most, one segment differs in one bit at most.  So the index holds each segment's value, and a
fingerprint probes the ball of radius one around each of its segments: its own value, and its value with one set bit
cleared (of two values one bit apart, one has that bit set, so one direction is enough).  A join fetches the matches,
and the complete distance decides.

Only distinct fingerprints take part, so exact copies cost one aggregation.  A segment value that more than ``hot``
fingerprints share isn't joined with itself.  Its members meet as a group, which is labelled in place, by blocks of
distances, and gives one edge for each member instead of one for each pair.  A group of more than ``giant`` members is
cut once more by parts of their other bits, again with balls of radius one; with two segments such a group shares 48
bits but for two, so its size has a bound that doesn't depend on the input.

Components come from alternating large-star and small-star steps, each of them a join and an aggregation, cut by
written tables.

Cases: null and empty texts have no words and fingerprint zero, and link like any other; repeated rows and ties share a
component; a null id never names a component (it is null if no member has an id); an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

LOWER = bytes(range(256)).lower()
#: Rows that the driver may gather for a broadcast.
MOST = 100_000


def not_gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join; of more than ``MOST`` rows it isn't broadcast.  Spark would decide by a written table's compressed
    bytes, not by what an expansion or the rows' hash table takes in the driver."""
    return df.hint("merge") if rows > MOST else df


def counted(hashes: np.ndarray, copies: int) -> tuple[np.ndarray, int]:
    """How many of the hashes set each bit, and their number.  With several copies, each hash is mixed into as many."""
    if copies > 1:
        x = hashes[:, None] + np.arange(1, copies + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        hashes = (x ^ (x >> np.uint64(31))).ravel()
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8), bitorder="little").reshape(-1, 64 * copies)
    n = len(bits) // 255 * 255  # so many sum up in one byte
    ones = bits[n:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    return ones + bits[:n].reshape(-1, 255, 64 * copies).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64), len(bits)


def majority(words: list[bytes], width: int, copies: int = 1, once: bool = False, seed: int = 42, block: int = 8192) -> np.ndarray:
    """``copies`` 64-bit SimHashes of all word shingles; ``once`` counts a shingle that repeats once."""
    ones, n, digest, seen = np.zeros(64 * copies, np.int64), 0, xxhash.xxh64_intdigest, set()
    for at in range(0, max(1, len(words) - width + 1) if words else 0, block):
        own = words[at : at + block + width - 1]
        grams = own[:block] if width == 1 else [b" ".join(own)] if len(words) < width else list(map(b" ".join, zip(*(own[k:] for k in range(width)))))
        if once:
            grams = set(grams) - seen
            seen |= grams
        more, m = counted(np.fromiter((digest(g, seed) for g in grams), np.uint64, len(grams)), copies)
        ones, n = ones + more, n + m
    return np.packbits(2 * ones > n, bitorder="little").view("<i8")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of the whole text's word shingles."""
    return int(majority(words_of(text), width, seed=seed)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), width) for t in batch.column(1)], pa.int64())], ["doc_id", "fp"])

    return _id_text(docs).mapInArrow(run, "doc_id long, fp long")


def _id_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _cleared(value: str, bits: int) -> str:
    """SQL: the values of ``value`` with one of its set bits cleared."""
    return f"transform(filter(sequence(0, {bits - 1}), b -> getbit({value}, b) = 1), b -> {value} ^ shiftleft(1L, b))"


def _segments(nodes: DataFrame, segments: int) -> tuple[DataFrame, DataFrame]:
    """Index rows (seg, key, node, fp), and probe rows of the same columns; seg counts on from table to table."""
    bits = _bounds(64, segments)
    cut = nodes.select("node", "fp", "t", *(F.expr(f"shiftrightunsigned(fp, {a}) & {(1 << n) - 1}L").alias(f"s{k}") for k, (a, n) in enumerate(bits)))
    index = cut.selectExpr(f"stack({segments}, {', '.join(f't * {segments} + {k}, s{k}' for k in range(segments))}) AS (seg, key)", "node", "fp")
    cleared = [f"transform({_cleared(f's{k}', n)}, x -> named_struct('seg', t * {segments} + {k}, 'key', x))" for k, (_, n) in enumerate(bits)]
    probes = cut.selectExpr(f"inline(concat({', '.join(cleared)}))", "node", "fp")
    return index, probes


def _bounds(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of so many nearly equal parts."""
    edges = [bits * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(nodes: DataFrame, segments: int = 2, radius: int = 3, hot: int = 256, giant: int = 16_384, proof: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """Edges (u, v) between distinct nodes whose fingerprints in one table differ in ``radius`` bits or less and, with
    ``proof`` (columns node, proof: longs of a longer fingerprint), whose proofs differ in ``limit`` bits or less.

    ``nodes`` has a row (node, t, fp) for each node and table t.  Every such link of an ordinary segment value is an
    edge; for one that more than ``hot`` nodes share, edges connect what its links connect."""
    if not 0 <= radius <= 2 * segments - 1:
        raise ValueError(f"{segments} segments and balls of radius one find up to {2 * segments - 1} differing bits")
    index, probes = _segments(nodes, segments)
    crowded = save(index.groupBy("seg", "key").count().where(F.col("count") > hot), "crowded")
    dense = None
    if not crowded.isEmpty():
        members = index.withColumn("exact", F.lit(True)).unionByName(probes.withColumn("exact", F.lit(False))).join(crowded.select("seg", "key"), ["seg", "key"])
        dense = _dense(members, segments, radius, giant, proof, limit)
        index = index.join(crowded, ["seg", "key"], "left_anti")  # a probe without index rows meets nothing
    a, b = index.select("seg", "key", F.col("node").alias("u"), F.col("fp").alias("fu")), lambda x: x.select("seg", "key", F.col("node").alias("v"), F.col("fp").alias("fv"))
    near = F.expr(f"u <> v AND bit_count(fu ^ fv) <= {radius}")
    # each node has some 30 probes, and Spark estimates them as the nodes' compressed bytes: never broadcast them
    same = a.join(b(index).hint("merge"), ["seg", "key"]).where(F.expr("u < v") & near)
    apart = a.join(b(probes).hint("merge"), ["seg", "key"]).where(near)
    edges = same.select("u", "v").unionByName(apart.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()
    if proof is not None:
        edges = save(edges, "candidates")
        for end in ("u", "v"):
            edges = edges.join(proof.select(F.col("node").alias(end), F.col("proof").alias(f"p{end}")), end)
        edges = edges.where(_differing("pu", "pv") <= limit).select("u", "v")
    return edges if dense is None else edges.unionByName(dense).distinct()


def _differing(a: str, b: str) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _dense(members: DataFrame, segments: int, radius: int, giant: int, proof: DataFrame | None, limit: int) -> DataFrame:
    """Edges among the members (seg, key, node, fp, exact) of hot segment values.  Each value is one group; a giant one is
    cut once more, by parts of the bits outside the segment, with balls of radius one around those too."""
    members = save(members, "members")
    huge = members.groupBy("seg", "key").count().where(F.col("count") > giant).select("seg", "key")
    if proof is not None:
        members = members.join(proof, "node")
    else:
        members = members.withColumn("proof", F.array("fp"))
        limit = radius
    groups = members.selectExpr("seg", "key", "-1 AS part", "0L AS value", "node", "fp", "proof", "exact AS home")
    huge = save(huge, "giants")
    if not huge.isEmpty():
        groups = groups.join(huge, ["seg", "key"], "left_anti").unionByName(_cut(members.join(huge, ["seg", "key"]), segments))

    def connect(group: pa.Table) -> pa.Table:
        node, first = np.unique(group.column("node").to_numpy(), return_index=True)
        fp = group.column("fp").to_numpy()[first].view(np.uint64)
        bits = np.concatenate([c.flatten().to_numpy() for c in group.column("proof").chunks]).reshape(len(group), -1)[first].view(np.uint64)
        hub = np.zeros(len(node), bool)
        np.logical_or.at(hub, np.searchsorted(node, group.column("node").to_numpy()), group.column("home").to_numpy(zero_copy_only=False))
        hub = np.flatnonzero(hub)
        label, moved, step = np.arange(len(node)), len(hub) > 0, max(1, 2_000_000 // max(1, len(hub)))
        while moved:
            was = label.copy()
            for at in range(0, len(node), step):
                close = np.bitwise_count(fp[at : at + step, None] ^ fp[None, hub]) <= radius
                i, j = np.nonzero(close)
                far = sum(np.bitwise_count(bits[at + i, k] ^ bits[hub[j], k]).astype(np.int32) for k in range(bits.shape[1]))
                close[i, j] = far <= limit
                label[at : at + step] = np.minimum(label[at : at + step], np.where(close, label[hub][None, :], len(node)).min(axis=1))
                label[hub] = np.minimum(label[hub], np.where(close, label[at : at + step, None], len(node)).min(axis=0))
            label = label[label]
            moved = (label != was).any()
        tied = np.flatnonzero(label != np.arange(len(node)))
        return pa.table([pa.array(node[label[tied]]), pa.array(node[tied])], ["u", "v"])

    return groups.groupBy("seg", "key", "part", "value").applyInArrow(connect, "u long, v long")


def _cut(members: DataFrame, segments: int) -> DataFrame:
    """The members of giant segment values as rows (seg, key, part, value, node, fp, proof, home), home: not in a ball."""
    rest = 64 - 64 // segments
    outside = " ".join(f"WHEN {k} THEN (fp & {(1 << a) - 1}L)" + (f" | shiftleft(shiftrightunsigned(fp, {a + n}), {a})" if a + n < 64 else "") for k, (a, n) in enumerate(_bounds(64, segments)))
    own = members.withColumn("other", F.expr(f"CASE seg % {segments} {outside} END"))
    bits = _bounds(rest, segments)
    cut = own.select("seg", "key", "node", "fp", "proof", *(F.expr(f"shiftrightunsigned(other, {a}) & {(1 << n) - 1}L").alias(f"s{k}") for k, (a, n) in enumerate(bits)))
    home = cut.selectExpr("seg", "key", "node", "fp", "proof", f"stack({segments}, {', '.join(f'{k}, s{k}' for k in range(segments))}) AS (part, value)", "true AS home")
    cleared = [f"transform({_cleared(f's{k}', n)}, x -> named_struct('part', {k}, 'value', x))" for k, (_, n) in enumerate(bits)]
    ball = cut.selectExpr("seg", "key", "node", "fp", "proof", f"inline(concat({', '.join(cleared)}))", "false AS home")
    return home.unionByName(ball)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v): root is the smallest node it reaches."""

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return tuple(r)

    edges = save(edges, "edges")
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = save(both.where("v > u").join(not_gathered(least, 2 * seen[0]), "u").select(F.col("m").alias("u"), "v").where("u < v").distinct(), "large")
        least = save(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(not_gathered(least, 2 * seen[0]), "v").select("u", "v", "m")
        edges = save(small.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(least.select(F.col("m").alias("u"), "v")).where("u < v").distinct(), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    found = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
    return not_gathered(found, 2 * seen[0])


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, hot: int = 256) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest doc_id that links reach from it."""
    marked = save(fingerprints(docs, width).withColumn("node", F.col("fp")), "fingerprints")
    return name_groups(marked, lambda nodes: links(nodes.select("node", F.lit(0).alias("t"), F.col("node").alias("fp")), (radius + 2) // 2, radius, hot)).select("doc_id", F.col("node").alias("fp"), "component_id")


def name_groups(marked: DataFrame, link) -> DataFrame:
    """(doc_id, node, component_id) for rows (doc_id, node), given the edges of the distinct nodes."""
    distinct = save(marked.groupBy("node").agg(F.min("doc_id").alias("least")), "distinct")
    n = distinct.count()
    found = components(link(distinct)).withColumnRenamed("node", "member")
    rooted = save(distinct.join(found, F.col("node") == F.col("member"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    named = save(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")  # so that a large component's join can be split
    by_node = save(rooted.join(not_gathered(named, n), "root").select("node", "component_id"), "by_node")
    return marked.select("doc_id", "node").join(not_gathered(by_node, n), "node").select("doc_id", "node", "component_id")


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of the distinct word shingles, sorted; a text of fewer words is one shingle, an empty one has none."""
    grams = [b" ".join(words)] if 0 < len(words) < width else list(map(b" ".join, zip(*(words[k:] for k in range(width)))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams)))


def minima(grams: np.ndarray, size: int, block: int = 512) -> np.ndarray:
    """MinHash: for each of ``size`` hash functions the upper half of its least value over the set."""
    flip, odd = np.random.default_rng(7).integers(0, 2**64, (2, size), dtype=np.uint64)
    odd |= np.uint64(1)
    least = np.full(size, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), block):
        np.minimum(least, ((grams[at : at + block, None] ^ flip) * odd).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)], dtype=np.int32), pa.array(np.concatenate(rows), kind))


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = 25, rows: int = 5, hot: int = 16, block: int = 1024) -> DataFrame:
    """(doc_id, node, component_id) by the similarity (Jaccard) of the sets of ``width``-word shingles.

    SimHashes of the sets that differ in three bits or less propose pairs first; that alone reaches only the nearest copies.
    Two sets of similarity s agree in a MinHash value with probability s, so of ``bands`` bands of ``rows`` values they
    share one with probability 1 - (1 - s ** rows) ** bands: 0.99995 at 0.8, whatever the sets' sizes.  Sharing a band
    makes a pair a candidate; the exact similarity of its two sets (of 64-bit hashes of shingles) decides.  Equal sets are one node.

    Rounds keep large groups of copies from emitting all their pairs.  After the pairs of SimHashes, each node of a band
    value of more than ``hot`` nodes meets one leader, of all bands the one that its MinHash values resemble most.  Then, in
    band values that still hold several components, each node of ``hot`` or less meets the smallest.  At last nodes of
    different components meet: all of ``hot`` or less, and of larger values those outside the main component with all that
    could reach ``similarity`` (values that agree at least at 4.5 standard deviations below it), until one of each component
    does.  Larger values are dealt into blocks of ``block`` nodes, so no task holds more, however large a group of copies is.
    """
    size = bands * rows
    floor = similarity - 4.5 * (similarity * (1 - similarity) / size) ** 0.5

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray]]:
        """Ids, sets and nodes of a few rows at once."""
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingles(words_of(t.as_py()), width) for t in part.column(1)]
                yield part.column(0), sets, np.array([xxhash.xxh64_intdigest(g.tobytes(), 42) for g in sets], np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, node in parts(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(node), pa.array([len(g) for g in sets], pa.int32()), pa.array([of_set(g) for g in sets], pa.int64()), _lists([minima(g, size) for g in sets], pa.int32())], ["doc_id", "node", "n", "fp", "sketch"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, node in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(node), _lists([g.view(np.int64) for g in sets], pa.int64())], ["node", "own"])

    marked = save(_id_text(docs).mapInArrow(run, "doc_id long, node long, n int, fp long, sketch array<int>"), "fingerprints")
    nodes = save(marked.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")), "nodes")
    keyed = nodes.selectExpr("node", "n", f"inline(transform(sequence(0, {bands - 1}), b -> struct(b AS band, xxhash64(b, slice(sketch, b * {rows} + 1, {rows})) AS key)))")
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = save(keyed.join(shared, "key"), "members")
    found_by_simhash = save(_simhash_pairs(nodes, hot), "simhash")
    paired = members.select("node").unionByName(found_by_simhash.select(F.col("u").alias("node"))).unionByName(found_by_simhash.select(F.col("v").alias("node"))).distinct()
    ids = save(nodes.join(paired, "node", "left_semi").select(F.col("id").alias("doc_id")).distinct(), "ids")
    texts = _id_text(docs)
    texts = texts.join(not_gathered(ids, ids.count()), "doc_id", "left_semi").unionByName(texts.where("doc_id IS NULL"))
    sets = save(texts.mapInArrow(whole, "node long, own array<long>").groupBy("node").agg(F.first("own").alias("own")), "sets")

    def settle(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough."""
        pairs = save(pairs.distinct(), "pairs")
        pairs = not_gathered(pairs, pairs.count())
        for end in ("u", "v"):
            pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("own").alias(f"s{end}")), end)
        return pairs.where(F.expr(f"size(array_intersect(su, sv)) / (size(su) + size(sv) - size(array_intersect(su, sv))) >= {similarity}")).select("u", "v")

    def lead(crowd: DataFrame) -> DataFrame:
        """Pairs (u, v) of a leader and a node.  Band values are led in blocks; the leaders of several blocks meet again, as long
        as that makes them fewer."""
        out, held = None, crowd.select("key", "node", "n", "sketch", "c")
        while True:
            rows = held.withColumn("block", _block_of("node", F.ceil(F.col("c") / block), 1))
            met = save(rows.groupBy("key", "block").applyInArrow(_led(similarity), "key long, u long, v long, near double"), "led")
            own = met.where("u <> v").select("u", "v", "near")
            out = own if out is None else out.unionByName(own)
            leaders = met.where("u = v").select("key", F.col("u").alias("node"))
            many = save(held.where(F.col("c") > block).select("key", "c").distinct().join(leaders.groupBy("key").count(), "key").where("count > 1"), "many")
            if many.isEmpty() or many.agg(F.sum("count") * 2 > F.sum("c")).first()[0]:
                return out.groupBy("v").agg(F.max_by("u", F.struct("near", -F.col("u"))).alias("u")).select("u", "v")  # of a node's leaders the nearest
            held = save(leaders.join(many.select("key", F.col("count").alias("c")), "key").join(nodes.select("node", "n", "sketch"), "node").select("key", "node", "n", "sketch", "c"), "leaders")

    def link(_: DataFrame) -> DataFrame:
        few = members.where(F.col("c") <= hot)
        crowd = save(members.where(F.col("c") > hot).join(nodes.select("node", "sketch"), "node"), "crowd")
        edges = save(settle(found_by_simhash), "links")
        for step in range(3):
            root = components(edges).withColumnRenamed("node", "m")

            def apart(df: DataFrame, root=root) -> DataFrame:
                """The rows, labelled by their components, of the band values that hold more than one component; with the label
                that most nodes of the value have, and how many nodes and shingles the value and that label have."""
                df = save(df.join(root, F.col("node") == F.col("m"), "left").withColumn("label", F.coalesce("root", "node")).drop("m", "root", "c"), "labelled")
                by = F.struct("m", "label")
                sizes = df.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("w")).groupBy("key").agg(F.max_by("label", by).alias("main"), F.sum("m").alias("c"), F.max("m").alias("c_main"), F.sum("w").alias("w"), F.max_by("w", by).alias("w_main")).where("c > c_main")
                sizes = save(sizes, "sizes")
                return save(df.join(not_gathered(sizes, sizes.count()), "key"), "apart")  # written, so that a hot value's join can be split

            if step == 0:
                left = apart(crowd)
                if not left.isEmpty():
                    edges = save(edges.unionByName(settle(lead(left))), "links")
                continue
            rest = apart(few)
            ends = [rest.selectExpr("key", f"node AS {end}", f"n AS n{end}", f"label AS l{end}") for end in ("u", "v")]
            if step == 1:  # each node with the smallest one
                ends[0] = rest.groupBy("key").agg(F.min_by(F.struct("node", "n", "label"), "node").alias("one")).selectExpr("key", "one.node AS u", "one.n AS nu", "one.label AS lu")
            more = settle(ends[0].join(not_gathered(ends[1], rest.count()), "key").where(F.expr(f"u < v AND lu <> lv AND least(nu, nv) / greatest(nu, nv) >= {similarity}")).select("u", "v"))
            if step == 2:
                more = more.unionByName(_met(apart(crowd).join(sets, "node"), similarity, floor, bands, block))
            edges = save(edges.unionByName(more), "links")
        return edges

    return name_groups(marked, link)


def of_set(grams: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes."""
    ones = sum((counted(grams[at : at + 8192], 1)[0] for at in range(0, len(grams), 8192)), np.zeros(64, np.int64))
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<i8")[0])


def _simhash_pairs(nodes: DataFrame, hot: int) -> DataFrame:
    """Pairs (u, v) of nodes (node, fp) whose SimHashes differ in three bits or less, by multi-index hashing: nodes of one
    fingerprint pair with the smallest of them, and these by the links of the fingerprints."""
    first = save(nodes.groupBy("fp").agg(F.min("node").alias("u"), F.count("*").alias("c")), "fps")
    n = first.count()
    same = nodes.join(not_gathered(first.where("c > 1"), n), "fp").where("node <> u").select("u", F.col("node").alias("v"))
    near = links(first.select(F.col("fp").alias("node"), F.lit(0).alias("t"), "fp"), 2, 3, hot)
    for end in ("u", "v"):
        near = near.join(not_gathered(first.select(F.col("fp").alias(f"f{end}"), F.col("u").alias(f"n{end}")), n), F.col(end) == F.col(f"f{end}"))
    return same.unionByName(near.select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")))


def _block_of(node: str, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), node), blocks.cast("long")).cast("int")


def _sketches(group: pa.Table, mark: str = "") -> tuple[np.ndarray, ...]:
    """(node, n, sketch) in order of the nodes, and that order."""
    node = group.column(f"node{mark}").to_numpy()
    order = np.argsort(node, kind="stable")
    sketch = np.concatenate([c.flatten().to_numpy() for c in group.column(f"sketch{mark}").chunks]).reshape(len(node), -1)
    return node[order], group.column(f"n{mark}").to_numpy()[order], sketch[order], order


def _shares(sketch: np.ndarray, n: np.ndarray, one: np.ndarray, size: int, similarity: float) -> np.ndarray:
    """Shares of agreeing MinHash values with one set; -1 where the sizes alone rule the similarity out."""
    near = (sketch == one).mean(axis=1)
    near[np.minimum(n, size) < similarity * np.maximum(n, size) - 1e-9] = -1
    return near


def _led(similarity: float):
    """Rows (key, u, v, near) of a block of one band value: each node with the first leader that it resembles; leaders with
    themselves."""

    def lead(group: pa.Table) -> pa.Table:
        node, n, sketch, _ = _sketches(group)
        us, vs, ws, left = [], [], [], np.arange(len(node))
        while len(left):
            first = left[0]
            shares = _shares(sketch[left], n[left], sketch[first], n[first], similarity)
            near = shares >= similarity
            near[0], shares[0] = True, 1.0
            us.append(np.full(int(near.sum()), node[first]))
            vs.append(node[left[near]])
            ws.append(shares[near])
            left = left[~near]
        u, v, w = (np.concatenate(x) for x in (us, vs, ws))
        return pa.table([pa.array(np.full(len(u), group.column("key")[0].as_py(), np.int64)), pa.array(u), pa.array(v), pa.array(w)], ["key", "u", "v", "near"])

    return lead


def _met(rows: DataFrame, similarity: float, floor: float, bands: int, block: int, shingles_at_once: int = 2_000_000) -> DataFrame:
    """Links (u, v) within band values: each node outside the label that most have, and of each other label one node that is
    similar enough, if there is any.  Nodes of which ``floor`` of the MinHash values agree are compared by their sets, the likest
    first, in the first band that they share.  Both sides are dealt into blocks, so no group meets as a whole."""
    blocks = lambda nodes, weight: F.greatest(F.ceil(nodes / block), F.ceil(weight / shingles_at_once)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    outside, total = blocks(F.col("c") - F.col("c_main"), F.col("w") - F.col("w_main")), blocks(F.col("c"), F.col("w"))
    a = rows.where("label <> main").select("key", _block_of("node", outside, 2).alias("ab"), spread(total).alias("bb"), "band", "node", "n", "label", "sketch", "own")
    b = rows.select(F.col("key").alias("to"), spread(outside).alias("ab2"), _block_of("node", total, 3).alias("bb2"), F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("label").alias("label2"), F.col("sketch").alias("sketch2"), F.col("own").alias("own2"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        us, vs = [], []
        if left.num_rows and right.num_rows:
            mine, size, one, at = _sketches(left)
            node, n, sketch, order = _sketches(right, "2")
            labels, label = left.column("label").to_numpy()[at], right.column("label2").to_numpy()[order]
            my_sets, sets = _rows_of(left.column("own")), _rows_of(right.column("own2"))
            band = left.column("band")[0].as_py()
            for k in range(len(mine)):
                other = np.flatnonzero(label != labels[k])
                near = _shares(sketch[other], n[other], one[k], size[k], similarity)
                close = np.flatnonzero(near >= floor)
                shared = (sketch[other[close]].reshape(len(close), bands, sketch.shape[1] // bands) == one[k].reshape(bands, -1)).all(axis=2)
                close = close[shared.argmax(axis=1) == band]
                own, done = my_sets(at[k]), set()
                for j in other[close[np.argsort(-near[close], kind="stable")]].tolist():
                    if label[j] not in done:
                        both = len(np.intersect1d(own, sets(order[j]), assume_unique=True))
                        if both >= similarity * (len(own) + n[j] - both):
                            done.add(label[j])
                            us.append(min(mine[k], node[j]))
                            vs.append(max(mine[k], node[j]))
        return pa.table([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return a.groupBy("key", "ab", "bb").cogroup(b.groupBy("to", "ab2", "bb2")).applyInArrow(meet, "u long, v long").distinct()


def _rows_of(column: pa.ChunkedArray):
    """The lists of a column as arrays, by number."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    ends, values = whole.offsets.to_numpy(), whole.values.to_numpy()
    return lambda k: values[ends[k] : ends[k + 1]]


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The document with the smallest id of each group of ``similar``, with all columns.  Rows that repeat an id leave
    one; rows without an id can't be told apart and all stay."""
    found = save(similar(docs, **how), "duplicates")
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    out = docs.join(not_gathered(kept, found.count()), "doc_id", "left_semi").select(docs.columns)
    if not found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)
