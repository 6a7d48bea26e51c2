"""Operator 12: MinHash near-duplicates by tensored banding.

Two small collections of bands are computed for each document. A table's key is
a band of the first joined to a band of the second, so 16 + 16 bands of 4
MinHash values serve 256 tables of 8 values: 128 values are computed instead of
2,048. Documents of similarity s share a table with probability
(1 - (1 - s ** 4) ** 16) ** 2, which is 0.9996 at 0.8 and 0.004 at 0.25.

Tables propose; whole sets of shingles decide. Documents are first compared with
the smallest one of their buckets, so a group of near copies takes about one
comparison for each member, not one for each pair. Of what that leaves apart in a
bucket, documents that share too few shingles with all the others go, and pairs
across components are compared unless an estimate from 512 values rules them out.
So the links found connect what all links between documents of a shared bucket
connect.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinside.llm.bloom import mixed
from twinside.llm.common import arrow_schema, map_rows
from twinside.llm.components import merged, rooted
from twinside.llm.simhash import words_of
from twinside.session import scratch, settle

#: Documents are linked if PARTS * shared >= LEAST * united shingles.
LEAST, PARTS = 80, 100
#: Bands of each of the two collections, and MinHash values of a band.
BANDS, ROWS = 16, 4
VALUES = 2 * BANDS * ROWS
SEED = 42
#: Pairs estimated below this are not compared: at a similarity of 0.8 the estimate's standard error is 0.035, so one true pair in 10,000 is.
LIKELY = 0.665
#: The same for what the first comparisons leave apart, from so many values: the standard error is 0.018 then.
FINE_LIKELY, FINE_VALUES = 0.735, 512
#: Members of a bucket that one task compares.
CROWD = 8_192
PIECE = 1_024
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, VALUES), dtype=np.uint64) | np.uint64(1)
FINE_ODD = np.random.default_rng(SEED + 1).integers(0, 1 << 64, size=(2, FINE_VALUES), dtype=np.uint64) | np.uint64(1)


class Hashes(dict):
    """Word to 64-bit hash; a task keeps those of recent words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


def shingle_hashes(text: str | None, size: int, known: Hashes) -> np.ndarray:
    """Sorted different hashes of the shingles; a text of fewer words has its whole sequence as one, a text without words none."""
    words = words_of(text)
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(own):
        return own
    size = min(size, len(own))
    n = len(own) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mixed(h * MIX + own[k : k + n])
    return np.unique(h)


def least_values(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    least = np.full(odd.shape[1], ~np.uint64(0))
    for at in range(0, len(hashes), PIECE):
        least = np.minimum(least, (hashes[at : at + PIECE, None] * odd[0] + odd[1]).min(axis=0))
    return mixed(least)


def bands(hashes: np.ndarray) -> tuple[list[int], list[int], bytes]:
    """Bands of the first and of the second collection, and the last byte of every MinHash value."""
    least = least_values(hashes, ODD)
    value = np.arange(2 * BANDS, dtype=np.uint64)
    for k in range(ROWS):
        value = mixed(value * MIX + least[k::ROWS])
    value = value.view(np.int64).tolist()
    return value[:BANDS], value[BANDS:], (least & np.uint64(255)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, size: int, fingerprint: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(doc_id, n, c0, c1, a, b, marks) of every row (doc_id, text), and f0 by ``fingerprint``; equal sets of shingles have equal n, c0 and c1."""

    def start():
        import xxhash

        known = Hashes()

        def row(doc_id, text):
            hashes = shingle_hashes(text, size, known)
            own = () if fingerprint is None else (fingerprint(hashes),)
            return doc_id, len(hashes), *np.frombuffer(xxhash.xxh128_digest(hashes.tobytes(), SEED), "<i8").tolist(), *bands(hashes), *own

        return row

    more = "" if fingerprint is None else ", f0 bigint"
    return map_rows(docs, start, "doc_id bigint, n bigint, c0 bigint, c1 bigint, a array<bigint>, b array<bigint>, marks binary" + more)


def hash_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of every row (doc_id, text), the sorted hashes as bytes."""

    def start():
        known = Hashes()
        return lambda doc_id, text: (doc_id, shingle_hashes(text, size, known).tobytes())

    return map_rows(docs, start, "node bigint, hashes binary")


def buckets(classes: DataFrame) -> DataFrame:
    """(key, node, pivot): members of every table's buckets of two or more, ``pivot`` the smallest; of buckets with the same members one."""
    halves = classes.select("node", F.explode(F.concat("a", "b")).alias("half"))
    shared = settle(halves.groupBy("half").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("half"), "shared-bands")
    live = halves.join(shared, "half").groupBy("node").agg(F.collect_set("half").alias("live"))
    ours = classes.select("node", "a", "b").join(live, "node")
    ours = ours.select("node", F.array_intersect("a", "live").alias("a"), F.array_intersect("b", "live").alias("b")).filter("size(a) > 0 AND size(b) > 0")
    ours = settle(ours.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("a"))).alias("a"), F.array_distinct(F.flatten(F.collect_list("b"))).alias("b")), "live-bands")
    tables = ours.select("node", F.explode("a").alias("one"), "b").select("node", "one", F.explode("b").alias("two")).select("node", F.xxhash64("one", "two").alias("key"))
    sums = tables.groupBy("key").agg(
        F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("m"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y")
    )
    one = settle(sums.filter("pivot < last").groupBy("pivot", "last", "m", "x", "y").agg(F.min("key").alias("key")).select("key", "pivot"), "bucket-keys")
    return settle(tables.join(one, "key"), "buckets")


def linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Pairs (u, v) of those given whose whole sets of shingles are similar enough."""
    end = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("marks").alias(f"m{c}"))
    ddl = "u bigint, v bigint"
    schema = arrow_schema(ddl)

    def pairs_of(batch, good):
        return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], schema=schema)

    def sieve(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, VALUES) for k in (2, 3))
            yield pairs_of(batch, (x == y).mean(axis=1) >= LIKELY)

    def compare(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), "<u8") for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = PARTS * both >= LEAST * (len(x) + len(y) - both) and both > 0
            yield pairs_of(batch, good)

    fits = f"{PARTS} * least(nu, nv) >= {LEAST} * greatest(nu, nv)"
    near = pairs.join(end("u"), "u").join(end("v"), "v").filter(fits).select("u", "v", "mu", "mv").mapInArrow(sieve, ddl)
    near = settle(near.distinct(), "likely-pairs")
    named = near.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = settle(hash_sets(docs.join(named, "doc_id", "left_semi"), size).distinct(), "sets")
    whole = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}"))
    both = near.join(whole("u"), "u").join(whole("v"), "v").select("u", "v", "hu", "hv")
    return settle(both.mapInArrow(compare, ddl).distinct(), "links")


def shared_sizes(sets: DataFrame, nodes: int) -> DataFrame:
    """(node, shared): how many of a set's hashes (node, hashes) occur in another node's set too.

    Hashes travel in blocks, one for each bucket of them; a task looks at one bucket at a time.
    """
    bits = max(4, math.ceil(math.log2(1 + nodes / 4_000)))
    ddl, out = "bucket bigint, hashes binary, nodes binary", "node bigint, shared bigint"
    schema, out_schema = arrow_schema(ddl), arrow_schema(out)

    def send(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                own = [np.frombuffer(v.as_buffer(), np.uint64) for v in part.column(1)]
                h = np.concatenate(own)
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(v) for v in own])
                order = np.argsort(h)
                h, node = h[order], node[order]
                bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)]]).tolist()
                rows = [(int(bucket[x]), h[x:y].tobytes(), node[x:y].tobytes()) for x, y in zip(cuts, cuts[1:]) if y > x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def counted(held):
        pairs = np.stack([np.concatenate([np.frombuffer(v, np.int64) for v in c]) for c in zip(*held)])
        pairs = pairs[:, np.lexsort(pairs[::-1])]
        pairs = pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])]  # rows of one id may repeat
        again = pairs[0, 1:] == pairs[0, :-1]
        shared = np.concatenate([again, [False]]) | np.concatenate([[False], again])
        node, n = np.unique(pairs[1, shared], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n)], schema=out_schema)

    def count(batches):
        now, held = None, []
        for batch in batches:
            for bucket, hashes, nodes in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield from counted(held)
                    held = []
                now = bucket
                held.append((hashes, nodes))
        if held:
            yield from counted(held)

    return sets.mapInArrow(send, ddl).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, out).groupBy("node").agg(F.sum("shared").alias("shared"))


#: How often documents that share too little with all others are taken out, which leaves others with less.
PEELS = 2


def linkable(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shared, marks) of the nodes (node, n) that may be linked, with the last bytes of many MinHash values: a linked set shares at least LEAST / PARTS of its shingles with one other, so with all others."""
    sets = settle(hash_sets(docs.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), size).distinct(), "apart-sets")
    for _ in range(PEELS):
        count = nodes.count()
        found = shared_sizes(sets.join(nodes.select("node"), "node", "left_semi").select("node", "hashes"), count)
        nodes = settle(nodes.select("node", "n").join(found, "node").filter(f"{PARTS} * shared >= {LEAST} * n"), "linkable")

    def start():
        return lambda node, hashes: (node, (least_values(np.frombuffer(hashes, np.uint64), FINE_ODD) & np.uint64(255)).astype(np.uint8).tobytes())

    marks = map_rows(sets.join(nodes.select("node"), "node", "left_semi").select("node", "hashes"), start, "node bigint, marks binary")
    return settle(nodes.groupBy("node").agg(F.max("shared").alias("shared")).join(marks, "node"), "fine-marks")


def likely_pairs(nodes: np.ndarray, sizes: np.ndarray, groups: np.ndarray, shared: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket across groups whose estimated similarity may do.

    Two sets that are linked have LEAST / (LEAST + PARTS) of their sizes' sum in common, which neither's shared shingles may fall below.
    """
    for i in range(len(nodes) - 1):
        rest = np.arange(i + 1, len(nodes))
        rest = rest[(groups[rest] != groups[i]) & (PARTS * np.minimum(sizes[rest], sizes[i]) >= LEAST * np.maximum(sizes[rest], sizes[i]))]
        rest = rest[(LEAST + PARTS) * np.minimum(shared[rest], shared[i]) >= LEAST * (sizes[rest] + sizes[i])]
        rest = rest[(marks[rest] == marks[i]).mean(axis=1) >= FINE_LIKELY]
        if len(rest):
            yield np.full(len(rest), nodes[i]), nodes[rest]


def apart(docs: DataFrame, members: DataFrame, classes: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """(key, node, n, comp, shared, marks, m): members, that may be linked, of the buckets whose members are not all in one component."""
    comp = F.coalesce("component", "node").alias("comp")
    now = members.join(named, "node", "left").select("key", "node", comp)
    split = lambda rows, label: settle(rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).filter("low < high").select("key", "m"), label)
    left = settle(now.join(split(now, "split-buckets"), "key").drop("m"), "members-apart")
    sizes = classes.select("node", "n")
    may = linkable(docs, left.select("node").distinct().join(sizes, "node"), size)
    left = left.join(may, "node")
    left = left.join(split(left, "split-again"), "key")
    return left.join(sizes, "node")


def pairs_apart(members: DataFrame, crowd: int) -> DataFrame:
    """Distinct likely pairs (u, v) across components in each bucket; buckets above ``crowd`` are cut into slices that meet pairwise."""
    ddl = "u bigint, v bigint"
    schema = arrow_schema(ddl)

    def out(held):
        key, node, n, comp, shared, marks = (np.concatenate(x) for x in zip(*held))
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        found = [(u, v) for s, e in zip(starts, starts[1:]) for u, v in likely_pairs(node[s:e], n[s:e], comp[s:e], shared[s:e], marks[s:e])]
        if found:
            u, v = (np.concatenate(x) for x in zip(*found))
            ends = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
            ends = ends[ends[:, 0] != ends[:, 1]]
            for at in range(0, len(ends), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(ends[at : at + 50_000, k]) for k in (0, 1)], schema=schema)

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, *rest = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            rest.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, FINE_VALUES))
            cut = int(np.argmax(key == key[-1]))  # the last bucket may go on in the next batch
            if cut:
                held.append((key[:cut], *(c[:cut] for c in rest)))
            if held and (cut or held[-1][0][-1] != key[0]):
                yield from out(held)
                held = []
            held.append((key[cut:], *(c[cut:] for c in rest)))
        if held:
            yield from out(held)

    slices = F.greatest(F.lit(1), F.ceil(2 * F.col("m") / crowd)).cast("int")
    rows = members.withColumn("slices", F.when(F.col("m") > crowd, slices).otherwise(1)).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.withColumn("key", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).select("key", "node", "n", "comp", "shared", "marks")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, ddl).distinct()


def near_links(docs: DataFrame, classes: DataFrame, size: int, links: DataFrame, crowd: int) -> DataFrame:
    """(node, component) over confirmed links; ``classes`` has a row (node, n, a, b, marks) for each different set, ``links`` those already confirmed."""
    members = buckets(classes)
    first = members.filter("node <> pivot").groupBy("node").agg(F.min("pivot").alias("u")).select("u", F.col("node").alias("v"))
    first = settle(first, "first-pairs")
    # Every node hangs below one smaller pivot at most.
    named = rooted(linked(docs, classes, first, size))
    if not links.isEmpty():
        named = merged(named, links)
    pairs = settle(pairs_apart(apart(docs, members, classes, named, size), crowd).join(first, ["u", "v"], "left_anti"), "pairs")
    if pairs.isEmpty():
        return named
    confirmed = linked(docs, classes, pairs, size)
    return named if confirmed.isEmpty() else merged(named, confirmed)


def near_components(
    docs: DataFrame, size: int = 5, doc_id: str = "doc_id", text: str = "text", empty_alike: bool = False,
    fingerprint: Callable[[np.ndarray], int] | None = None, links: Callable[[DataFrame, DataFrame], DataFrame] | None = None, crowd: int | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set of ``size``-word shingles, and the smallest doc_id reachable over links, itself included.

    Documents of similarity 0.8 or more are linked. Words are runs of characters other than blanks and 0x09 to 0x0D, A-Z in
    lower case; a text of fewer words than a shingle has its whole sequence as one. Texts without words, nulls too, have the
    empty set, which is linked with nothing, or with other empty sets if ``empty_alike``. Texts of any length are read whole,
    one at a time. Rows of one repeated id are one document, linked where any of its texts is; rows without an id have no
    component and link nothing. An empty table gives no rows. Columns other than the two named are not read.
    ``links(docs, classes)`` may confirm links by other candidates first; ``fingerprint`` of the set's hashes is its column f0.
    """
    with scratch(docs.sparkSession):
        return _near_components(docs, size, doc_id, text, empty_alike, fingerprint, links, crowd or CROWD)


def _near_components(docs, size, doc_id, text, empty_alike, fingerprint, links, crowd) -> DataFrame:
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = settle(sketches(own, size, fingerprint), "sketches")
    key = ["n", "c0", "c1"]
    ided = prints.filter("doc_id IS NOT NULL" if empty_alike else "doc_id IS NOT NULL AND n > 0")
    same = ["a", "b", "marks"] + ["f0"] * (fingerprint is not None)
    classes = settle(ided.groupBy(*key).agg(F.min("doc_id").alias("node"), *[F.min(c).alias(c) for c in same]), "classes")
    named_docs = own.filter("doc_id IS NOT NULL")
    ids = settle(ided.select("doc_id", *key).distinct().join(classes.select("node", *key), key).select("doc_id", "node"), "nodes")
    repeated = ids.groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1").select("doc_id")
    before = ids.join(repeated, "doc_id").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    if links is not None:
        before = before.unionByName(links(named_docs, classes))
    named = near_links(named_docs, classes, size, before, crowd)
    found = ids.join(named, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    whole = prints.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return settle(whole, "near-components", lasting=True)
