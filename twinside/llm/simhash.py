"""Operator 10: SimHash near-duplicates by the generalised pigeonhole principle.

Bits of the fingerprints are grouped into partitions, correlated bits
together. Each partition gets its own threshold, -1 (unused), 0 or 2, by
dynamic programming on estimated candidate counts; thresholds t_i with
sum(t_i + 1) >= radius + 1 lose no pair within the radius, since a pair beyond
all of them differs in more bits. A fingerprint probes a partition by its value
(0), or by its value and all values one bit away (2: two values are within two
bits if and only if these sets meet). Probes that meet are verified on the whole
fingerprint.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinside.llm.common import arrow_schema, map_rows, rows_of
from twinside.llm.components import components
from twinside.session import settle


@dataclass(frozen=True)
class Spec:
    """What is hashed, how long fingerprints are (in 64-bit words), and how far linked ones may differ."""

    shingle: int = 3
    distinct: bool = False  # count every shingle, or every different one once
    size: int = 1
    radius: int = 2

    @property
    def bits(self) -> int:
        return 64 * self.size

    @property
    def columns(self) -> list[str]:
        return [f"f{k}" for k in range(self.size)]


#: The similarity stage of the pipeline: different words, 128 bits, 17 of them may differ. In texts whose five-word
#: shingles agree to 0.8 about 2 % of the words differ, which moves 5 to 11 % of these bits.
WORD_SETS = Spec(shingle=1, distinct=True, size=2, radius=17)
SEED = 42
#: Shingles whose hashes are held at a time.
HASHES = 65_536
#: Counts of byte values to counts of bits.
BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than blanks and 0x09 to 0x0D, with A-Z in lower case, as UTF-8."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return words if size == 1 else [b" ".join(s) for s in zip(*(words[k:] for k in range(size)))]


def fingerprint(text: str | None, spec: Spec) -> list[int]:
    """Words of the fingerprint as signed longs: a bit is set if more than half of the hashes have it."""
    import xxhash

    found = shingles(words_of(text), spec.shingle)
    if spec.distinct:
        found = list(set(found))
    out = []
    for k in range(spec.size):
        digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED + k)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(found), HASHES):
            part = found[at : at + HASHES]
            octets = np.fromiter(map(digest, part), "<u8", len(part)).view(np.uint8).reshape(-1, 8)
            counts += np.concatenate([np.bincount(octets[:, b], minlength=256) @ BIT_OF_BYTE for b in range(8)])
        bits = (2 * counts > len(found)).astype(np.uint8)
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, spec: Spec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f0, ...) of every row."""

    def start():
        return lambda key, body: (key, *fingerprint(body, spec))

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return map_rows(rows, start, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in spec.columns))


def arrays(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and fingerprints of a batch (node, f0, ...)."""
    cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1 + size)]
    return cols[0], np.stack([c.view(np.uint64) for c in cols[1:]], axis=1)


def bit_columns(prints: np.ndarray) -> np.ndarray:
    """0/1 matrix with a column for each bit; bit b of word k is column 64 k + b."""
    little = np.ascontiguousarray(prints).astype("<u8").view(np.uint8).reshape(len(prints), -1)
    return np.unpackbits(little, axis=1, bitorder="little")


def common_bits(classes: DataFrame, spec: Spec) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and in how many each two bits are both set, over all of them.

    A task returns one matrix; 16 tasks add them up, so the driver gets 16.
    """
    w = spec.bits

    def count(batches):
        n, total = 0, np.zeros((w, w))
        for batch in batches:
            _, prints = arrays(batch, spec.size)
            for at in range(0, len(prints), 8_192):
                x = bit_columns(prints[at : at + 8_192]).astype(np.float32)
                total += x.T @ x
                n += len(x)
        yield pa.RecordBatch.from_pydict({"n": [n], "m": [total.astype("<i8").tobytes()]}, schema=arrow_schema("n bigint, m binary"))

    def add(batches):
        n, total = 0, np.zeros(w * w, np.int64)
        for batch in batches:
            for k, m in rows_of(batch):
                n, total = n + k, total + np.frombuffer(m, "<i8")
        yield pa.RecordBatch.from_pydict({"n": [n], "m": [total.tobytes()]}, schema=arrow_schema("n bigint, m binary"))

    found = classes.select("node", *spec.columns).mapInArrow(count, "n bigint, m binary").repartition(16).mapInArrow(add, "n bigint, m binary").collect()
    total = sum((np.frombuffer(bytes(r["m"]), "<i8") for r in found), np.zeros(w * w, np.int64))
    return sum(r["n"] for r in found), total.reshape(w, w)


def correlations(n: int, both: np.ndarray) -> np.ndarray:
    p = both / max(n, 1)
    mean = np.diag(p)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return np.abs((p - np.outer(mean, mean)) / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of about equal width: each starts with the most correlated free bit and takes those closest to it."""
    free, out = set(range(len(correlation))), []
    for k in range(m):
        width = len(free) // (m - k)
        rest = sorted(free)
        strength = correlation[np.ix_(rest, rest)].sum(axis=1)
        part = [rest[int(np.argmax(strength))]]
        near = correlation[part[0]].copy()
        while len(part) < width:
            best = max((b for b in rest if b not in part), key=lambda b: (near[b], -b))
            part.append(best)
            near += correlation[best]
        free -= set(part)
        out.append(sorted(part))
    return out


def masks(parts: list[list[int]], size: int) -> np.ndarray:
    out = np.zeros((len(parts), size), np.uint64)
    for k, bits in enumerate(parts):
        for b in bits:
            out[k, b // 64] |= np.uint64(1 << (b % 64))
    return out


def near_pairs(classes: DataFrame, spec: Spec, plans: list[list[list[int]]]) -> tuple[int, dict[tuple[int, int], list[int]]]:
    """Over all fingerprints, each paired with its neighbour in the table: how many pairs are within 0 and 2 bits in each partition of each plan."""
    held = [masks(p, spec.size) for p in plans]

    def count(batches):
        pairs, near = 0, {(g, i): [0, 0] for g, p in enumerate(plans) for i in range(len(p))}
        for batch in batches:
            _, prints = arrays(batch, spec.size)
            diff = prints[1:] ^ prints[:-1]
            pairs += len(diff)
            for g, mask in enumerate(held):
                for i in range(len(mask)):
                    d = np.bitwise_count(diff & mask[i]).sum(axis=1)
                    near[g, i][0] += int((d == 0).sum())
                    near[g, i][1] += int((d <= 2).sum())
        rows = [(-1, -1, pairs, 0), *((g, i, *c) for (g, i), c in near.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    ddl = "g bigint, i bigint, same bigint, near bigint"
    schema = arrow_schema(ddl)
    found = classes.select("node", *spec.columns).mapInArrow(count, ddl).groupBy("g", "i").agg(F.sum("same").alias("same"), F.sum("near").alias("near")).collect()
    counts = {(r["g"], r["i"]): [r["same"], r["near"]] for r in found}
    return counts.pop((-1, -1), [0, 0])[0], counts


#: Relative costs of a probe row and of a verified candidate pair.
ROW_COST, PAIR_COST = 1.0, 0.05
#: Costs are those of at least so many fingerprints: a small corpus gets the partitions of a large one, so the probes
#: of a document do not grow with the corpus.
PLAN_FOR = 100_000_000


def thresholds(parts: list[list[int]], radius: int, n: int, pairs: int, near: list[list[int]]) -> tuple[float, list[int]]:
    """Cheapest thresholds -1, 0 or 2 with sum(t + 1) >= radius + 1, and their cost for each fingerprint.

    A partition's share of pairs that meet is the counted one, but at least
    that of evenly spread values.
    """
    need = radius + 1
    best: list[tuple[float, tuple]] = [(0.0, ())] + [(math.inf, ())] * need
    for bits, (same, close) in zip(parts, near):
        w = len(bits)
        share0 = max(same / max(pairs, 1), 2.0**-w)
        share2 = max(close / max(pairs, 1), (1 + w + w * (w - 1) / 2) * 2.0**-w)
        options = ((-1, 0.0), (0, ROW_COST + PAIR_COST * n * share0 / 2), (2, (w + 1) * ROW_COST + PAIR_COST * n * share2 / 2))
        after = [(math.inf, ())] * (need + 1)
        for s, (cost, taken) in enumerate(best):
            for t, more in options:
                to = min(need, s + t + 1)
                if cost + more < after[to][0]:
                    after[to] = (cost + more, (*taken, t))
        best = after
    return best[need][0], list(best[need][1])


def plan_partitions(classes: DataFrame, spec: Spec) -> list[tuple[list[int], int]]:
    """The partitions in use, with their thresholds, of the cheapest of several numbers of partitions."""
    n, both = common_bits(classes, spec)
    correlation = correlations(n, both)
    least = max(2, math.ceil(spec.bits / 40))
    plans = [group_bits(correlation, m) for m in range(least, min(spec.bits // 8, spec.radius + 3) + 1)]
    pairs, near = near_pairs(classes, spec, plans)
    costed = []
    for g, parts in enumerate(plans):
        cost, taken = thresholds(parts, spec.radius, max(n, PLAN_FOR), pairs, [near.get((g, i), [0, 0]) for i in range(len(parts))])
        costed.append((cost, g, taken))
    cost, g, taken = min(costed)
    if math.isinf(cost):
        raise ValueError("no thresholds cover this radius")
    return [(bits, t) for bits, t in zip(plans[g], taken) if t >= 0]


def values_of(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(prints), np.int64)
    for k, b in enumerate(bits):
        out |= ((prints[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64) << k
    return out


def probe_rows(classes: DataFrame, spec: Spec, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, own, node, f0, ...): the probes of every fingerprint; ``own`` marks its own value."""
    ddl = "part int, value bigint, own boolean, node bigint, " + ", ".join(f"{c} bigint" for c in spec.columns)
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            nodes, prints = arrays(batch, spec.size)
            for at in range(0, len(nodes), 4_096):
                n, p = nodes[at : at + 4_096], prints[at : at + 4_096]
                for k, (bits, t) in enumerate(partitions):
                    flips = np.array([0, *((1 << b for b in range(len(bits))) if t == 2 else ())], np.uint64).view(np.int64)
                    value = (values_of(p, bits)[:, None] ^ flips).ravel()
                    own = np.tile(flips == 0, len(n))
                    cols = [np.full(len(value), k, np.int32), value, own, np.repeat(n, len(flips)), *(np.repeat(p[:, j].view(np.int64), len(flips)) for j in range(spec.size))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return classes.select("node", *spec.columns).mapInArrow(run, ddl)


#: Buckets of up to so many probes compare all their pairs at once; larger ones grow a forest.
SMALL = 48


def forest(nodes: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect exactly what links within the radius connect.

    The search starts at the member closest to the majority bits. Reached
    members look for neighbours among those not yet reached, so a group of
    near copies takes few looks.
    """
    order = np.unique(nodes, return_index=True)[1]
    nodes, prints = nodes[order], prints[order]
    bits = np.zeros(prints.shape[1] * 64)
    for at in range(0, len(prints), 8_192):
        bits += bit_columns(prints[at : at + 8_192]).sum(axis=0)
    centre = np.packbits((2 * bits > len(prints)).astype(np.uint8), bitorder="little").view("<u8")
    rest = np.argsort(np.bitwise_count(prints ^ centre).sum(axis=1), kind="stable")
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            here = front.pop()
            close = np.bitwise_count(prints[rest] ^ prints[here]).sum(axis=1) <= radius
            reached = rest[close]
            if len(reached):
                yield np.full(len(reached), nodes[here]), nodes[reached]
                front.extend(reached.tolist())
                rest = rest[~close]


def bucket_links(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links inside buckets: rows with equal keys, which stand together."""
    starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    bucket = np.repeat(np.arange(len(starts)), sizes)
    some = np.flatnonzero(((sizes > 1) & (sizes <= SMALL))[bucket])
    b, n, p = bucket[some], nodes[some], prints[some]
    for d in range(1, SMALL):
        at = np.flatnonzero(b[d:] == b[:-d])
        if not len(at):
            break
        close = at[np.bitwise_count(p[at] ^ p[at + d]).sum(axis=1) <= radius]
        if len(close):
            yield n[close], n[close + d]
    for k in np.flatnonzero(sizes > SMALL):
        own = slice(starts[k], starts[k] + sizes[k])
        yield from forest(nodes[own], prints[own], radius)


def links_of(probes: DataFrame, spec: Spec) -> DataFrame:
    """Distinct verified links (u, v) between nodes whose probes meet; a task holds one bucket, or a batch of small ones."""
    size, radius = spec.size, spec.radius
    schema = arrow_schema("u bigint, v bigint")

    def out(held):
        keys, nodes, prints = (np.concatenate(x) for x in zip(*held))
        found = list(bucket_links(keys, nodes, prints, radius))
        if found:
            u, v = (np.concatenate(x) for x in zip(*found))
            ends = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
            ends = ends[ends[:, 0] != ends[:, 1]]
            for at in range(0, len(ends), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(ends[at : at + 50_000, k]) for k in (0, 1)], schema=schema)

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = np.stack([part, batch.column(1).to_numpy(zero_copy_only=False)], axis=1)
            nodes, prints = arrays(batch.select(range(2, 3 + size)), size)
            cut = int(np.argmax((keys == keys[-1]).all(axis=1)))  # the last bucket may go on in the next batch
            if held and (cut or (held[-1][0][-1] != keys[0]).any()):
                if cut:
                    held.append((keys[:cut], nodes[:cut], prints[:cut]))
                yield from out(held)
                held = []
            elif cut:
                yield from out([(keys[:cut], nodes[:cut], prints[:cut])])
            held.append((keys[cut:], nodes[cut:], prints[cut:]))
        if held:
            yield from out(held)

    rows = probes.select("part", "value", "node", *spec.columns).repartition("part", "value").sortWithinPartitions("part", "value")
    return rows.mapInArrow(run, "u bigint, v bigint").distinct()


#: A bucket expected to get more probes than this is not held by one task.
HEAVY = 200_000


def heavy_links(probes: DataFrame, heavy: DataFrame, spec: Spec) -> DataFrame:
    """Links of the probes in heavy buckets by another exact way.

    Within two bits, two fingerprints meet in the values one bit away from
    them, so buckets of whole values hold at most 65 fingerprints. For larger
    radii the bucket is cut into slices by node, and each two slices meet in a
    bucket of their own.
    """
    rows = probes.join(heavy, ["part", "value"])
    if spec.radius <= 2 and spec.size == 1:
        whole = [(list(range(64)), 2)]
        return links_of(probe_rows(rows.select("node", *spec.columns).distinct(), spec, whole), spec)
    rows = rows.withColumn("slices", F.ceil(2 * F.col("n") / HEAVY).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    pair = F.xxhash64("part", "value", F.least("mine", "other"), F.greatest("mine", "other"))
    return links_of(rows.withColumn("value", pair), spec)


def near_links(classes: DataFrame, spec: Spec, heavy_from: int = HEAVY) -> DataFrame:
    """All links within the radius that are needed to connect what such links connect: distinct (u, v).

    ``classes`` has a row (node, f0, ...) for each different fingerprint.
    """
    partitions = plan_partitions(classes, spec)
    probes = probe_rows(classes, spec, partitions)
    own = [(bits, 0) for bits, _ in partitions]
    widest = max((len(bits) + 1 if t == 2 else 1) for bits, t in partitions)
    crowded = settle(probe_rows(classes, spec, own).groupBy("part", "value").count().filter(F.col("count") * widest > heavy_from), "crowded")
    if crowded.isEmpty():
        return links_of(probes, spec)
    near = F.array(F.col("value"), *[F.col("value").bitwiseXOR(F.lit(1 << b)) for b in range(max(len(bits) for bits, _ in partitions))])
    heavy = crowded.select("part", F.explode(near).alias("value"), "count").groupBy("part", "value").agg(F.sum("count").alias("n"))
    light = probes.join(heavy.select("part", "value"), ["part", "value"], "left_anti")
    return links_of(light, spec).unionByName(heavy_links(probes, heavy, spec)).distinct()


def near_components(docs: DataFrame, spec: Spec = Spec(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f0, ..., component_id) of every row: the smallest doc_id reachable over links, itself included.

    Exact copies share a fingerprint and are one node, named by their smallest
    id. Texts without words, nulls too, have the fingerprint zero and are linked
    like any other. Rows of one repeated id count as one document; a row
    without an id takes the component of its fingerprint, null if no row there
    has one. An empty table gives no rows.
    """
    prints = settle(fingerprints(docs, spec, doc_id, text), "prints")
    classes = settle(prints.groupBy(*spec.columns).agg(F.min("doc_id").alias("node")), "classes")
    links = near_links(classes.filter("node IS NOT NULL"), spec)
    ids = prints.filter("doc_id IS NOT NULL").select("doc_id", *spec.columns).distinct()
    repeated = ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    same_id = ids.join(repeated, "doc_id").join(classes, spec.columns).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    named = components(links.unionByName(same_id))
    whole = settle(classes.join(named, "node", "left").select(*spec.columns, F.coalesce("component", "node").alias("component_id")), "components")
    return prints.join(whole, spec.columns).select("doc_id", *spec.columns, "component_id")


def hex_digits(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
