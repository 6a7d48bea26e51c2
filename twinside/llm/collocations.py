"""Operator 13: phrase collocations by SON partitioning.

Documents are dealt into shards. Each shard is mined completely, level by level,
at a support lowered in proportion to its share of the text: a phrase of
``least`` occurrences has, in one shard at least, its proportional part of them.
The phrases frequent in some shard are the candidates; they are counted over all
documents by 64-bit hashes, together with one text that holds each of them. From that
text, those that are frequent get their words.

A shard may be of any size and is mined by many tasks, whose counts Spark adds
up. What a task has to know of the level before, or of the candidates, comes as
a Bloom filter of fixed size: it loses none, and what it lets through wrongly
falls at the next exact count.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from twinside.llm import bloom
from twinside.llm.bloom import mixed
from twinside.llm.common import arrow_schema, batches_of, rows_of
from twinside.session import settle

#: Shards; languages share CELLS classes while shards are mined. Both lie in the low bits of a phrase's hash.
SHARDS, CELLS = 6, 64
TAG_BITS, SHARD_BITS = 9, 3
LONGEST = 4
#: Bytes of texts whose words a task holds at a time, phrases it counts at a time, and the most rows of a batch it hands on.
PART, KEYS, ROWS = 1_000_000, 2_000_000, 100_000
#: Characters of the corpus for each bucket of hashes: some two million phrases.
BUCKET_CHARS = 6_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A word's hash is a polynomial of its bytes' random values; there are two of them, with odd multipliers.
RANDOM = np.random.default_rng(42)
VALUES = RANDOM.integers(0, 1 << 63, size=(2, 256), dtype=np.uint64)
POINTS = RANDOM.integers(0, 1 << 62, size=2, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
#: Characters that end a piece, and blanks.
END, BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(END)], KIND[list(BLANK)] = 2, 1
#: Texts of a part are joined by the end of a piece.
JOIN, PIECE = b".", re.compile(b"[" + re.escape(END) + b"]")


def parts_of(rows: Iterable[tuple]) -> Iterator[tuple[list[tuple], bytes]]:
    """([(label, bytes), ...], their texts joined) of (label, text) rows, lower-cased, about PART bytes at a time.

    A longer text is cut after a piece; one longer piece is held whole.
    """
    held, texts, size = [], [], 0
    for label, text in rows:
        body, at = (text or "").encode().lower(), 0
        while at < len(body) or not at:
            cut = len(body)
            if cut - at > PART:
                last = max(body.rfind(bytes([c]), at, at + PART) for c in END) + 1
                ahead = None if last else PIECE.search(body, at + PART)
                cut = last if last else ahead.end() if ahead else cut
            held.append((label, cut - at + 1))
            texts.append(body[at:cut])
            size += cut - at + 1
            at = cut or 1
            if size >= PART:
                yield held, JOIN.join([*texts, b""])
                held, texts, size = [], [], 0
    if held:
        yield held, JOIN.join([*texts, b""])


class Words:
    """The words of a part: where they start and end, their hashes, the piece each lies in, and the text."""

    def __init__(self, body: bytes, sizes: list[int]):
        self.body = body
        octets = np.frombuffer(body, np.uint8)
        kind = KIND[octets]
        edge = np.diff(np.concatenate([[0], kind == 0, [0]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start] if len(self.start) else self.start
        self.text = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        length = self.end - self.start
        self.hash = np.zeros(len(self.start), np.uint64)
        if len(length):
            letters = octets[kind == 0]
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            place = np.arange(len(letters), dtype=np.int32) - np.repeat(first, length).astype(np.int32)
            for value, point in zip(VALUES, POINTS):
                power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(length.max()) - 1, point)]).astype(np.uint64))
                self.hash = self.hash * MIX + mixed(np.add.reduceat(value[letters] * power[place], first) + length.astype(np.uint64))

    def phrase(self, at: int, size: int) -> str:
        return b" ".join(self.body[self.start[at] : self.end[at + size - 1]].split()).decode()


def phrase_hashes(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hash of the phrase at each word, whether it lies inside a piece)."""
    h = mixed(words.hash)
    yield 1, h, np.ones(len(h), bool)
    for size in range(2, LONGEST + 1):
        n = len(words.hash) - size + 1
        if n < 1:
            return
        h = mixed(h[:n] * MIX + words.hash[size - 1 :])
        yield size, h, words.piece[:n] == words.piece[size - 1 :]


def tagged(h: np.ndarray, tags: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(TAG_BITS) << np.uint64(TAG_BITS)) | tags[: len(h)]


def blocks_of(keys: list[np.ndarray], marks: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """(bucket, keys, counts) as bytes, for the buckets of the first ``bits`` bits, and one mark of each key if there are any."""
    if marks:
        key, first, count = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
        mark = np.concatenate(marks)[first]
    else:
        key, count = np.unique(np.concatenate(keys), return_counts=True)
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(key)]])
    count = count.astype(np.uint32)
    for a, b in zip(at.tolist(), at[1:].tolist()):
        yield int(bucket[a]), key[a:b].tobytes(), count[a:b].tobytes(), *([mark[a:b].tobytes()] if marks else [])


def phrase_sums(rows: DataFrame, found, need: list[int], bits: int, marked: bool = False) -> DataFrame:
    """(key, n) of the phrases that ``found`` picks from a task's words and their labels, and that occur as often as ``need`` has it for the tag in their key.

    If ``marked``, ``found`` picks (keys, marks), and a phrase has the mark of one of its places. Counts travel in blocks, one
    for each bucket of hashes; a task adds up one bucket at a time.
    """
    ddl, out = "bucket bigint, keys binary, counts binary", "key bigint, n bigint"
    if marked:
        ddl, out = ddl + ", marks binary", out + ", mark bigint"
    schema, limits = arrow_schema(out), np.array(need, np.int64)

    def run(batches):
        def blocks():
            keys, marks, size = [], [], 0
            for held, body in parts_of((row[:-1], row[-1]) for batch in batches for row in rows_of(batch)):
                words = Words(body, [size for _, size in held])
                if len(words.hash):
                    picked = found(words, [label for label, _ in held])
                    keys += picked[0] if marked else picked
                    marks += picked[1] if marked else []
                    size = sum(map(len, keys))
                    if size >= KEYS:
                        yield from blocks_of(keys, marks, bits)
                        keys, marks, size = [], [], 0
            if size:
                yield from blocks_of(keys, marks, bits)

        yield from batches_of(blocks(), arrow_schema(ddl))

    def summed(held):
        key = np.concatenate([np.frombuffer(row[0], np.uint64) for row in held])
        count = np.concatenate([np.frombuffer(row[1], np.uint32) for row in held]).astype(np.int64)
        order = np.argsort(key)
        key, count = key[order], count[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        key, count = key[first], np.add.reduceat(count, first)
        good = count >= limits[(key & np.uint64((1 << TAG_BITS) - 1)).astype(np.int64)]
        columns = [key[good].view(np.int64), count[good]]
        if marked:
            columns.append(np.concatenate([np.frombuffer(row[2], np.int64) for row in held])[order][first][good])
        for at in range(0, len(columns[0]), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + ROWS]) for c in columns], schema=schema)

    def add(batches):
        now, held = None, []
        for batch in batches:
            for bucket, *row in rows_of(batch):
                if bucket != now and held:
                    yield from summed(held)
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield from summed(held)

    return rows.mapInArrow(run, ddl).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, out)


def tags_of(words: Words, labels: list[tuple]) -> np.ndarray:
    return np.array([tag for (tag,) in labels], np.uint64)[words.text]


def words_and_pairs(words: Words, labels: list[tuple]) -> list[np.ndarray]:
    tags = tags_of(words, labels)
    return [tagged(h, tags)[inside] for size, h, inside in phrase_hashes(words) if size <= 2]


def of_frequent_pairs(shipped, words: Words, labels: list[tuple]) -> list[np.ndarray]:
    """Phrases of three words or more whose pairs of neighbouring words may all be frequent in the shard."""
    tags = tags_of(words, labels)
    out, pair, chain = [np.zeros(0, np.uint64)], None, None
    for size, h, inside in phrase_hashes(words):
        if size == 2:
            pair = chain = inside.copy()
            pair[inside] = bloom.holds(shipped.value, tagged(h, tags)[inside])
        elif size > 2:
            chain = chain[: len(h)] & pair[size - 2 :] & inside
            out.append(tagged(h, tags)[chain])
    return out


def candidate_places(shipped, words: Words, labels: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, places, keys, marks of their texts) of the candidates among a part's phrases (lang, cell, mark); a key is 64 bits of the language and the phrase."""
    import xxhash

    salts = {lang: xxhash.xxh64_intdigest(lang) for lang, _, _ in labels}
    salt = np.array([salts[lang] for lang, _, _ in labels], np.uint64)[words.text]
    cells = np.array([cell << SHARD_BITS for _, cell, _ in labels], np.uint64)[words.text]
    marks = np.array([mark for _, _, mark in labels], np.int64).view(np.uint64)[words.text]
    for size, h, inside in phrase_hashes(words):
        at = np.flatnonzero(inside)
        at = at[bloom.holds(shipped.value, tagged(h, cells)[at])]
        yield size, at, mixed(h[at] + salt[at]), marks[at]


def candidate_keys(shipped, words: Words, labels: list[tuple]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    _, _, keys, marks = zip(*candidate_places(shipped, words, labels))
    return list(keys), list(marks)


def spelled(docs: DataFrame, candidates, frequent) -> DataFrame:
    """(key, lang, size, phrase, n): frequent phrases as they stand in the text whose mark ``frequent`` holds with their key, and a task's words of each language as n of size 0.

    A phrase is named from one text, so rows follow the phrases, not the phrases of each task. What the filter lets through
    wrongly is named again, or named in vain.
    """
    ddl = "key bigint, lang string, size int, phrase string, n bigint"

    def named(parts):
        known, total = set(), {}
        for held, body in parts:
            words, labels = Words(body, [size for _, size in held]), [label for label, _ in held]
            texts = np.bincount(words.text, minlength=len(held)).tolist()
            for (lang, _, _), n in zip(labels, texts):
                total[lang] = total.get(lang, 0) + n
            if not len(words.hash):
                continue
            for size, at, key, mark in candidate_places(candidates, words, labels):
                good = bloom.holds(frequent.value, key ^ mark)
                key, where = np.unique(key[good], return_index=True)
                for k, i in zip(key.view(np.int64).tolist(), at[good][where].tolist()):
                    if k not in known:
                        known.add(k)
                        yield k, labels[words.text[i]][0], size, words.phrase(i, size), 0
            if len(known) > KEYS:
                known = set()
        yield from ((None, lang, 0, "", n) for lang, n in total.items())

    def run(batches):
        texts = ((row[:-1], row[-1]) for batch in batches for row in rows_of(batch))
        yield from batches_of(named(parts_of(texts)), arrow_schema(ddl))

    return docs.select("lang", "cell", "mark", "text").mapInArrow(run, ddl)


def phrase_names(docs: DataFrame, candidates, frequent) -> DataFrame:
    """(key, lang, size, phrase, n): what the keys of the frequent phrases stand for, and a row of size 0 with the words of each language as n."""
    return spelled(docs, candidates, frequent).groupBy("key", "lang", "size", "phrase").agg(F.sum("n").alias("n"))


def tag_sizes(docs: DataFrame) -> dict[int, int]:
    """Characters of each tag; the driver gets one number for each, 384 at most."""
    return {r["tag"]: r["size"] or 0 for r in docs.groupBy("tag").agg(F.sum(F.length("text")).alias("size")).collect()}


def local_supports(sizes: dict[int, int], least: int) -> list[int]:
    """For each tag, the support in that shard: its share of the characters of its class of languages, times ``least``.

    Any shares that add up to one lose no phrase.
    """
    whole = [sum(sizes.get(c << SHARD_BITS | s, 0) for s in range(SHARDS)) for c in range(CELLS)]
    return [max(1, -(-least * sizes.get(t, 0) // max(1, whole[t >> SHARD_BITS]))) for t in range(CELLS << SHARD_BITS)]


def frequent_phrases(docs: DataFrame, least: int = 30, lang: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(lang, size, phrase, n): every phrase of 1 to 4 words with ``least`` occurrences or more in its language, and a row of size 0 with all its words."""
    spark = docs.sparkSession
    cell = F.pmod(F.xxhash64("lang"), F.lit(CELLS)).cast("int")
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.xxhash64(F.col(doc_id)).alias("id"), F.col(text).cast("string").alias("text"))
    shard = F.pmod("id", F.lit(SHARDS)).cast("int")
    own = own.select("lang", cell.alias("cell"), F.shiftleft(cell, SHARD_BITS).bitwiseOR(shard).cast("bigint").alias("tag"), F.xxhash64("id", "lang", "text").alias("mark"), "text")
    sizes = tag_sizes(own)
    need = local_supports(sizes, least)
    bits = max(6, math.ceil(math.log2(1 + sum(sizes.values()) / BUCKET_CHARS)))
    rows = own.select("tag", "text")
    small = settle(phrase_sums(rows, words_and_pairs, need, bits), "frequent-pairs")
    shipped = spark.sparkContext.broadcast(bloom.built(small, "key"))
    large = settle(phrase_sums(rows, lambda words, labels: of_frequent_pairs(shipped, words, labels), need, bits), "frequent-phrases")
    every = small.unionByName(large).select(F.col("key").bitwiseAND(~((1 << SHARD_BITS) - 1)).alias("key"))
    candidates = spark.sparkContext.broadcast(bloom.built(every, "key"))
    texts = own.select("lang", "cell", "mark", "text")
    whole = settle(phrase_sums(texts, lambda words, labels: candidate_keys(candidates, words, labels), [least] * len(need), bits, marked=True), "phrase-counts")
    frequent = spark.sparkContext.broadcast(bloom.built(whole.select(F.col("key").bitwiseXOR(F.col("mark")).alias("place")), "place"))
    names = settle(phrase_names(own, candidates, frequent), "phrase-names")
    counted = names.filter("size > 0").drop("n").join(whole.drop("mark"), "key").select("lang", "size", "phrase", "n")
    return settle(counted.unionByName(names.filter("size = 0").select("lang", "size", "phrase", "n")), "phrases")


def part(size: int, start: int) -> Column:
    """Words ``start`` (from 1) to ``start + size - 1`` of a phrase."""
    return F.array_join(F.slice("words", start, size), " ")


def cut_score() -> Column:
    """floor(2000000 a / (l + r)) in decimals: the product may pass 64 bits."""
    return F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(2000000 AS DECIMAL(8,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")


def collocations(docs: DataFrame, least: int = 30, top: int = 2_000, lang: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    A phrase of 2 to 4 words with a >= ``least`` occurrences scores floor(2000000 a / (l + r)) at its weakest cut, whose parts
    occur l and r times; equal scores go to the earliest cut. A phrase is dropped if a longer one holds it with 80 % of its
    occurrences or more, dropped or not. Equal ranks go by a, then by the phrase in byte order. Null languages are ``und``,
    null and empty texts have no words, repeated rows count as often as they stand, ids only deal rows to shards and may be
    null. Texts are taken in parts that end with a piece; one piece is held whole. An empty table gives no rows. Columns other
    than the three named are not read.
    """
    found = frequent_phrases(docs, least, lang, doc_id, text)
    totals = found.filter("size = 0").select("lang", F.col("n").alias("total"))
    known = found.filter("size > 0").select("lang", "size", "phrase", F.col("n").alias("a"))
    whole = known.filter("size > 1").withColumn("words", F.split("phrase", " ", -1))
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), part(k, 1).alias("head"), F.array_join(F.expr(f"slice(words, {k + 1}, greatest(size - {k}, 0))"), " ").alias("tail")) for k in range(1, LONGEST)])
    cut = whole.select("lang", "phrase", "a", F.explode(F.filter(cuts, lambda c: c["k"] < F.col("size"))).alias("c"))
    cut = cut.select("lang", "phrase", "a", "c.k", "c.head", "c.tail")
    counts = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cut = cut.join(counts("head", "l"), ["lang", "head"]).join(counts("tail", "r"), ["lang", "tail"])
    weakest = cut.withColumn("score", cut_score()).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("w")).select("lang", "phrase", "w.*")
    inner = F.array(*[F.struct(F.lit(i + k).alias("end"), F.lit(k).alias("size"), part(k, i + 1).alias("phrase")) for k in range(2, LONGEST) for i in range(LONGEST - k + 1)])
    inside = whole.filter("size > 2").select("lang", "size", "a", F.explode(F.filter(inner, lambda p: (p["end"] <= F.col("size")) & (p["size"] < F.col("size")))).alias("p"))
    holder = inside.groupBy("lang", F.col("p.phrase").alias("phrase")).agg(F.max("a").alias("longer"))
    covered = F.expr("CAST(100 AS DECIMAL(3,0)) * CAST(longer AS DECIMAL(19,0)) >= CAST(80 AS DECIMAL(3,0)) * CAST(a AS DECIMAL(19,0))")
    kept = weakest.join(holder, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~covered)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("bigint").alias("score"))
