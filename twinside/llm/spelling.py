"""Operator 11: spelling variants by blocked Gram matrices.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. Their letter counts then differ by a squared distance of one
(lengths one apart) or of two at most (equal lengths). Words stand in blocks of
equal length; the matrix product of the letter counts of two blocks gives all
their squared distances at once, and only pairs of at most two are compared
letter by letter.

Blocks are cut finer by how many letters of each of a few classes a word has:
one edit moves one letter into, out of or between classes, so a block meets
itself and the few blocks that differ by that. Blocks of many words are cut into
chunks that meet pairwise.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from twinside.llm.common import arrow_schema, batches_of, map_rows, rows_of
from twinside.session import settle

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in so many loses a letter, by its checksum.
DAMAGE = 31
#: Letters share columns, which only lowers distances, and those columns share classes.
COLUMNS, CLASSES = 32, 6
#: Words of a block that one task holds, words that are multiplied with them at a time, and letters of both.
CHUNK, STRIP, LETTERS = 2_048, 2_048, 4_000_000
#: Different words a task counts before it hands them on.
WORDS = 300_000


def lowered(text: str | None) -> str:
    """A-Z in lower case, nothing else."""
    return (text or "").encode().lower().decode()


def document_words(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """Words of a document and how often, with the letters that checksums delete."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(RUN.findall(lowered(text))).items():
        h = zlib.crc32(word.encode(), start)
        if h % DAMAGE == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        yield word, n


def word_counts(docs: DataFrame, least_length: int = 7, least: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of so many letters and occurrences."""
    ddl = "word string, n bigint"
    schema = arrow_schema(ddl)

    def run(batches):
        held = Counter()
        for batch in batches:
            for key, body in rows_of(batch):
                for word, n in document_words(key, body):
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= WORDS:
                    yield from batches_of(iter(held.items()), schema)
                    held.clear()
        yield from batches_of(iter(held.items()), schema)

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(run, ddl).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def class_counts(letters: np.ndarray) -> np.ndarray:
    """How many letters of each class the word has."""
    return np.bincount(letters % COLUMNS % CLASSES, minlength=CLASSES)


def block_of(length: int, counts: tuple) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(np.array([length, *counts], "<i8").tobytes()) - (1 << 63)


def meeting_blocks(length: int, counts: tuple) -> Iterator[int]:
    """Blocks a word visits: those with one letter more, and of each two blocks that differ by a replaced letter the one of later classes."""
    for k in range(CLASSES):
        more = (*counts[:k], counts[k] + 1, *counts[k + 1 :])
        yield block_of(length + 1, more)
        for other in range(k):
            if more[other]:
                yield block_of(length, (*more[:other], more[other] - 1, *more[other + 1 :]))


def blocked(words: DataFrame) -> DataFrame:
    """(word, n, home, visits): the block of every word and those in which it may have near words."""
    ddl = "word string, n bigint, home bigint, visits array<bigint>"

    def start():
        known = {}

        def row(word, n):
            key = (len(word), *class_counts(np.frombuffer(word.encode("latin-1"), np.uint8)).tolist())
            if key not in known:
                if len(known) > 100_000:
                    known.clear()
                known[key] = block_of(key[0], key[1:]), list(meeting_blocks(key[0], key[1:]))
            return word, n, *known[key]

        return row

    return map_rows(words.select("word", "n"), start, ddl)


def letter_matrix(words: list[bytes]) -> np.ndarray:
    """A row of letters for each word of one length."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """Squared distances of these are exact: single precision holds them for words up to 1,000 letters."""
    n, length = letters.shape
    at = (np.arange(n)[:, None] * COLUMNS + letters % COLUMNS).ravel()
    return np.bincount(at, minlength=n * COLUMNS).reshape(n, COLUMNS).astype(np.float32 if length <= 1_000 else np.float64)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether dropping one letter of the long word gives the short one: their tails agree from the first letter that differs."""
    length = short.shape[1]
    ahead, behind = short != long[:, :length], short != long[:, 1:]
    first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), length)
    last = np.where(behind.any(axis=1), length - 1 - behind[:, ::-1].argmax(axis=1), -1)
    return last < first


def near(a: np.ndarray, b: np.ndarray, within: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words in two letter matrices; ``within`` one matrix every pair once."""
    x, y = letter_counts(a), letter_counts(b)
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    close = squares <= (2 if a.shape[1] == b.shape[1] else 1)
    i, j = np.nonzero(np.triu(close, 1) if within else close)
    out = []
    for at in range(0, len(i), max(1, LETTERS // a.shape[1])):
        p, q = i[at : at + max(1, LETTERS // a.shape[1])], j[at : at + max(1, LETTERS // a.shape[1])]
        if a.shape[1] == b.shape[1]:
            good = one_replaced(a[p], b[q])
        elif a.shape[1] < b.shape[1]:
            good = one_inserted(a[p], b[q])
        else:
            good = one_inserted(b[q], a[p])
        out.append((p[good], q[good]))
    return (np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])) if out else (i, j)


def strips(words: list[bytes]) -> Iterator[slice]:
    step = max(1, min(STRIP, LETTERS // max(1, len(words[0])))) if words else 1
    for at in range(0, len(words), step):
        yield slice(at, at + step)


def near_words(homes: list[tuple[bytes, int]], others: list[tuple[bytes, int]], within: bool) -> Iterator[tuple]:
    """(word, n, near word, its n), both ways, of homes with each other (``within``) or with others of one length."""
    h, v = [w for w, _ in homes], [w for w, _ in others]
    for s in strips(h):
        for t in strips(v):
            if within and t.start < s.start:
                continue
            own = letter_matrix(h[s])
            i, j = near(own, letter_matrix(v[t]) if not within or s != t else own, within and s == t)
            for p, q in zip(i.tolist(), j.tolist()):
                x, y = homes[s.start + p], others[t.start + q]
                yield x[0].decode("latin-1"), y[1], y[0].decode("latin-1")
                yield y[0].decode("latin-1"), x[1], x[0].decode("latin-1")


def block_neighbours(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(word, n of a near word, near word) of rows (block, chunk, role, word, n) sorted by the first three; holds one chunk and one strip of its visitors."""
    now, homes, waiting, inner = None, [], [], True

    def met():
        if homes and waiting:
            yield from near_words(homes, waiting, False)
        waiting.clear()

    def homes_met():
        if not inner:
            yield from near_words(homes, homes, True)

    for block, chunk, role, word, n in rows:
        if (block, chunk) != now:
            yield from homes_met()
            yield from met()
            now, homes, inner = (block, chunk), [], False
        item = (word.encode("latin-1"), n)
        if role == 0:
            homes.append(item)
            continue
        yield from homes_met()
        inner = True
        if waiting and (len(item[0]) != len(waiting[0][0]) or len(waiting) >= STRIP):
            yield from met()
        waiting.append(item)
    yield from homes_met()
    yield from met()


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many near words each word with some has, and the most frequent (n, word), ties to the first in code-point order."""
    rows = settle(blocked(words), "blocks")
    sizes = rows.groupBy(F.col("home").alias("block")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sizes = settle(sizes, "block-sizes")
    mine = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    # A word is at home in its chunk and visits the chunks before it; visitors go to every chunk of a block that has words.
    at_home = rows.withColumnRenamed("home", "block").join(sizes, "block").withColumn("mine", mine)
    at_home = at_home.select("block", "word", "n", "mine", F.explode(F.sequence(F.lit(0), F.col("mine"))).alias("chunk"))
    at_home = at_home.withColumn("role", F.when(F.col("chunk") == F.col("mine"), 0).otherwise(F.length("word")))
    visits = rows.select("word", "n", F.explode("visits").alias("block")).join(sizes, "block")
    visits = visits.select("block", "word", "n", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.length("word").alias("role"))
    order = ["block", "chunk", "role", "word", "n"]
    dealt = at_home.select(*order).unionByName(visits.select(*order))
    ddl = "word string, other_n bigint, other string"
    schema = arrow_schema(ddl)

    def run(batches):
        yield from batches_of(block_neighbours(values for batch in batches for values in rows_of(batch)), schema)

    found = dealt.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "role").mapInArrow(run, ddl)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.count("*").alias("n_near"), best)


def spelling_groups(docs: DataFrame, least_length: int = 7, least: int = 2, factor: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``least_length`` letters and ``least`` occurrences.

    A word's form is its near word of the largest n (ties: the first in code-point order) if that n is at least ``factor``
    times its own, else null; its root is the last of the chain of forms, the word itself without one. Words are maximal runs
    of letters A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case; one run in 31 of a document loses a letter by the checksum
    of ``<doc_id>:<run>``, where a null id is the empty string. Null and empty texts have no words, repeated rows count as
    often as they stand. A document's words are held one document at a time; words of any length are handled. An empty table
    gives no rows. Columns other than the two named are not read.
    """
    words = settle(word_counts(docs, least_length, least, doc_id, text), "words")
    form = F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best"))
    near_by = words.join(neighbours(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form["word"].alias("form"), (-form["less"]).alias("form_n")
    )
    found = settle(near_by, "forms")
    # Each form occurs ten times as often or more, so a chain is short; every round doubles the steps it jumps.
    jumps = settle(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = settle(jumps.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        jumps = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return found.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
