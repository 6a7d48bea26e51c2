"""Operator 5: byte-level BPE by a segment tree of pair ranks.

Each pre-token is encoded on its own. A segment tree over its byte positions
holds the rank of the pair that begins there; its root gives the smallest rank
and, of equal ones, the leftmost position. A merge updates the merged part and
its left neighbour, two logarithmic point updates.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from twinside.llm.common import even_lines, map_rows, shipped

NONE = 1 << 62
#: Pre-tokens, and words with their blank, whose ids a Python worker keeps; only speed depends on it.
HELD_PIECES, HELD_WORDS = 400_000, 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from lines of ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: merge the pair of the smallest rank, the leftmost of equals, until none is left."""
    n = len(piece)
    if not n:
        return ()
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    if n == 1:
        raise ValueError(f"the ranks lack byte {piece!r}")
    get, shift = ranks.get, n.bit_length()
    ends = list(range(1, n + 1))  # end of the part that begins at a position
    before = list(range(-1, n))  # start of the part to the left
    size = 1 << (n - 2).bit_length()
    # A leaf is (rank, position) as one number: a smaller rank first, then the leftmost.
    tree = [NONE] * size + [NONE if (r := get(piece[i : i + 2])) is None else r << shift | i for i in range(n - 1)] + [NONE] * (size - n + 1)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(k: int, value: int) -> None:
        """Point update of leaf ``k``: up to the root, or until an ancestor keeps its value."""
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                return
            tree[k] = value

    low = (1 << shift) - 1
    while (top := tree[1]) != NONE:
        i = top & low
        j = ends[i]  # the right part of the pair joins the part at i
        end = ends[i] = ends[j]
        before[end] = i
        if end < n:
            put(size + j, NONE)
            r = get(piece[i : ends[end]])
        else:
            r = None
            if j < n - 1:
                put(size + j, NONE)
        put(size + i, NONE if r is None else r << shift | i)
        if (h := before[i]) >= 0:
            r = get(piece[h:end])
            put(size + h, NONE if r is None else r << shift | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return tuple(out)


def coder(ranks: dict[bytes, int], pattern: str) -> tuple[Callable[[str], list[int]], Callable[[list[int]], bytes]]:
    """Encoding of a text and decoding of ids; the ids of words and of their pre-tokens are kept."""
    import regex

    find = regex.compile(pattern).findall
    token = {i: b for b, i in ranks.items()}

    @lru_cache(HELD_PIECES)
    def ids_of(piece: str) -> tuple[int, ...]:
        return encode_piece(piece.encode(), ranks)

    def word(text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(ids_of, find(text))))

    head = lru_cache(HELD_WORDS // 8)(word)

    @lru_cache(HELD_WORDS)
    def tail(text: str) -> tuple[int, ...]:
        return word(" " + text)

    def encode(text: str) -> list[int]:
        lines = even_lines(text)
        if lines is None:
            return list(chain.from_iterable(map(ids_of, find(text))))
        out = []
        for k, words in enumerate(lines):
            if k:
                out += head("\n")
            out += head(words[0])
            out += chain.from_iterable(map(tail, words[1:]))
        return out

    def decode(ids: list[int]) -> bytes:
        return b"".join(map(token.__getitem__, ids))

    return encode, decode


@lru_cache(2)
def kept_coder(path: str, pattern: str):
    """One coder for all tasks that a Python worker runs, and the ids in decimal."""
    ranks = read_ranks(path)
    return *coder(ranks, pattern), [str(i) for i in range(max(ranks.values(), default=-1) + 1)]


def task_coder(name: str, pattern: str):
    """The coder of a task, from the vocabulary file that Spark has sent to its node."""
    return kept_coder(SparkFiles.get(name), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text as ``array<int>``; ids with null or empty text have none."""
    name = shipped(docs.sparkSession, ranks_path)

    def start():
        encode, _, _ = task_coder(name, pattern)
        return lambda key, body: (key, encode(body or ""))

    return map_rows(docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")), start, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str = "") -> DataFrame:
    """UTF-8 bytes of ``(doc_id, ids)`` rows."""
    name = shipped(encoded.sparkSession, ranks_path)

    def start():
        _, decode, _ = task_coder(name, pattern)
        return lambda key, ids: (key, decode(ids or []))

    return map_rows(encoded.select("doc_id", "ids"), start, "doc_id bigint, bytes binary")


def encoded_documents(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``round_trip`` and the ids themselves."""
    return round_trip(docs, ranks_path, pattern, doc_id, text, ids=True)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Number and digest of the ids of every whole text, and digest of the bytes decoded from them.

    One row per input row, without a shuffle; a task holds one text at a time.
    Null and empty texts have no ids; a null id stays null; repeated rows are
    encoded alike; a long text without a break is one pre-token and takes
    O(n log n); an empty table gives no rows.
    """
    name = shipped(docs.sparkSession, ranks_path)

    def start():
        encode, decode, shown = task_coder(name, pattern)

        def row(key, body):
            found = encode(body or "")
            listed = ",".join(map(shown.__getitem__, found))
            out = key, len(found), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decode(found)).hexdigest()
            return (*out, found) if ids else out

        return row

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return map_rows(rows, start, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
