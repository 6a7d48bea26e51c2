"""Operator 1: token-id files.

Documents are encoded and written in ascending order of their ids. Each one is
a zstandard frame of its own, made with a dictionary that was trained on
serialised id arrays and is shared by all. Frames stand in blocks; a block is
one Parquet row with its payload, the dictionary's hash, and the index of its
documents (id, byte offset, tokens), so one short document is read by one block
and one frame. Parquet is only the container: files are committed by Spark, on
any store, and a retried or speculative task leaves nothing behind.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from twinside.llm.common import BEFORE_BLANK, even_lines, map_partition, shipped
from twinside.session import settle, work_path

END_ID = 0
#: The dictionary is trained on at most so many documents of at most so many characters, the first by a hash of their ids.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1_000, 16_384, 65_536
#: A block is closed after so many payload bytes.
BLOCK_BYTES = 1_000_000
#: Words whose ids a Python worker keeps (twice as many at most); only speed depends on it.
HELD_WORDS = 400_000
BLOCKS = "part bigint, block bigint, first_doc bigint, last_doc bigint, dict_sha256 string, id_bytes bigint, start_in_part bigint, n_tokens bigint, doc_ids array<bigint>, offsets array<bigint>, counts array<bigint>, payload binary"


MARKS = ".,;:!?"
#: Byte-level vocabularies show bytes that are no visible characters by those from U+0100 on; a blank is one of them.
HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
SHOWN = {b: 256 + k for k, b in enumerate(HIDDEN)}
BLANK = chr(SHOWN[32])


class Kept(dict):
    """Words and their ids, in two generations: when the new one is full it becomes the old one, and what is asked for moves over."""

    def __init__(self, held: int, learn: Callable[[str], bytes]):
        super().__init__()
        self.held, self.learn, self.old = held, learn, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.held:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        self[word] = ids = self.learn(word) if ids is None else ids
        return ids


class WordIds:
    """Serialised ids of texts by the tokenizers library, which sees each word once while it is kept."""

    def __init__(self, path: str, held: int = HELD_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens match anywhere in a text, so texts that hold one are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.id_bytes}", "H" if self.id_bytes == 2 else "I"
        self.heads, self.words = Kept(max(1, held // 8), self.head), Kept(held, self.word)
        self.end = np.array([END_ID], self.kind).tobytes()
        self.line_break, *marks = self.encoded(["\n", *MARKS])
        self.marks = dict(zip(MARKS, marks))
        self.merge = self.tokenizer.model.tokenize
        self.direct = self.merges_alone()

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, word: str, before: str) -> bytes:
        """A word of letters only, with a blank before it or none: one match of the pattern, so the merges alone are asked for."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(SHOWN)
        return array(self.code, [t.id for t in self.merge(before + shown)]).tobytes()

    def merges_alone(self) -> bool:
        """Whether the vocabulary treats a blank and letters as the byte-level ones do."""
        probe = ["the", "na\u00efve", "\u00df", "\u043c\u0438\u0440", "\u6f22"]
        return all(
            [self.letters(w, before) for w in probe] == self.encoded([blank + w for w in probe]) for before, blank in ((BLANK, " "), ("", ""))
        )

    def head(self, word: str) -> bytes:
        """Ids of the first word of a line."""
        return self.letters(word, "") if self.direct and word.isalpha() else self.encoded([word])[0]

    def word(self, word: str) -> bytes:
        """Ids of a word that follows a blank; a mark after a letter is a token of its own pattern match."""
        if word[-1] in MARKS and word[-2:-1].isalpha():
            return self.words[word[:-1]] + self.marks[word[-1]]
        return self.letters(word, BLANK) if self.direct and word.isalpha() else self.encoded([" " + word])[0]

    def text(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self.encoded([text])[0]
        lines = even_lines(text)
        if lines:
            head, word = self.heads.__getitem__, self.words.__getitem__
            return self.line_break.join([head(ws[0]) + b"".join(map(word, ws[1:])) for ws in lines])
        return b"".join(self.encoded(BEFORE_BLANK.split(text))) if text else b""

    def serialised(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text with the end id."""
        return [self.text(t) + self.end for t in texts]


_WORKERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder for all tasks of a Python worker."""
    if path not in _WORKERS:
        _WORKERS[path] = WordIds(path)
    return _WORKERS[path]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of serialised arrays; with too few samples to train on, their raw bytes; with none, empty."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit_dictionary(docs: DataFrame, tokenizer_path: str, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> bytes:
    """The dictionary of a table; the driver sees only the bounded sample."""
    short = docs.filter(F.length("text").between(1, sample_chars)).withColumn("h", F.xxhash64("doc_id", "text"))
    last = short.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    rows = short.filter(F.col("h") <= last).limit(sample_docs).collect() if last is not None else []
    return train_dictionary(WordIds(tokenizer_path).serialised(sorted(r["text"] for r in rows)))


def zstd_dictionary(raw: bytes):
    import zstandard

    if not raw:
        return None
    full = raw[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


def blocks(rows: Iterator[tuple], encoder: WordIds, raw: bytes, part: int, level: int = 3, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple]:
    """Blocks of a sorted partition of (doc_id, text) rows."""
    import zstandard

    held = zstd_dictionary(raw)
    if held:
        held.precompute_compress(level=level)
    press = zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=True)
    digest = hashlib.sha256(raw).hexdigest()
    number = start = 0
    ids, offsets, counts, frames = [], [0], [], []

    def block():
        named = [k for k in ids if k is not None]
        return part, number, *(named[:1] or [None]), *(named[-1:] or [None]), digest, encoder.id_bytes, start, sum(counts), ids, offsets, counts, b"".join(frames)

    for keys, texts in pieces(rows):
        for key, body in zip(keys, encoder.serialised(texts)):
            frame = press.compress(body)
            ids.append(key)
            counts.append(len(body) // encoder.id_bytes)
            offsets.append(offsets[-1] + len(frame))
            frames.append(frame)
            if offsets[-1] >= block_bytes:
                yield block()
                number, start = number + 1, start + sum(counts)
                ids, offsets, counts, frames = [], [0], [], []
    if ids:
        yield block()


def pieces(rows: Iterable[tuple], chars: int = 1_000_000) -> Iterator[tuple[list, list]]:
    keys, texts, size = [], [], 0
    for key, text in rows:
        keys.append(key)
        texts.append(text or "")
        size += len(texts[-1])
        if size >= chars or len(keys) >= 4_096:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, doc_id: str = "doc_id", text: str = "text") -> bytes:
    """Write the token files of a table to ``path`` and return the dictionary, which also stands beside them.

    Files follow each other in ascending doc_id (null first, equal ids by
    text). Null and empty texts have only the end id; repeated rows are
    repeated documents; an empty table gives no blocks and an empty dictionary.
    A task holds about a megabyte of texts and one block, or one longer document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    raw = fit_dictionary(rows, tokenizer_path)
    name, shared = shipped(spark, tokenizer_path), spark.sparkContext.broadcast(raw)

    def run(part_rows):
        yield from blocks(part_rows, word_ids(SparkFiles.get(name)), shared.value, TaskContext.get().partitionId())

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_partition(ordered, run, BLOCKS).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(hashlib.sha256(raw).hexdigest(), bytearray(raw))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return raw


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.schema("dict_sha256 string, dictionary binary").parquet(f"{path}/dictionary").first()
    raw = bytes(row["dictionary"])
    if hashlib.sha256(raw).hexdigest() != row["dict_sha256"]:
        raise ValueError("the dictionary does not have its hash")
    return raw


def frames_of(rows: Iterable[tuple], raw: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(doc_id, part, start in the part, ids) of each document of (part, dict_sha256, id_bytes, start_in_part, doc_ids, offsets, payload) rows."""
    import zstandard

    own, held = hashlib.sha256(raw).hexdigest(), zstd_dictionary(raw)
    open_frame = zstandard.ZstdDecompressor(dict_data=held)
    for part, digest, width, start, doc_ids, offsets, payload in rows:
        if digest != own:
            raise ValueError("a block was written with another dictionary")
        view = memoryview(payload)
        for key, a, b in zip(doc_ids, offsets, offsets[1:]):
            ids = np.frombuffer(open_frame.decompress(view[a:b]), f"<u{width}")
            yield key, part, start, ids
            start += len(ids)


FRAME_COLUMNS = ("part", "dict_sha256", "id_bytes", "start_in_part", "doc_ids", "offsets", "payload")


def block_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Start, length and crc32 of every document, read back from its frame.

    The starts of the parts are sums over a few numbers per write task; they
    are written, so Spark knows that the table is small when it joins it.
    """
    stored = block_table(spark, path)
    per_part = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")), "starts")
    shared = spark.sparkContext.broadcast(read_dictionary(spark, path))

    def run(rows):
        for key, part, start, ids in frames_of(rows, shared.value):
            yield key, part, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    found = map_partition(stored.select(*FRAME_COLUMNS), run, "doc_id bigint, part bigint, start_in_part bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents: only their blocks are read, and only their frames opened."""
    wanted = sorted(set(doc_ids))
    near = F.exists(F.array(*[F.lit(d).cast("bigint") for d in wanted]), lambda d: (F.col("first_doc") <= d) & (F.col("last_doc") >= d)) if wanted else F.lit(False)
    rows = block_table(spark, path).filter(F.col("last_doc") >= min(wanted, default=0)).filter(F.col("first_doc") <= max(wanted, default=0)).filter(near)
    shared, chosen = spark.sparkContext.broadcast(read_dictionary(spark, path)), set(wanted)

    def run(part_rows):
        for part, digest, width, start, keys, offsets, payload in part_rows:
            for k, key in enumerate(keys):
                if key in chosen:
                    one = (part, digest, width, 0, [key], [0, offsets[k + 1] - offsets[k]], payload[offsets[k] : offsets[k + 1]])
                    for _, _, _, ids in frames_of([one], shared.value):
                        yield key, ids.tolist()

    return map_partition(rows.select(*FRAME_COLUMNS), run, "doc_id bigint, ids array<bigint>")


def token_summary(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the files to a fresh folder and summarise what is read back."""
    path = work_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path)
    return read_summary(docs.sparkSession, path)
