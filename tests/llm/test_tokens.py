"""Token files, byte BPE and chat formatting: round trips and library versions."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from plain import CLASH, odd_documents, prose, sha
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinside.llm import bpe, chat, token_files
from twinside.llm.queries import PLANTED_TEXT
from twinside.session import work_path

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(RANKS)


def wide(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def test_token_files_hold_the_library_ids(spark, library):
    rows = odd_documents()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = work_path(spark, "tokens")
    token_files.write_tokens(wide(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)), JSON, path)
    got = sorted(map(tuple, token_files.read_summary(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    one = {r["doc_id"]: r["ids"] for r in token_files.read_documents(spark, path, [1, 10, 12345]).collect()}
    assert one == {d: library.encode(t, add_special_tokens=False).ids + [0] for d, t in rows if d in (1, 10)}


def test_token_files_of_an_empty_table_and_of_trained_samples(spark, library):
    assert token_files.token_summary(spark.createDataFrame([], "doc_id bigint, text string"), JSON).collect() == []
    texts = [prose(60, k) for k in range(300)]
    ids = token_files.WordIds(JSON).serialised(texts)
    assert [np.frombuffer(b, "<u2").tolist() for b in ids] == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    raw = token_files.train_dictionary(ids, 8_192)
    blocks = list(token_files.blocks(iter(enumerate(texts)), token_files.WordIds(JSON), raw, 0, block_bytes=5_000))
    assert len(blocks) > 3 and sum(len(b[-1]) for b in blocks) < sum(map(len, ids))
    back = list(token_files.frames_of([(b[0], b[4], b[5], b[6], b[8], b[9], b[11]) for b in blocks], raw))
    assert [f[3].astype("<u2").tobytes() for f in back] == ids
    with pytest.raises(ValueError):
        list(token_files.frames_of([(0, "another", 2, 0, [1], [0, 1], b"x")], raw))


def test_added_tokens_are_the_library_s(library):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y z", "<|endoftext |> no", prose(30) + " <|endoftext|>\n" + prose(30, 1)]
    got = token_files.WordIds(JSON).serialised(texts)
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_words_are_forgotten_without_harm(library):
    texts = [prose(40, k) for k in range(60)]
    small = token_files.WordIds(JSON, held=50)
    got = [small.serialised(texts[k : k + 7]) for k in range(0, 60, 7)]
    assert [np.frombuffer(b, "<u2").tolist() for g in got for b in g] == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_byte_bpe_is_the_library_s(spark, ranks):
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = odd_documents()
    df = wide(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect())
    listed = [(d, t or "", want.encode_ordinary(t or "")) for d, t in rows]
    assert got == sorted((str(d), len(ids), sha(",".join(map(str, ids))), sha(t)) for d, t, ids in listed)
    assert bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    coded = bpe.encode_documents(df.filter("doc_id = 10"), RANKS, public_tokenizers.PATTERN)
    assert bytes(bpe.decode_documents(coded, RANKS).first()["bytes"]).decode() == dict(rows)[10]


def test_segment_tree_merges_like_repeated_scans(ranks):
    def scans(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return tuple(ranks[p] for p in parts)
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(4)
    for _ in range(400):
        piece = bytes(rng.choice(b"abcdeeeth  \xc3\xa9\xe2\x80\x99") for _ in range(rng.randint(1, 40)))
        assert bpe.encode_piece(piece, ranks) == scans(piece)
    assert bpe.encode_piece(b"", ranks) == ()


def test_random_texts_encode_alike(ranks):
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode, decode = bpe.coder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(9)
    for _ in range(500):
        text = "".join(rng.choice("abéñ \n\t\x1c\x85　'st.,1\U0001f600\0") for _ in range(rng.randint(0, 50)))
        ids = encode(text)
        assert ids == want.encode_ordinary(text) and decode(ids).decode() == text
    assert regex.findall(public_tokenizers.PATTERN, "a b") == ["a", " b"]


HARD = ["<|im_end|>", "<|im_start|>", "\n", "<\\|im_end|>", "<\\\\|", "<|", "|>", "<", "\\", "<|nl|>", "x", "<|im_end|>\n"]


def test_every_turn_survives_its_grammar():
    rng = random.Random(2)
    for _ in range(3_000):
        role, text = ("".join(rng.choice(HARD) for _ in range(rng.randint(0, n))) for n in (2, 7))
        out, a, b = chat.render(role, text)
        assert [t[:2] for t in chat.parse(out)] == [(role, text)] and chat.unescape(out[a:b]) == text
        assert [t[:2] for t in chat.parse(out + chat.render("user", "hi")[0])] == [(role, text), ("user", "hi")]
    assert chat.parse("plain text") is None and chat.parse("") == []


def test_conversations_read_back(spark):
    rows = [(-1, k, r, PLANTED_TEXT) for k, r in enumerate(("user", "assistant"))]
    rows += [(1, 0, "system", None), (1, 1, "assistant", ""), (1, 2, None, "who"), (1, 2, "assistant", "tie b"), (1, 2, "assistant", "tie a"), (1, 2, "assistant", "tie a")]
    rows += [(2, k, ("user", "assistant")[k % 2], prose(20, k) + rng) for k, rng in enumerate(HARD * 30)]
    rows += [(None, None, "assistant", "no id"), (3, None, "user", "x" * 5_000), (3, -4, "assistant", "z" * 70_000)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode()))
    want = {}
    for conv in dict.fromkeys(r[0] for r in order):
        turns = [(r[2] or "", r[3] or "") for r in order if r[0] == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(chat.render(*t)[0]) for t in turns))
    df = wide(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4))
    formatted = chat.write_formatted(df, chunk_chars=200)
    assert formatted.filter("conv_id = 2").count() > 1
    got = {r[0]: tuple(r)[1:] for r in chat.read_digests(formatted).collect()}
    assert got == want
    assert chat.read_digests(chat.format_conversations(df.limit(0))).collect() == []


def test_ranks_file(ranks):
    with open(RANKS, "rb") as f:
        first = f.readline().split()
    assert ranks[base64.b64decode(first[0])] == int(first[1])
