"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from plain import CLASH, odd_documents
from pyspark.sql import functions as F

from twinside.llm import spelling


def edited(rng, word):
    k = rng.randrange(len(word))
    return (word[:k] + word[k + 1 :], word[:k] + rng.choice("abcé") + word[k:], word[:k] + rng.choice("abcé") + word[k + 1 :])[rng.randrange(3)]


def documents():
    rng, rows = random.Random(5), odd_documents()
    base = ["".join(rng.choices("abcdeé", k=rng.randrange(7, 12))) for _ in range(25)]
    for k in range(60):
        words = rng.choices(base, weights=[1 / (j + 1) ** 2 for j in range(25)], k=60) + [edited(rng, rng.choice(base)) for _ in range(25)]
        rows.append((100 + k, " ".join(words).upper() if k % 7 == 0 else "\t".join(words)))
    return rows + [(300, " ".join(["x" * 1_500, "x" * 1_499 + "y"] * 2))]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min(v, key=lambda x: (-words[x], x)) if v else None for w, v in near.items()}
    form = {w: f if f and words[f] >= 10 * words[w] else None for w, f in form.items()}
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def test_words_forms_and_roots(spark, monkeypatch):
    rows = documents()
    want = plain(rows)
    assert sum(v[0] is not None for v in want.values()) > 30 and max(v[3] for v in want.values()) > 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    for chunk in (2_048, 3):  # blocks of one chunk, and blocks cut into many
        monkeypatch.setattr(spelling, "CHUNK", chunk)
        got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_groups(docs).collect()}
        assert got == want
    assert spelling.spelling_groups(docs.limit(0)).collect() == []
    assert spelling.spelling_groups(docs.filter("doc_id IN (2, 3, 4)")).collect() == []


def test_strips_of_a_chunk_meet_once(monkeypatch):
    monkeypatch.setattr(spelling, "STRIP", 3)
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("ab", k=7)) for _ in range(40)})
    homes = [(w.encode(), 2) for w in words]
    got = sorted((a, b) for a, _, b in spelling.near_words(homes, homes, True))
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_long_words_keep_exact_distances():
    a = np.frombuffer(b"z" * 9_001, np.uint8).reshape(1, -1)
    b = a.copy()
    b[0, 4_000] = ord("y")
    assert [len(x) for x in spelling.near(a, b)] == [1, 1] and [len(x) for x in spelling.near(a, a)] == [0, 0]
