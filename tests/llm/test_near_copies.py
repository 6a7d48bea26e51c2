"""The pipeline's near copies: five-word shingles decide, whatever the edit."""

import random

import corpus_pipeline
import numpy as np
from plain import DOCS, joined, odd_documents

from twinside.llm import copies


def draw(rng, n, vocabulary):
    return [f"v{min(int(rng.paretovariate(0.6)), vocabulary)}" if vocabulary else f"w{rng.randrange(10**9)}" for _ in range(n)]


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
    return sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect() if r["doc_id"] is not None)


def test_texts_over_one_vocabulary_stay(spark):
    """They share their words but no passage."""
    rng = random.Random(1)
    common = [f"v{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choices(common, weights=[1 / (j + 1) for j in range(300)], k=5_000))) for k in range(12)]
    sorted_words = sorted(rows[0][1].split())
    rows.append((50, " ".join(rng.sample(sorted_words, len(sorted_words)))))
    assert kept(spark, rows) == [d for d, _ in rows]


def test_contiguous_edits_are_copies(spark):
    """A part appended, cut off or replaced, and the same text with too much of it."""
    rng, rows, gone = random.Random(2), [], set()
    for k in range(60):
        words = draw(rng, 200, 0)
        near = (words + draw(rng, 40, 0), words[:168], words[:80] + draw(rng, 16, 0) + words[96:])[k % 3]
        far = (words + draw(rng, 90, 0), words[:120], words[:80] + draw(rng, 60, 0) + words[140:])[k % 3]
        assert alike(shingles(" ".join(words)), shingles(" ".join(near))) and not alike(shingles(" ".join(words)), shingles(" ".join(far)))
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(near)), (10 * k + 2, " ".join(far))]
        gone.add(10 * k + 1)
    assert kept(spark, rows) == sorted(d for d, _ in rows if d not in gone)


def test_components_of_crowded_groups(spark, monkeypatch):
    """Copies of copies, and large buckets, connect what all pairs connect."""
    rng, rows = random.Random(3), odd_documents()
    base = draw(rng, 120, 0)
    for k in range(90):
        words = list(base) if k % 3 else list(rows[-1][1].split()) if k else list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(words)))
    held = {}
    for d, t in rows:
        if d is not None:
            held.setdefault(d, []).append(shingles(t))
    want = joined(held, lambda a, b: any(alike(x, y) for x in held[a] for y in held[b]))
    for small in (48, 6):
        monkeypatch.setattr(copies, "SMALL", small)
        got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert got == want
    assert copies.near_copies(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_estimates_of_minhash():
    a = np.arange(4_000, dtype=np.uint64)
    one, two = (np.unique(copies.mixed(x * copies.MIX)) for x in (a[:3_600], a[400:]))
    (b1, s1), (b2, s2) = copies.sketch(one), copies.sketch(two)
    assert abs(np.mean(np.frombuffer(s1, np.uint8) == np.frombuffer(s2, np.uint8)) - 0.8) < 0.13 and set(b1) & set(b2)
    assert len(set(b1)) == copies.BANDS
