"""Collocations against plain counts of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import CLASH, odd_documents
from pyspark.sql import functions as F

from twinside.llm import bloom, collocations


def documents():
    rng, rows = random.Random(11), [(d, t, "en") for d, t in odd_documents()]
    fixed = ["new york city", "in spite of", "as well as the", "Ha ha ha ha ha", "ça va bien"]
    for k in range(150):
        words = []
        while len(words) < 80:
            words += rng.choice(fixed).split() if rng.random() < 0.2 else [f"w{min(int(rng.paretovariate(0.8)), 60)}"]
            if rng.random() < 0.1:
                words[-1] += rng.choice(".,;:!?\n\r")
        rows.append((100 + k, rng.choice((" ", "\t", "  ")).join(words), ("en", "fr", None, "")[k % 4]))
    return rows + rows[-3:]


def plain(rows, least, top):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in held.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in held.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("least, top, part", [(30, 2000, 1_000_000), (4, 25, 100)])
def test_phrases(spark, monkeypatch, least, top, part):
    """Once in one go, once with many partial counts, texts cut at their pieces, and a short list."""
    monkeypatch.setattr(collocations, "PART", part)
    rows = documents()
    want = plain(rows, least, top)
    assert len(want) > 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least, top).collect())
    assert got == want
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_phrases_are_named_once(spark, monkeypatch):
    """However many tasks hold a frequent phrase, one text names it."""
    rows = [(d, " ".join(f"w{d % 3}x{k}" for k in range(40)), "en") for d in range(240)]
    docs, named, whole = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(8), [], collocations.spelled

    def spelled(*args):
        named.append(whole(*args).filter("size > 0").count())
        return whole(*args)

    monkeypatch.setattr(collocations, "spelled", spelled)
    found = collocations.frequent_phrases(docs).filter("size > 0").collect()
    assert len(found) == 3 * (40 + 39 + 38 + 37) and {r["n"] for r in found} == {80}
    assert named == [len(found)]


def test_scores_beyond_64_bits(spark):
    """2,000,000 a passes 64 bits for counts above 4.6 * 10 ** 12."""
    a, l, r = 9 * 10**18, 9 * 10**18, 9 * 10**18 - 1
    rows = spark.createDataFrame([(a, l, r)], "a bigint, l bigint, r bigint")
    assert rows.select(collocations.cut_score()).first()[0] == 2_000_000 * a // (l + r)


def test_local_supports_lose_nothing(spark):
    rows = documents()
    docs = spark.createDataFrame([(k % 7 << collocations.SHARD_BITS | k % 5, t) for k, (_, t, _) in enumerate(rows)], "tag bigint, text string")
    need = collocations.local_supports(collocations.tag_sizes(docs), 30)
    for cell in range(7):
        own = need[cell << collocations.SHARD_BITS : (cell << collocations.SHARD_BITS) + 5]
        assert sum(n - 1 for n in own) < 30 and all(1 <= n <= 30 for n in own)


def test_filter_loses_nothing(spark):
    keys = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 20_000)
    bits = bloom.built(spark.createDataFrame([(int(k),) for k in keys], "key bigint"), "key")
    others = np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 20_000)
    assert bloom.holds(bits, keys.view(np.uint64)).all() and bloom.holds(bits, others.view(np.uint64)).mean() < 0.001
    assert bloom.holds(bloom.built(spark.createDataFrame([], "key bigint"), "key"), keys.view(np.uint64)).sum() == 0
