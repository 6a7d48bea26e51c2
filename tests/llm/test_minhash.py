"""Near copies by tensored bands against all pairs."""

import random

from plain import CLASH, joined, odd_documents, prose
from pyspark.sql import functions as F

from twinside.llm import minhash


def shingles(text, size):
    words = [w for w in (text or "").encode().lower().split()]
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def alike(a, b):
    return bool(a) and 100 * len(a & b) >= 80 * len(a | b)


def plain(rows, size):
    held = {}
    for d, t in rows:
        if d is not None:
            held.setdefault(d, []).append(shingles(t, size))
    named = joined(held, lambda a, b: any(alike(x, y) for x in held[a] for y in held[b]))
    return sorted(((d, len(shingles(t, size)), named.get(d)) for d, t in rows), key=str)


def copies(rng, n, words, most):
    """Copies of one text and of its copies, some near the similarity that decides; and texts that share a long passage."""
    out, base = [], [f"b{rng.randrange(10**6)}" for _ in range(words)]
    for k in range(n):
        own = list(base) if k % 3 else list(rng.choice(out)[1].split()) if out else list(base)
        for _ in range(rng.randrange(most)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        if k % 10 == 9:
            own = own[: len(own) // 2] + [f"o{rng.randrange(10**6)}" for _ in range(words // 2)]
        out.append((1000 + k, " ".join(own)))
    return out


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({k: F.lit(v) for k, v in CLASH.items() if k != "text"})


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_components_and_odd_rows(spark):
    rng = random.Random(4)
    rows = odd_documents() + copies(rng, 120, 90, 8) + [(k, prose(60, k)) for k in range(2000, 2030)]
    want = plain(rows, 4)
    assert len({c for _, _, c in want}) < len(rows) - 30
    assert found(minhash.near_components(rows_of(spark, rows), 4)) == want
    assert minhash.near_components(rows_of(spark, rows).limit(0)).collect() == []


def test_buckets_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", 10)
    rows = copies(random.Random(8), 80, 120, 12)
    assert found(minhash.near_components(rows_of(spark, rows), 4)) == plain(rows, 4)


def test_edits_of_every_kind_are_found(spark):
    """Parts appended, cut or replaced, and scattered words, all barely at the similarity: recall over 400 pairs."""
    rng, rows, pairs = random.Random(2), [], 0
    for k in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        new = [f"n{rng.randrange(10**9)}" for _ in range(40)]
        near = (words + new, words[:168], words[:80] + new[:16] + words[96:], [w if i % 38 else new[i // 38] for i, w in enumerate(words)])[k % 4]
        pairs += alike(shingles(" ".join(words), 4), shingles(" ".join(near), 4))
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(near))]
    assert pairs == 400
    got = found(minhash.near_components(rows_of(spark, rows), 4))
    assert sum(d != c for d, _, c in got) >= 399


def test_large_group_of_copies(spark):
    """Two thousand copies, a third of them copies of copies."""
    rows = copies(random.Random(9), 2_000, 100, 6)
    sets = {d: shingles(t, 4) for d, t in rows}
    got = {d: c for d, _, c in found(minhash.near_components(rows_of(spark, rows), 4))}
    by_shingle, parent = {}, {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        near = set().union(*(by_shingle.get(x, set()) for x in s))
        for o in near:
            if top(o) != top(d) and alike(sets[o], s):
                a, b = sorted((top(o), top(d)))
                parent[b] = a
        for x in s:
            by_shingle.setdefault(x, set()).add(d)
    assert got == {d: top(d) for d in sets}
