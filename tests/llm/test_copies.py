"""Near-duplicates, decontamination and the pipeline against plain versions."""

import random

import corpus_pipeline
import numpy as np
import pytest
from plain import CLASH, DOCS, fingerprint, joined, leaks, odd_documents, prose
from pyspark.sql import functions as F

from twinside.llm import decontaminate, simhash
from twinside.llm.components import components
from twinside.session import settle


def wide(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def edited(text, rng, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_of_documents(spark):
    rng = random.Random(1)
    rows = odd_documents() + [(100 + k, edited(prose(300, k % 5), rng, k % 3)) for k in range(60)]
    got = simhash.near_components(wide(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    prints = {}
    for d, t in rows:
        if d is not None:
            prints.setdefault(d, []).append(fingerprint(t))
    want = joined(prints, lambda a, b: any((x ^ y).bit_count() <= 2 for x in prints[a] for y in prints[b]))
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert sorted((str(r["doc_id"]), r["f0"] % (1 << 64)) for r in got) == sorted((str(d), fingerprint(t)) for d, t in rows)
    assert {r["component_id"] for r in got if r["doc_id"] is None and r["f0"] == 0} == {want[2]}
    assert simhash.near_components(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("spec", [simhash.Spec(), simhash.WORD_SETS], ids=["contract", "pipeline"])
def test_links_of_crowded_fingerprints(spark, spec):
    """A third of the fingerprints are near copies of one; heavy buckets go another, exact way."""
    rng = np.random.default_rng(0)
    n = 900
    base = rng.integers(0, 1 << 63, size=(n // 4, spec.size), dtype=np.uint64)
    prints = base[rng.integers(0, n // 4, n)]
    prints[: n // 3] = base[0]
    for k in range(n):
        for b in rng.integers(0, spec.bits, rng.integers(0, 3 if spec.size == 1 else 14)):
            prints[k, b // 64] ^= np.uint64(1 << int(b % 64))
    prints = np.unique(prints, axis=0)
    ids = [int(x) for x in rng.permutation(len(prints))]
    rows = [(i, *map(int, p.view(np.int64))) for i, p in zip(ids, prints)]
    df = settle(spark.createDataFrame(rows, "node bigint, " + ", ".join(f"{c} bigint" for c in spec.columns)), "prints")
    at = dict(zip(ids, prints))
    want = joined(sorted(at), lambda a, b: int(np.bitwise_count(at[a] ^ at[b]).sum()) <= spec.radius)
    for heavy in (simhash.HEAVY, 40):
        got = {r["node"]: r["component"] for r in components(simhash.near_links(df, spec, heavy)).collect()}
        assert {i: got.get(i, i) for i in ids} == want


def test_thresholds_cover_the_radius():
    parts = simhash.group_bits(np.eye(64), 5)
    assert sorted(b for p in parts for b in p) == list(range(64))
    for radius in (2, 5, 9):
        _, taken = simhash.thresholds(parts, radius, 10**6, 10**6, [[10, 100]] * 5)
        assert sum(t + 1 for t in taken) >= radius + 1
    crowded = [[900_000, 950_000], [1, 100], [1, 100], [1, 100], [1, 100]]
    assert simhash.thresholds(parts, 2, 10**6, 10**6, crowded)[1][0] == -1  # values that most share are not probed


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1001)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).collect() == []


def benchmark_items():
    return [(k, prose(20 + k, 100 + k)) for k in range(12)] + [(50, ""), (51, None), (52, "only three words"), (None, prose(30, 999)), (3, prose(23, 103))]


def planted(rng, items):
    rows = odd_documents()
    for k in range(120):
        words = rng.choice(items[:12])[1].split()
        kind = k % 6
        if kind == 1:
            words[rng.randrange(len(words))] = "zzz"
        elif kind == 2:
            words = words[: int(len(words) * 0.88)]
        elif kind == 3:
            words = words[int(len(words) * 0.12) :]
        elif kind == 4:
            words.insert(rng.randrange(len(words)), "qqq")
        elif kind == 5:
            words[rng.randrange(len(words))], words[rng.randrange(len(words))] = "yyy", "xxx"
        rows.append((1000 + k, prose(rng.choice((0, 40, 200)), k) + "\n" + " ".join(words).upper() + "! " + prose(rng.choice((0, 30)), k + 500)))
    return rows


def test_leaks(spark):
    rng, items = random.Random(3), benchmark_items()
    rows = planted(rng, items) + [(2000, "\n".join(t for _, t in items[:12]))]
    docs, bench = wide(spark.createDataFrame(rows, "doc_id bigint, text string")), wide(spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in decontaminate.leaks(docs, bench).collect()}
    want = leaks(rows, items)
    assert got == want and sum(d >= 1000 for d, _ in got) > 60
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == [] and decontaminate.leaks(docs.limit(0), bench).collect() == []


def test_leaks_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_SHINGLES", 10)
    items = benchmark_items()[:5]
    rows = planted(random.Random(4), benchmark_items())[:40]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(leaks(rows, items))


def test_pipeline_stages(spark, tmp_path):
    """Copies, leaks, junk and secrets are dealt with; clean documents stay as they are."""
    rng = random.Random(6)
    items = [(k, prose(30, 700 + k).replace("\n", " ")) for k in range(8)]
    clean = [(k, prose(150, 10_000 + k)) for k in range(40)]
    exact = [(100 + k, clean[k][1]) for k in range(10)]
    near = [(200 + k, edited(clean[10 + k][1], rng, 2)) for k in range(10)]
    leaked = [(300 + k, clean[k][1] + "\n" + prose(100, 20_000 + k) + "\n" + items[k][1]) for k in range(8)]
    junk = [(400, "a b c"), (401, None), (402, ""), (403, " ".join(f"{w}###" for w in prose(90).split()))]
    secret = [(500, prose(120, 31_000) + '\ntoken = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"')]
    rows = [(d, t, "en", "src0", len(t or "")) for d, t in clean + exact + near + leaked + junk + secret] + [(500, secret[0][1], "en", "src0", 1), (None, prose(60, 5), None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.schema(DOCS).parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, str(tmp_path)), name)
        ids[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect() if r["doc_id"] is not None)
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "secret_scan":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = [d for d, _ in clean]
    assert ids["quality_rules"] == sorted([d for d, *_ in rows if d is not None and not 400 <= d < 500])
    assert ids["simhash_near_dedup"] == sorted(good + [300 + k for k in range(8)] + [500])
    assert ids["benchmark_decontamination"] == ids["secret_scan"] == ids["byte_bpe"] == sorted(good + [500])
    assert all(texts[d] == t for d, t in clean) and "f3ef4d6b" not in texts[500] and '"<SECRET>"' in texts[500]
    assert docs.filter("doc_id IS NULL").count() == 1
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
