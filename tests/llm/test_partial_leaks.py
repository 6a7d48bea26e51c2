"""Windows that hold little more than 80 % of an item are found like by brute force."""

import random

import pytest
from plain import leaks, prose

from twinside.llm import decontaminate


@pytest.mark.parametrize("n", [30, 60, 200])
def test_partial_quotes(spark, n):
    rng = random.Random(n)
    items = [(k, prose(n, 5_000 + k)) for k in range(20)]
    rows = []
    for k in range(160):
        words, share = items[k % 20][1].split(), rng.uniform(0.78, 0.9)
        part = int(n * share)
        start = rng.choice((0, n - part))
        quoted = words[start : start + part]
        if k % 4 == 3:  # the middle is replaced
            quoted = words[: part // 2] + prose(n - part, 90_000 + k).split() + words[n - part + part // 2 :]
        rows.append((k, f"{prose(n, 70_000 + k)} {' '.join(quoted)} {prose(n, 80_000 + k)}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = leaks(rows, items)
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in got} == want and len(want) > 50
