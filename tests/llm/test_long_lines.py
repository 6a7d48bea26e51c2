"""Clean long lines that mention a boilerplate phrase or hold a few separators stay whole."""

import corpus_pipeline
from plain import DOCS, prose

from twinside.llm import quality


def test_long_clean_lines_are_kept(spark):
    one = prose(80, 1).replace("\n", " ")
    phrase = one + " It changed its Privacy Policy and the terms of use in spring. " + prose(60, 2).replace("\n", " ")
    bars = one + " a | b | c | d " + prose(60, 3).replace("\n", " ")
    lines = prose(60, 4) + "\nPrivacy policy | Terms of use\nhome | news | sport | more"
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate((phrase, bars, lines, "Read the privacy policy. " * 3 + "All rights reserved."))]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {0: phrase, 1: bars, 2: prose(60, 4)}
    found = {r["doc_id"]: (r["kept"], r["lost_chars"]) for r in quality.quality_verdicts(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[0] == found[1] == (True, 0) and found[2][0] and not found[3][0]
