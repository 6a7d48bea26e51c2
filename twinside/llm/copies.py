"""Near copies by the similarity of their five-word shingles: the pipeline's near-duplicate stage.

SimHash fingerprints of the sets of shingles propose first, by the partitions of
operator 10. A similarity of 0.8 moves about 10 of 64 bits, so pairs near it lie
beyond any radius whose partitions still tell texts apart; what SimHash leaves
is proposed by the tensored bands of operator 12. Whole sets decide about every
link, whoever proposed it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from twinside.llm import minhash, simhash
from twinside.llm.bloom import mixed  # noqa: F401 (the estimates are tested with it)

SHINGLE = 5
MIX = minhash.MIX
#: Bands of both collections together.
BANDS = 2 * minhash.BANDS
#: Fingerprints of the sets link at up to so many bits; beyond, buckets of ever more unrelated texts would have to be compared.
SPEC = simhash.Spec(shingle=SHINGLE, distinct=True, radius=8)
#: Larger buckets are cut into slices that meet pairwise.
SMALL = minhash.CROWD


def sketch(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """Band values, each different from those of other bands, and the last byte of every MinHash value."""
    first, second, marks = minhash.bands(hashes)
    return first + second, marks


def set_fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the shingles' hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), simhash.HASHES):
        counts += simhash.bit_columns(hashes[at : at + simhash.HASHES, None]).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprint_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) proposed by fingerprints within the radius and confirmed on whole sets."""
    named = classes.filter("n > 0").select("node", "f0")
    prints = named.groupBy("f0").agg(F.min("node").alias("first"))
    same = named.join(prints, "f0").filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    near = simhash.near_links(prints.select(F.col("first").alias("node"), "f0"), SPEC)
    pairs = same.unionByName(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).filter("u <> v").distinct()
    return minhash.linked(docs, classes, pairs, SHINGLE)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every different id: the smallest doc_id reachable over links, itself included.

    Equal sets of shingles are one node, named by its smallest id; texts without
    words have the empty set. Texts of any length are read whole, one at a time.
    Rows of one repeated id count as one document, rows without an id are left
    out. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    found = minhash.near_components(docs, SHINGLE, empty_alike=True, fingerprint=set_fingerprint, links=fingerprint_links, crowd=SMALL)
    return found.filter("doc_id IS NOT NULL").select("doc_id", "component_id").distinct()
