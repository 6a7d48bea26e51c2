"""A Bloom filter of fixed size over 64-bit hashes, built by tasks and shipped to tasks.

It never misses a hash that was put in. Beyond its capacity it lets more others
through, so callers use it only to skip work and decide exactly afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinside.llm.common import arrow_schema

#: 2 ** BITS bits in all (8 MB), cut into SEGMENTS parts; bits set for each hash.
BITS, SEGMENTS, PROBES = 26, 16, 4
SEGMENT_BITS = BITS - 4


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def places(h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Segment of each hash and its bits there."""
    m = mixed(h)
    again = mixed(m + np.uint64(1))
    inside = np.uint64((1 << SEGMENT_BITS) - 1)
    return m >> np.uint64(60), [(m + again * np.uint64(k)) & inside for k in range(PROBES)]


def built(keys: DataFrame, column: str) -> np.ndarray:
    """The filter of a bigint column: every task fills the segments dealt to it; the driver gets 8 MB, however many keys there are."""
    ddl = "segment bigint, bits binary"
    schema = arrow_schema(ddl)

    def fill(batches):
        held = {}
        for batch in batches:
            segment, bits = places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for s in np.unique(segment).tolist():
                own = held.setdefault(s, np.zeros(1 << (SEGMENT_BITS - 3), np.uint8))
                for b in bits:
                    at = b[segment == s]
                    np.bitwise_or.at(own, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        rows = sorted(held.items())
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([b.tobytes() for _, b in rows], pa.binary())], schema=schema)

    def merge(batches):
        held = {}
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(b.as_buffer(), np.uint8)
                held[s] = held[s] | own if s in held else own
        rows = sorted(held.items())
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([b.tobytes() for _, b in rows], pa.binary())], schema=schema)

    dealt = keys.select(F.col(column)).repartition(SEGMENTS, F.shiftrightunsigned(F.xxhash64(column), 60))
    parts = dealt.mapInArrow(fill, ddl).repartition(SEGMENTS, "segment").mapInArrow(merge, ddl).collect()
    out = np.zeros((SEGMENTS, 1 << (SEGMENT_BITS - 3)), np.uint8)
    for r in parts:
        out[r["segment"]] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may have been put in."""
    segment, at = places(h)
    flat, base = bits.reshape(-1), segment << np.uint64(SEGMENT_BITS - 3)
    out = np.ones(len(h), bool)
    for b in at:
        out &= (flat[base | (b >> np.uint64(3))] >> (b & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return out
