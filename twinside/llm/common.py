"""Helpers shared by the corpus operators: table reading and row functions over Arrow batches.

The operators name the columns they read and select only those, so further
columns of any name cannot clash with theirs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}
#: Rows are turned into Python values, and handed back, in pieces of about so many characters or rows.
PIECE_CHARS, PIECE_ROWS = 4_000_000, 2_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (part.split(" ", 1) for part in ddl.split(", "))])


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch as Python values, a few at a time: a batch may hold many long texts."""
    for start in range(0, batch.num_rows, 256):
        yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns))


def weight(row: tuple) -> int:
    return sum(len(v) if isinstance(v, (str, bytes)) else 8 * len(v) if isinstance(v, list) else 8 for v in row)


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= PIECE_CHARS or len(held) >= PIECE_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def map_rows(df: DataFrame, start: Callable[[], Callable[..., tuple]], ddl: str) -> DataFrame:
    """One output row for each input row. ``start()`` runs once per task and returns the row function."""
    schema = arrow_schema(ddl)

    def run(batches):
        row = start()
        yield from batches_of((row(*values) for batch in batches for values in rows_of(batch)), schema)

    return df.mapInArrow(run, ddl)


def map_partition(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str) -> DataFrame:
    """``rows`` maps the iterator of a partition's rows to an iterator of output rows."""
    schema = arrow_schema(ddl)

    def run(batches):
        yield from batches_of(rows(values for batch in batches for values in rows_of(batch)), schema)

    return df.mapInArrow(run, ddl)


def shipped(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file (about a megabyte) to every node, also to executors that come later; its name there."""
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


#: White space other than blanks and line breaks.
OTHER_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
BEFORE_BLANK = re.compile(r"(?<=\S)(?= \S)")


def even_lines(text: str) -> list[list[str]] | None:
    """The words of each line, if single blanks and line breaks are the only white space of the text; else None.

    No pattern of the byte-level vocabularies joins what stands before a single
    blank or line break with what follows, and a blank goes with the word after
    it, so the words can be encoded apart: the first of a line as it is, the
    others with a blank, and each line break alone.
    """
    if any(c in text for c in OTHER_SPACE):
        return None
    lines = [line.split(" ") for line in text.split("\n")]
    return None if any("" in words for words in lines) else lines
