"""Registry of named queries and the shared oracle text.

Each query reads the given tables under ``root``.  The oracle is DuckDB SQL on
the same tables; ``CONTESTS`` holds its contest and side views.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from twinside.session import on_drop, settle

Query = Callable[[SparkSession, str], DataFrame]

CONTESTS = """
WITH per_order AS (
  SELECT l_orderkey,
    CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS a_score,
    CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS b_score,
    sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS a_qty,
    sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS b_qty,
    count(*) FILTER (l_linestatus = 'F') AS a_lines,
    count(*) FILTER (l_linestatus = 'O') AS b_lines,
    count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25) AS a_bulk,
    count(*) FILTER (l_linestatus = 'O' AND l_quantity > 25) AS b_bulk,
    min(l_suppkey) AS sk, min(l_partkey) AS pk
  FROM lineitem GROUP BY l_orderkey),
dated AS (
  SELECT *, CAST(o_orderdate AS DATE) AS event_date,
    CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS y0,
    (o_orderkey * 37) % 1440 AS mins
  FROM orders),
contests AS (
  SELECT o_orderkey AS event_id,
    CAST(y0 AS VARCHAR) || '-' || lpad(CAST((y0 + 1) % 100 AS VARCHAR), 2, '0') AS season, event_date,
    lpad(CAST(mins // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(mins % 60 AS VARCHAR), 2, '0') AS kickoff_time,
    na.n_name AS side_a, nb.n_name AS side_b,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN p_brand END AS official,
    a_score, b_score, a_qty, b_qty, a_lines, b_lines, a_bulk, b_bulk
  FROM dated JOIN per_order ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation na ON na.n_nationkey = c_nationkey
  JOIN supplier ON s_suppkey = sk JOIN nation nb ON nb.n_nationkey = s_nationkey
  LEFT JOIN part ON p_partkey = pk
  WHERE na.n_name <> nb.n_name),
both_sides AS (
  SELECT event_id, season, event_date, kickoff_time, official, side_a AS side, side_b AS opponent, 'H' AS venue,
    a_score AS score_for, b_score AS score_against, a_qty AS qty_for, b_qty AS qty_against,
    a_lines AS lines_for, b_lines AS lines_against, a_bulk AS bulk_for, b_bulk AS bulk_against FROM contests
  UNION ALL
  SELECT event_id, season, event_date, kickoff_time, official, side_b, side_a, 'A',
    b_score, a_score, b_qty, a_qty, b_lines, a_lines, b_bulk, a_bulk FROM contests),
sides AS (
  SELECT *, CASE WHEN score_for > score_against THEN 'W' WHEN score_for < score_against THEN 'L' ELSE 'D' END AS result,
    CAST(CASE WHEN score_for > score_against THEN 3 WHEN score_for < score_against THEN 0 ELSE 1 END AS BIGINT) AS points
  FROM both_sides),
officials AS (
  SELECT event_id, season, event_date, official, side_a, side_b, a_score, b_score, a_qty, b_qty, a_lines, b_lines, a_bulk, b_bulk,
    a_score + b_score AS total_score,
    CASE WHEN a_qty IS NOT NULL OR b_qty IS NOT NULL THEN coalesce(a_qty, 0) + coalesce(b_qty, 0) END AS total_qty,
    a_lines + b_lines AS total_lines, a_bulk + b_bulk AS total_bulk
  FROM contests WHERE official IS NOT NULL)
"""


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, oracle: str | None = None, raw: bool = False):
        """Register a query.  ``oracle`` continues the CONTESTS text (``SELECT ...`` or ``, x AS (...) SELECT ...``)."""

        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = lambda spark, root: comparable(fn(spark, root))
            if oracle is not None:
                self.oracles[name] = oracle if raw else CONTESTS + oracle
            return fn

        return register


_KEPT: dict[tuple, Any] = {}
on_drop(_KEPT.clear)


def version(spark: SparkSession, root: str) -> tuple:
    """Changes when files below a root do: their number, their size, and when the tables were last changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = files.getContentSummary(path)
    return whole.getFileCount(), whole.getLength(), *sorted(f.getModificationTime() for f in files.listStatus(path))


def kept(spark: SparkSession, root: str, label: str, build: Callable[[], Any]) -> Any:
    """What several queries of an application use: built once for each state of a root's files, and again when the work was dropped."""
    key = (spark.sparkContext.applicationId, root, version(spark, root), label)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def shared(spark: SparkSession, root: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of an application read: built and written once for each root."""
    return kept(spark, root, label, lambda: settle(build(), label))


registry = Registry()
query = registry.query


def rounded(x: Column, scale: float = 1e6) -> Column:
    """Round half away from zero in double arithmetic, as the oracle engine does.

    Spark's own ``round`` works on the decimal text, which differs for means
    whose text ends exactly on a five.
    """
    y = x * scale
    whole = F.rint(y)
    return F.when(F.abs(y - whole) == 0.5, y + F.signum(y) * 0.5).otherwise(whole) / scale


def comparable(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and doubles to six places, as every oracle states them."""

    def fix(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return rounded(c.cast("double")).alias(f.name)
        return c

    return df.select(*[fix(f) for f in df.schema.fields])


def r6(*names: str) -> str:
    """SQL list of ``round(x, 6) AS x``."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def avgs(columns: Sequence[str], suffix: str = "avg", over: str = "", prefix: str = "") -> str:
    return ", ".join(f"round(avg({c}){over}, 6) AS {prefix}{c}_{suffix}" for c in columns)
