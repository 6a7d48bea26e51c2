"""The contest view over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinside.session import settle

METRICS = ("score", "qty", "lines", "bulk")


# Stated schemas spare one footer job per table and query.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


def contests(spark: SparkSession, root: str) -> DataFrame:
    """One row per order whose customer and first supplier live in different nations.

    The line items are reduced per order first (combined on the map side), so
    the join with orders moves one row per order.  All joins are plain equi
    joins: the optimizer broadcasts a side only when its size is below the
    configured threshold, and adaptive execution splits skewed partitions.
    """
    names = ("orders", "lineitem", "customer", "supplier", "nation", "part")
    return spark.sql(CONTESTS, **{n: table(spark, root, n) for n in names})


def fact(spark: SparkSession, root: str) -> DataFrame:
    """Contests written once to the shared folder, for plans that read them several times."""
    return settle(contests(spark, root), "contests")


CONTESTS = """
SELECT o_orderkey AS event_id, format_string('%d-%02d', start_year, (start_year + 1) % 100) AS season, event_date,
  format_string('%02d:%02d', minutes div 60, minutes % 60) AS kickoff_time, a.n_name AS side_a, b.n_name AS side_b,
  IF(o_orderpriority <> '4-NOT SPECIFIED', p_brand, NULL) AS official,
  a_score, b_score, a_qty, b_qty, a_lines, b_lines, a_bulk, b_bulk
FROM (
  SELECT *, CAST(o_orderdate AS DATE) AS event_date, (o_orderkey * 37) % 1440 AS minutes,
    IF(month(o_orderdate) >= 7, year(o_orderdate), year(o_orderdate) - 1) AS start_year
  FROM {orders})
JOIN (
  SELECT l_orderkey,
    count_if(l_returnflag = 'A') AS a_score, count_if(l_returnflag = 'R') AS b_score,
    sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS a_qty, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS b_qty,
    count_if(l_linestatus = 'F') AS a_lines, count_if(l_linestatus = 'O') AS b_lines,
    count_if(l_linestatus = 'F' AND l_quantity > 25) AS a_bulk, count_if(l_linestatus = 'O' AND l_quantity > 25) AS b_bulk,
    min(l_suppkey) AS supplier_key, min(l_partkey) AS part_key
  FROM {lineitem} GROUP BY l_orderkey) ON o_orderkey = l_orderkey
JOIN {customer} ON c_custkey = o_custkey JOIN {nation} AS a ON a.n_nationkey = c_nationkey
JOIN {supplier} ON s_suppkey = supplier_key JOIN {nation} AS b ON b.n_nationkey = s_nationkey
LEFT JOIN {part} ON p_partkey = part_key
WHERE a.n_name <> b.n_name
"""
