"""Table reads and writes: season replace, upsert, exports and run log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from twinside.operators.quality import assert_empty, schedule_violations
from twinside.sources.feeds import keep_last


def export_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per table; CSV export is a format choice."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(fmt).save(f"{path}/{name}")


def read_schedule(spark: SparkSession, path: str, schema: T.StructType | str, rounds: int = 38, per_round: int = 10, sides: int = 20) -> DataFrame:
    """A stored schedule, validated anew on every read: any season that breaks a rule raises."""
    rows = spark.read.schema(schema).parquet(path)
    assert_empty(schedule_violations(rows, rounds, per_round, sides).filter(F.size("violations") > 0), "schedule")
    return rows


def replace_seasons(df: DataFrame, path: str) -> None:
    """Replace only the seasons present in ``df``; repeating the call changes nothing."""
    df.write.mode("overwrite").partitionBy("season").option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a table together with its schema."""
    df.write.mode("overwrite").parquet(path)


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Stored and incoming rows, newest ``order`` per key; incoming wins a tie."""
    tagged = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(tagged, keys, ["_new", order]).drop("_new")


def read_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fixed columns in fixed order; a column the stored table lacks is null."""
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored ledger, or an empty one with the contract schema when none exists yet."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return read_contract(stored, schema)


def training_rows(features: DataFrame, target: str) -> DataFrame:
    return features.filter(F.col(target).isNotNull())


def source_log(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: name and row count."""
    rows = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count")) for name, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
