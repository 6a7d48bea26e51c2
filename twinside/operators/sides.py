"""Contest rows to side rows, official rows and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from twinside.functions.numbers import null_safe_sum, outcome, outcome_points

IDENTITY = ("event_id", "season", "event_date", "kickoff_time", "side", "opponent", "venue", "official")


def for_against(metrics: Sequence[str]) -> list[str]:
    return [f"{m}_{d}" for m in metrics for d in ("for", "against")]


def side_rows(contests: DataFrame, metrics: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Two reciprocal rows per contest from one scan, with result and points."""

    def view(own: str, other: str, venue: str) -> str:
        fields = [f"side_{own} AS side", f"side_{other} AS opponent", f"'{venue}' AS venue"]
        fields += [f"{s}_{m} AS {m}_{d}" for m in metrics for s, d in ((own, "for"), (other, "against"))]
        return f"struct({', '.join(fields)})"

    fixed = ["event_id", "season", "event_date", "kickoff_time", "official", *keep]
    rows = contests.selectExpr(*fixed, f"explode(array({view('a', 'b', 'H')}, {view('b', 'a', 'A')})) AS v").select(*fixed, "v.*")
    own, other = F.col("score_for"), F.col("score_against")
    return rows.select("*", outcome(own, other).alias("result"), outcome_points(own, other).alias("points"))


def official_rows(contests: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per contest that has an official, with both sides and their total."""
    return contests.filter("official IS NOT NULL").select(
        "event_id",
        "season",
        "event_date",
        "official",
        "side_a",
        "side_b",
        *[c for m in metrics for c in (f"a_{m}", f"b_{m}")],
        *[null_safe_sum(F.col(f"a_{m}"), F.col(f"b_{m}")).alias(f"total_{m}") for m in metrics],
    )


def tall_metrics(df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str, value: str) -> DataFrame:
    """Wide numeric columns to (key, value) rows; nulls are dropped."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(ids), list(columns), key, value).filter(F.col(value).isNotNull())


def contest_pivot(sides: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Side rows back to one row per contest by conditional maximum."""
    return sides.groupBy("event_id").agg(
        *[
            F.max(F.when(F.col("venue") == v, F.col(f"{m}_for"))).alias(f"{p}_{m}")
            for m in metrics
            for v, p in (("H", "a"), ("A", "b"))
        ]
    )


def complete_totals(sides: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Contest totals that need both sides; one missing side gives null."""
    return sides.groupBy("event_id").agg(
        *[F.when(F.count(f"{m}_for") == 2, F.sum(f"{m}_for")).alias(f"total_{m}") for m in metrics]
    )
