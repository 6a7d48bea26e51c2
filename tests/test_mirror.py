"""The other side's columns of a contest."""

from twinside.operators.features import PAIRED, contest_context, mirror, training_features
from twinside.plans.windows import METRICS, RECENT_TOTALS


def rows(spark):
    data = [(1, "H", 1.0, "x"), (1, "A", None, "y"), (2, "H", 2.0, None), (3, "A", 3.0, "z"), (3, "H", 4.0, None)]
    return spark.createDataFrame(data, "event_id bigint, venue string, a double, b string").repartition(3)


def test_other_row(spark):
    """A missing other row and a missing value are both null."""
    got = {(r["event_id"], r["venue"]): (r["opp_a"], r["opp_b"]) for r in mirror(rows(spark), ["a", "b"]).collect()}
    assert got == {(1, "H"): (None, "y"), (1, "A"): (1.0, "x"), (2, "H"): (None, None), (3, "A"): (4.0, None), (3, "H"): (3.0, "z")}


def test_context_moves_only_what_it_reads(spark):
    """No other history is computed, sorted or shuffled for a contest's context."""
    counts = [f"{p}_{m}" for m in METRICS for p in "ab"]
    fields = "event_id bigint, season string, event_date date, kickoff_time string, side_a string, side_b string, official string, a_score bigint, b_score bigint, "
    contests = spark.createDataFrame([], fields + ", ".join(f"{c} bigint" for c in counts if not c.endswith("_score")))
    context = contest_context(training_features(contests, METRICS, RECENT_TOTALS, opposite=PAIRED), METRICS)
    plan = context._jdf.queryExecution().optimizedPlan().toString()
    assert "position_before" in plan and "h2h" not in plan and "career" not in plan
