"""Integrity gates.  Each returns violations or a verdict row; nothing is collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from twinside.functions.calendar import local_to_utc, wall_time_problem
from twinside.functions.numbers import finite_from_zero
from twinside.functions.text import canonical_name, is_appointable, is_blank, is_person, person_name
from twinside.operators.joins import without_repeated


def require_columns(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{label}: missing columns {missing}")
    return df


def assert_empty(violations: DataFrame, label: str) -> None:
    """Raise with one example when a violations frame has rows."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{label}: {first[0].asDict()}")


def blank_identities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank count of each identity column, one row per column."""
    counts = df.agg(*[F.count_if(is_blank(F.col(c).cast("string"))).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "blanks")


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: sizes of both differences and whether the frames hold the same rows (with copies)."""
    missing = left.exceptAll(right).agg(F.count("*").alias("only_left"))
    extra = right.exceptAll(left).agg(F.count("*")).scalar()
    return missing.withColumn("only_right", extra).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def subset_gap(part: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``part`` that ``whole`` lacks."""
    return part.select(*keys).distinct().join(whole.select(*keys), list(keys), "left_anti")


def schedule_violations(schedule: DataFrame, rounds: int = 38, per_round: int = 10, sides: int = 20) -> DataFrame:
    """Broken rules of each season's schedule: size, unique pairs, rounds and sides."""
    pairs = schedule.groupBy("season", "side_a", "side_b").agg(F.count("*").alias("n")).groupBy("season").agg(
        F.sum("n").alias("fixtures"), F.max("n").alias("copies")
    )
    by_round = schedule.groupBy("season", "match_round").agg(F.count("*").alias("n")).groupBy("season").agg(
        F.count("*").alias("rounds"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        F.bool_and(F.col("match_round").between(1, rounds)).alias("in_range"),
    )
    entrants = (
        schedule.select("season", F.explode(F.array("side_a", "side_b")).alias("side")).distinct().groupBy("season").agg(F.count("*").alias("sides"))
    )
    rules = {
        "fixture count": F.col("fixtures") != rounds * per_round,
        "repeated pair": F.col("copies") > 1,
        "round sizes": (F.col("rounds") != rounds) | (F.col("smallest") != per_round) | (F.col("largest") != per_round),
        "side count": F.col("sides") != sides,
        "round out of range": ~F.coalesce("in_range", F.lit(False)),
    }
    return pairs.join(by_round, "season").join(entrants, "season").select(
        "season", "fixtures", F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()])).alias("violations")
    )


def pair_verdicts(sides: DataFrame, shared: Sequence[tuple[str, str]] = (), unique_pairing: bool = False) -> DataFrame:
    """One row per event with the first reason to reject it, or null.

    Wants exactly one H and one A row with mirrored identities and equal
    shared metrics (``shared`` pairs a metric with its mirror).  With
    ``unique_pairing`` a season may hold each pairing once per venue.
    """
    cols = list(dict.fromkeys(["season", "event_date", "side", "opponent", *[c for p in shared for c in p]]))
    row = lambda v: F.max(F.when(F.col("venue") == v, F.struct(*cols)))
    pairs = sides.groupBy("event_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("venue") == "H").alias("_h"), F.count_if(F.col("venue") == "A").alias("_a"),
        row("H").alias("h"), row("A").alias("a"),
    )

    def differs(x: str, y: str) -> Column:
        u, v = finite_from_zero(F.col(x)), finite_from_zero(F.col(y))
        return F.coalesce(u != v, F.lit(False))

    conflicts = [differs(f"{p}.{m}", f"{q}.{o}") for m, o in shared for p, q in (("h", "a"), ("a", "h"))]
    conflict = reduce(lambda x, y: x | y, conflicts, F.lit(False))
    reason = (
        F.when((F.col("_n") != 2) | (F.col("_h") != 1) | (F.col("_a") != 1), "not one H and one A row")
        .when(F.expr("NOT coalesce(h.side = a.opponent AND a.side = h.opponent AND h.side <> a.side, false)"), "identities do not mirror")
        .when(F.expr("NOT coalesce(h.event_date = a.event_date AND h.season = a.season, false)"), "date or season differs")
        .when(conflict, "shared metrics differ")
    )
    verdict = pairs.select("event_id", reason.alias("reason"))
    if unique_pairing:
        # An ambiguous row of either venue rejects its whole event.
        counts = sides.groupBy("season", "side", "opponent", "venue").count().filter("count > 1")
        ambiguous = sides.join(counts, ["season", "side", "opponent", "venue"], "left_semi").select("event_id").distinct()
        verdict = verdict.join(ambiguous.withColumn("_twice", F.lit(True)), "event_id", "left").select(
            "event_id", F.when(F.col("_twice"), "pairing repeats in the season").otherwise(F.col("reason")).alias("reason")
        )
    return verdict


def current_state(sides: DataFrame, schedule: DataFrame, expected_sides: int = 20) -> DataFrame:
    """Verdict of the newest season: side count, sides outside the schedule, repeated fixtures."""
    season = sides.agg(F.max("season")).scalar()
    home = sides.filter((F.col("season") == season) & (F.col("venue") == "H"))
    scheduled = schedule.filter(F.col("season") == season).select(F.explode(F.array("side_a", "side_b")).alias("side")).distinct()
    repeated = home.groupBy("side", "opponent").count().filter("count > 1").agg(F.count("*")).scalar()
    outside = home.select("side").distinct().join(scheduled, "side", "left_anti").agg(F.count("*")).scalar()
    return scheduled.agg(F.count("*").alias("scheduled_sides")).withColumns({"sides_outside": outside, "repeated_fixtures": repeated}).withColumn(
        "ok", (F.col("scheduled_sides") == expected_sides) & (F.col("sides_outside") == 0) & (F.col("repeated_fixtures") == 0)
    )


def snapshot_gate(
    round_fixtures: DataFrame, archive: DataFrame, appointments: DataFrame, now: Column, zone: str, expected: int = 10
) -> DataFrame:
    """One row per (season, match_round): null reason when the round may be archived, else the first failed rule.

    ``round_fixtures`` has season, match_round, side_a, side_b, event_date,
    kickoff_time and played.  Every rule is an aggregate of its own input.
    """
    keys = ["season", "match_round"]
    local = F.concat(F.col("event_date").cast("string"), F.lit(" "), F.col("kickoff_time")).try_cast("timestamp_ntz")
    pairs = round_fixtures.groupBy(*keys, "side_a", "side_b").agg(
        F.count("*").alias("n"),
        F.bool_or("played").alias("played"),
        F.min(local_to_utc(local, zone)).alias("kickoff"),
        F.count_if(local.isNull() | wall_time_problem(local, zone).isNotNull()).alias("bad_times"),
    )
    appointed = appointments.groupBy(*keys, "side_a", "side_b").agg(F.count("*").alias("k"), F.min("official").alias("official"))
    rows_in_round = appointments.groupBy(*keys).agg(F.count("*").alias("appointment_rows"))
    identity_ok = ~is_blank(F.col("side_a")) & ~is_blank(F.col("side_b")) & (F.col("side_a") != F.col("side_b"))
    rounds = pairs.join(appointed, [*keys, "side_a", "side_b"], "left").groupBy(*keys).agg(
        F.sum("n").alias("fixtures"),
        F.count("*").alias("pairs"),
        F.count_if(~F.coalesce(identity_ok, F.lit(False))).alias("bad_identities"),
        F.sum("bad_times").alias("bad_times"),
        F.bool_or("played").alias("played"),
        F.min("kickoff").alias("first_kickoff"),
        F.count_if((F.col("k") == 1) & is_person(F.col("official"))).alias("appointed"),
    )
    archived = archive.groupBy(*keys).agg(F.count("*").alias("archived_rows"))
    reason = (
        F.when((F.col("fixtures") != expected) | (F.col("pairs") != expected) | (F.col("bad_identities") > 0), "invalid fixture identities")
        .when(F.coalesce("archived_rows", F.lit(0)) > 0, "round already archived")
        .when(F.col("bad_times") > 0, "kickoff cannot be verified")
        .when(F.col("played") | (now >= F.col("first_kickoff")), "kickoff reached or already played")
        .when((F.col("appointed") != expected) | (F.coalesce("appointment_rows", F.lit(0)) != expected), "officials incomplete")
    )
    return rounds.join(archived, keys, "left").join(rows_in_round, keys, "left").select(*keys, "fixtures", "appointed", reason.alias("reason"))


def valid_appointments(rows: DataFrame, fixtures: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Appointments of expected fixtures, named properly, and not repeated (all copies go)."""
    clean = rows.withColumns(
        {"side_a": canonical_name(F.col("side_a"), names), "side_b": canonical_name(F.col("side_b"), names), "official": person_name(F.col("official"))}
    )
    keys = ["season", "match_round", "side_a", "side_b"]
    single = without_repeated(clean, keys)
    return single.filter(is_appointable(F.col("official"))).join(fixtures.select(*keys), keys, "left_semi")


def merge_appointments(live: DataFrame, verified: DataFrame, cache: DataFrame) -> DataFrame:
    """Precedence merge by fixture: the cache stays, live fills, verified fills last; conflicts are flagged.

    A season's round with any conflict keeps its cache unchanged (``kept``).
    """
    keys = ["season", "match_round", "side_a", "side_b"]
    pick = lambda df, name: df.select(*keys, F.col("official").alias(name))
    merged = pick(live, "live").join(pick(verified, "verified"), keys, "full").join(pick(cache, "cached"), keys, "full")
    incoming = F.coalesce("live", "verified")
    clash = F.coalesce(F.col("live") != F.col("verified"), F.lit(False)) | F.coalesce(incoming != F.col("cached"), F.lit(False))
    judged = merged.withColumns({"conflict": clash, "official": F.coalesce(F.col("cached"), incoming)})
    bad_rounds = judged.groupBy("season", "match_round").agg(F.bool_or("conflict").alias("_frozen"))
    kept = ~F.col("_frozen") | F.col("cached").isNotNull()
    return judged.join(bad_rounds, ["season", "match_round"]).select(*keys, "official", "conflict", kept.alias("kept"))


def coverage(fixtures: DataFrame, found: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Expected and found counts per ``by`` value."""
    marks = found.select(*keys).distinct().withColumn("_found", F.lit(True))
    return fixtures.join(marks, list(keys), "left").groupBy(by).agg(
        F.count("*").alias("expected"), F.count("_found").alias("found"), F.count_if(F.col("_found").isNull()).alias("missing")
    )


def score_violations(scored: DataFrame) -> DataFrame:
    """Counts of impossible forecasts: bad means, probabilities outside [0, 1], sums other than one."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    inside = lambda c: finite(c) & F.col(c).between(0, 1)
    return scored.agg(
        F.count("*").alias("row_count"),
        F.count_if(~(finite("prediction") & (F.col("prediction") >= 0))).alias("bad_prediction"),
        F.count_if(~(inside("p_over") & inside("p_under"))).alias("bad_probability"),
        F.count_if(F.abs(F.col("p_over") + F.col("p_under") - 1) > 1e-9).alias("bad_sum"),
    )


def round_slice(schedule: DataFrame, names: Mapping[str, str], expected: int = 10) -> DataFrame:
    """Verdict per (season, round): exactly ``expected`` unique fixtures with canonical names."""
    named = schedule.select(
        "season", "match_round", canonical_name(F.col("side_a"), names).alias("side_a"), canonical_name(F.col("side_b"), names).alias("side_b")
    )
    return named.groupBy("season", "match_round", "side_a", "side_b").agg(F.count("*").alias("n")).groupBy("season", "match_round").agg(
        F.sum("n").alias("fixtures"), F.count("*").alias("unique_fixtures")
    ).withColumn("ok", (F.col("fixtures") == expected) & (F.col("unique_fixtures") == expected))


def rollback_guard(local: DataFrame, remote: DataFrame) -> DataFrame:
    """One row: a non-empty local ledger must not give way to an empty one."""
    return local.agg(F.count("*").alias("local_rows")).withColumn("remote_rows", remote.agg(F.count("*")).scalar()).withColumn(
        "rollback", (F.col("local_rows") > 0) & (F.col("remote_rows") == 0)
    )


def quality_report(contests: DataFrame, sides: DataFrame, features: DataFrame, target: str) -> DataFrame:
    """Seven named checks with OK or WARN; copies, targets and row numbers are those of the feature table."""
    one = contests.agg(
        F.count("*").alias("contests"), (F.count("event_id") - F.countDistinct("event_id")).alias("repeated_event_ids")
    )
    side = sides.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("official").isNull()).alias("no_official"),
    )
    made = features.agg(
        F.count("*").alias("made"),
        F.count_if(F.col(target).isNull()).alias("no_target"),
        (F.count("*") - F.countDistinct("event_id", "side")).alias("copies"),
    )
    facts = one.withColumns({"_s": side.select(F.struct("*")).scalar(), "_f": made.select(F.struct("*")).scalar()}).select("*", "_s.*", "_f.*")
    zero = lambda c: F.col(c) == 0
    checks = [
        ("contests", F.col("contests"), F.col("contests") > 0),
        ("side_rows", F.col("n"), F.col("n") == 2 * F.col("contests")),
        ("repeated_event_ids", F.col("repeated_event_ids"), zero("repeated_event_ids")),
        ("repeated_side_rows", F.col("copies"), zero("copies")),
        ("missing_officials", F.col("no_official"), zero("no_official")),
        ("missing_targets", F.col("no_target"), zero("no_target")),
        ("feature_rows", F.col("made"), F.col("made") == 2 * F.col("contests")),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("check_name"), value.cast("double").alias("value"), F.when(ok, "OK").otherwise("WARN").alias("status"))
            for name, value, ok in checks
        ]
    )
    return facts.select(F.explode(rows).alias("c")).select("c.*")
