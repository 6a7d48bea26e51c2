"""Leakage-safe features for past contests and for future fixtures.

``training_features`` works on whole history: official and league parts are
computed per contest, then contests become side rows, so nothing has to be
joined back from the doubled side frame.  ``fixture_features`` looks future
fixtures up in day-prior states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinside.functions.numbers import null_safe_sum
from twinside.operators.aggregates import table_before
from twinside.operators.scan import Prior, asof, day_states, hot_keys, means, prior_features
from twinside.operators.sides import for_against, side_rows

RECENT = (3, 5, 10)
LEAGUE_ROWS = 20


def official_priors(contests: DataFrame, metrics: Sequence[str], recent: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """Contests plus the official's record before each contest, in the season and over all seasons.

    Contests without an official form no history: they skip the windows
    instead of piling up under one null key.
    """
    totals = {f"total_{m}": null_safe_sum(F.col(f"a_{m}"), F.col(f"b_{m}")) for m in metrics}
    parts = [c for m in metrics for c in (f"a_{m}", f"b_{m}", f"total_{m}")]
    recent = [f"total_{m}" for m in recent]
    season = [Prior("official_matches_before", "count"), *means("official", parts, suffix="avg_before")]
    season += [s for n in (5, 10) for s in means(f"official_last{n}", recent, n, "avg_before")]
    career = [Prior("official_all_matches_before", "count"), *means("official_all", parts, suffix="avg_before")]
    career += means("official_all_last10", recent, 10, "avg_before")
    named = contests.filter("official IS NOT NULL").withColumns(totals)
    hot = hot_keys(named, [["season", "official"], ["official"]], hot_rows)
    out = prior_features(named, ["season", "official"], season, hot_rows=hot_rows, hot=hot[0])
    out = prior_features(out, ["official"], career, hot_rows=hot_rows, hot=hot[1])
    return out.drop(*totals).unionByName(contests.filter("official IS NULL"), allowMissingColumns=True)


def league_daily(contests: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per season and day: averages over all contests of the season before that day.

    The divisor counts every earlier contest, also those with a missing metric.
    """
    parts = {f"league_total_{m}": f"a_{m} + b_{m}" for m in metrics} | {f"league_{s}_{m}": f"{s}_{m}" for m in metrics for s in ("a", "b")}
    return contests.sparkSession.sql(
        f"""SELECT season, event_date, coalesce(sum(_n) OVER w, 0) AS league_matches_before,
          {", ".join(f"try_divide(sum({n}) OVER w, nullif(sum(_n) OVER w, 0)) AS {n}_avg_before" for n in parts)}
        FROM (SELECT season, event_date, count(*) AS _n, {", ".join(f"coalesce(sum({e}), 0) AS {n}" for n, e in parts.items())}
          FROM {{contests}} GROUP BY season, event_date)
        WINDOW w AS (PARTITION BY season ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        contests=contests,
    )


def league_recent(contests: DataFrame, metrics: Sequence[str], n: int = LEAGUE_ROWS) -> DataFrame:
    """Per day: mean totals of the ``n`` contests before that day, over all seasons.

    There is no key to partition the global order by, so it is rebuilt from
    the calendar: daily counts give each day its starting rank, the newest
    ``n`` contests of a day get ranks from the day's end, and a day's window is
    the rank range just before its start, met by an equi join.  Only ``n`` rows
    per day pass the limited ranking; the unkeyed window sees one row per day.
    """
    total = {f"total_{m}": F.col(f"a_{m}") + F.col(f"b_{m}") for m in metrics}
    days = contests.groupBy("event_date").agg(F.count("*").alias("_n"))
    starts = days.select(
        "event_date", "_n",
        F.coalesce(F.sum("_n").over(Window.orderBy("event_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    newest = Window.partitionBy("event_date").orderBy(F.desc("event_id"))
    ranked = (
        contests.withColumns(total).select("event_date", "event_id", *total)
        .withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n)
        .join(starts, "event_date")
        .select((F.col("_start") + F.col("_n") - F.col("_back") + 1).alias("_rank"), *total)
    )
    wanted = starts.filter("_start > 0").select(
        "event_date", F.explode(F.sequence(F.greatest(F.col("_start") - n + 1, F.lit(1)), F.col("_start"))).alias("_rank")
    )
    return wanted.join(ranked, "_rank").groupBy("event_date").agg(
        *[F.avg(c).alias(f"recent{n}_league_{c}_avg_before") for c in total]
    )


def rest_days(sides: DataFrame) -> DataFrame:
    """Per side and day: days since the previous day with an event; shared by all rows of the day."""
    days = sides.select("side", "event_date").distinct()
    previous = F.lag("event_date").over(Window.partitionBy("side").orderBy("event_date"))
    return days.select("side", "event_date", F.datediff("event_date", previous).alias("days_rest"))


def side_prior_specs(metrics: Sequence[str]) -> dict[str, list[Prior]]:
    """Row-prior feature lists by history: season, venue, career (all seasons) and head to head."""
    cols = for_against(metrics)
    recent = ["points", *cols]
    return {
        "season": [
            Prior("matches_before", "count"),
            Prior("points_before", "sum", "points"),
            Prior("scored_before", "sum", "score_for"),
            Prior("conceded_before", "sum", "score_against"),
            *means("season", cols),
            *[s for n in RECENT for s in means(f"last{n}", recent, n)],
        ],
        "venue": [Prior("venue_matches_before", "count"), *means("venue", cols)],
        "career": [Prior("career_matches_before", "count"), *means("career_last5", [*cols, "points"], 5)],
        "h2h": [
            Prior("h2h_matches_before", "count"),
            *means("h2h", cols, suffix="avg_before"),
            *means("h2h_last3", cols, 3, "avg_before"),
        ],
    }


HISTORIES = {
    "season": ["season", "side"],
    "venue": ["season", "side", "venue"],
    "career": ["side"],
    "h2h": ["side", "opponent"],
}


def side_priors(sides: DataFrame, metrics: Sequence[str], histories: Sequence[str] = tuple(HISTORIES), hot_rows: int | None = None) -> DataFrame:
    """Side rows plus the row-prior features of the chosen histories."""
    specs = side_prior_specs(metrics)
    hot = hot_keys(sides, [HISTORIES[h] for h in histories], hot_rows)
    out = sides
    for h, heavy in zip(histories, hot):
        out = prior_features(out, HISTORIES[h], specs[h], hot_rows=hot_rows, hot=heavy)
    return with_derived(out)


def with_derived(df: DataFrame) -> DataFrame:
    if "points_before" not in df.columns:
        return df
    return df.withColumns(
        {
            "ppg_before": F.try_divide("points_before", F.nullif("matches_before", F.lit(0))),
            "diff_before": F.col("scored_before") - F.col("conceded_before"),
        }
    )


IDENTIFIERS = ("event_id", "season", "event_date", "side", "opponent", "venue", "official")
SHARED = ("official_", "league_", "recent")


def mirror(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``opp_<c>`` from the other row of the same contest.

    Both rows are neighbours in one window over the contest: one shuffle, where
    a self join would move the wide frame twice. They come as one struct, of
    which nothing can be left out later: name only columns that are read.
    """
    other = f"struct({', '.join(columns)})"
    w = "OVER (PARTITION BY event_id ORDER BY venue)"
    paired = df.selectExpr("*", f"coalesce(lead({other}) {w}, lag({other}) {w}) AS _opp")
    return paired.selectExpr("*", *[f"_opp.{c} AS opp_{c}" for c in columns]).drop("_opp")


def training_features(
    contests: DataFrame, metrics: Sequence[str], recent: Sequence[str], hot_rows: int | None = None, opposite: Sequence[str] | None = None
) -> DataFrame:
    """The wide feature table: identifiers, own and ``opp_`` features (of all own ones, or of those named ``opposite``), targets."""
    raw = side_rows(contests, metrics)
    per_contest = (
        official_priors(contests, metrics, recent, hot_rows)
        .join(league_daily(contests, metrics), ["season", "event_date"], "left")
        .join(league_recent(contests, metrics), "event_date", "left")
    )
    shared = [c for c in per_contest.columns if c not in contests.columns]
    sides = side_rows(per_contest, metrics, keep=shared)
    specs = side_prior_specs(metrics)
    hot = dict(zip(HISTORIES, hot_keys(raw, list(HISTORIES.values()), hot_rows)))
    for h, keys in HISTORIES.items():
        sides = prior_features(sides, keys, specs[h], hot_rows=hot_rows, hot=hot[h])
    wide = (
        with_derived(sides)
        .join(table_before(raw), ["season", "event_date", "side"], "left")
        .join(rest_days(raw), ["side", "event_date"], "left")
    )
    measured = {*for_against(metrics), "points", "result", "kickoff_time"}
    own = [c for c in wide.columns if c not in IDENTIFIERS and c not in measured]
    other = own if opposite is None else list(opposite)
    return mirror(wide, other).selectExpr(
        *IDENTIFIERS, *own, *[f"opp_{c}" for c in other], *[f"{c} AS target_{c}" for c in for_against(metrics)]
    )


#: Features of both sides in a contest's context, and what they are called there.
PAIRED = {"position_before": "position_before", "points_before": "points_before", "ppg_before": "ppg_before", "days_rest": "rest_days"}


def contest_context(features: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per contest with both sides' record, from the ``opp_`` columns of the H row."""
    shared = ["official_matches_before", "league_matches_before"]
    shared += [c for m in metrics for c in (f"official_total_{m}_avg_before", f"league_total_{m}_avg_before")]
    return features.filter("venue = 'H'").select(
        "event_id", "season", "event_date", F.col("side").alias("side_a"), F.col("opponent").alias("side_b"), "official",
        *[F.col(f"{p}{c}").alias(f"{s}_{n}") for c, n in PAIRED.items() for p, s in (("", "a"), ("opp_", "b"))],
        *shared,
    )


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def fixture_features(contests: DataFrame, fixtures: DataFrame, metrics: Sequence[str], recent: Sequence[str]) -> DataFrame:
    """Two feature rows per fixture (fixture_id, season, event_date, side_a, side_b, official).

    Every part is an as-of lookup of a day state strictly before the fixture's
    day.  A side without history gets null features.
    """
    sides = side_rows(contests, metrics)
    cols = for_against(metrics)
    last = lambda ns, cs: [(n, c) for n in ns for c in cs]

    def named(states: DataFrame, all_to: str, last_to: str) -> DataFrame:
        names = {}
        for c in states.columns:
            if c.startswith("all_"):
                names[c] = all_to.format(c[4:])
            elif c.startswith("last"):
                n, _, col = c[4:].partition("_")
                names[c] = last_to.format(n, col)
        return _renamed(states, names)

    season = named(day_states(sides, HISTORIES["season"], cols, last(RECENT, cols), "matches_before"), "season_{}_avg", "last{}_{}_avg")
    venue = named(day_states(sides, HISTORIES["venue"], cols, (), "venue_matches_before"), "venue_{}_avg", "")
    career = named(day_states(sides, HISTORIES["career"], (), last((5,), [*cols, "points"]), "career_matches_before"), "", "career_last{}_{}_avg")
    h2h = named(day_states(sides, HISTORIES["h2h"], cols, last((3,), cols), "h2h_matches_before"), "h2h_{}_avg_before", "h2h_last{}_{}_avg_before")
    career = career.withColumn("_last_day", F.col("event_date"))

    rows = fixtures.select(
        "fixture_id", "season", "event_date", "official",
        F.explode(
            F.array(
                F.struct(F.col("side_a").alias("side"), F.col("side_b").alias("opponent"), F.lit("H").alias("venue")),
                F.struct(F.col("side_b").alias("side"), F.col("side_a").alias("opponent"), F.lit("A").alias("venue")),
            )
        ).alias("v"),
    ).select("fixture_id", "season", "event_date", "official", "v.*")
    for states, keys in ((season, "season"), (venue, "venue"), (career, "career"), (h2h, "h2h")):
        rows = asof(rows, states, HISTORIES[keys], "event_date")
    counts = [c for c in rows.columns if c.endswith("matches_before")]
    rows = rows.withColumn("days_rest", F.datediff("event_date", "_last_day")).drop("_last_day")
    rows = rows.fillna(0, counts)
    own = [c for c in rows.columns if c not in ("fixture_id", *IDENTIFIERS)]
    rows = mirror(rows.withColumnRenamed("fixture_id", "event_id"), own).withColumnRenamed("event_id", "fixture_id")
    shared = fixture_shared(contests, fixtures.select("fixture_id", "season", "event_date", "official"), metrics, recent)
    return rows.join(shared.drop("season", "event_date", "official"), "fixture_id")


def fixture_shared(contests: DataFrame, fixtures: DataFrame, metrics: Sequence[str], recent: Sequence[str]) -> DataFrame:
    """Official and league parts of a fixture, one row per fixture.

    Season league means average the known totals, as at inference time.
    """
    totals = {f"total_{m}": null_safe_sum(F.col(f"a_{m}"), F.col(f"b_{m}")) for m in metrics}
    parts = [c for m in metrics for c in (f"a_{m}", f"b_{m}", f"total_{m}")]
    named = contests.filter("official IS NOT NULL").withColumns(totals)
    recent_totals = [f"total_{m}" for m in recent]
    season = day_states(named, ["season", "official"], parts, [(n, c) for n in (5, 10) for c in recent_totals], "official_matches_before")
    career = day_states(named, ["official"], parts, [(10, c) for c in recent_totals], "official_all_matches_before")

    def label(states: DataFrame, prefix: str) -> DataFrame:
        names = {c: f"{prefix}_{c[4:]}_avg_before" for c in states.columns if c.startswith("all_")}
        names |= {c: f"{prefix}_{c}_avg_before" for c in states.columns if c.startswith("last")}
        return _renamed(states, names)

    both = {f"total_{m}": F.col(f"a_{m}") + F.col(f"b_{m}") for m in metrics}
    league = day_states(contests.withColumns(both), ["season"], parts)
    league = _renamed(league, {c: f"league_{c[4:]}_avg_before" for c in league.columns if c.startswith("all_")})
    out = asof(fixtures, label(season, "official"), ["season", "official"], "event_date")
    out = asof(out, label(career, "official_all"), ["official"], "event_date")
    out = asof(out, league, ["season"], "event_date")
    out = asof(out.withColumn("_all", F.lit(1)), _league_recent_states(contests, metrics), ["_all"], "event_date")
    return out.drop("_all").fillna(0, ["official_matches_before", "official_all_matches_before"])


def _league_recent_states(contests: DataFrame, metrics: Sequence[str], n: int = LEAGUE_ROWS) -> DataFrame:
    """State after each day: mean totals of the newest ``n`` contests up to that day."""
    both = {f"total_{m}": F.col(f"a_{m}") + F.col(f"b_{m}") for m in metrics}
    newest = Window.partitionBy("event_date").orderBy(F.desc("event_id"))
    # At most n rows per calendar day are left for the one-key window.
    tails = (
        contests.withColumns(both).select("event_date", "event_id", *both)
        .withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n)
        .withColumn("_all", F.lit(1))
    )
    w = Window.partitionBy("_all").orderBy("event_date", "event_id").rowsBetween(-(n - 1), 0)
    return tails.select(
        "_all", "event_date", "_back", *[F.avg(c).over(w).alias(f"recent{n}_league_{c}_avg_before") for c in both]
    ).filter("_back = 1").drop("_back")


def unknown_sides(contests: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Violation rows: fixture sides that never occur in history."""
    known = contests.select(F.explode(F.array("side_a", "side_b")).alias("side")).distinct()
    asked = fixtures.select("fixture_id", F.explode(F.array("side_a", "side_b")).alias("side"))
    return asked.join(known, "side", "left_anti").withColumn("violation", F.lit("unknown side"))


def feature_names(columns: Sequence[str]) -> list[str]:
    """Model inputs: everything that is neither an identifier nor a target."""
    return [c for c in columns if c not in IDENTIFIERS and not c.startswith("target_")]
