"""Queries A-*: season, form, standings and summary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinside.operators import aggregates as agg
from twinside.operators.features import league_daily
from twinside.operators.sides import complete_totals, contest_pivot, for_against, official_rows, side_rows
from twinside.plans.base import avgs, query
from twinside.sources.tables import METRICS, contests

COLS = for_against(METRICS)
PARTS = [f"{p}_{m}" for m in METRICS for p in ("a", "b", "total")]
LINES = {
    "qty_for": [30.5, 40.5, 50.5, 60.5, 70.5],
    "qty_against": [30.5, 40.5, 50.5, 60.5, 70.5],
    "lines_for": [0.5, 1.5, 2.5, 3.5, 4.5],
    "lines_against": [0.5, 1.5, 2.5, 3.5, 4.5],
    "bulk_for": [0.5, 1.5, 2.5],
}
WDL = """count(*) AS matches, count(*) FILTER (result = 'W') AS wins, count(*) FILTER (result = 'D') AS draws,
  count(*) FILTER (result = 'L') AS losses, CAST(sum(points) AS BIGINT) AS points"""


def sides(spark, root):
    return side_rows(contests(spark, root), METRICS)


def officials(spark, root):
    return official_rows(contests(spark, root), METRICS)


@query(
    "A_01_side_dimension",
    """SELECT side, min(season) AS first_season, max(season) AS last_season,
    max(season) = (SELECT max(season) FROM sides) AS active FROM sides GROUP BY side""",
)
def side_dimension(spark, root):
    return agg.dimension(sides(spark, root), "side")


@query(
    "A_01_official_dimension",
    """SELECT official, min(season) AS first_season, max(season) AS last_season,
    max(season) = (SELECT max(season) FROM officials) AS active FROM officials GROUP BY official""",
)
def official_dimension(spark, root):
    return agg.dimension(contests(spark, root), "official")


@query("A_02_season_side_profile", f"SELECT season, side, {WDL}, {avgs(COLS)} FROM sides GROUP BY season, side")
def season_profile(spark, root):
    return agg.profile(sides(spark, root), ["season", "side"], METRICS)


@query(
    "A_03_venue_profile",
    f"SELECT season, side, venue, {WDL}, {avgs(COLS)} FROM sides GROUP BY season, side, venue",
)
def venue_profile(spark, root):
    return agg.profile(sides(spark, root), ["season", "side", "venue"], METRICS)


@query(
    "A_03_both_profile_levels",
    f"""SELECT season, side, venue, {WDL}, {avgs(COLS)} FROM sides
    GROUP BY GROUPING SETS ((season, side), (season, side, venue))""",
)
def both_levels(spark, root):
    return agg.profiles(sides(spark, root), METRICS)


@query(
    "A_04_official_season_means",
    f"SELECT season, official, count(*) AS matches, {avgs(PARTS)} FROM officials GROUP BY season, official",
)
def official_season(spark, root):
    return agg.official_means(officials(spark, root), ["season", "official"], PARTS)


PIVOT = ", ".join(f"max(CASE WHEN venue = '{v}' THEN {m}_for END) AS {p}_{m}" for m in METRICS for v, p in (("H", "a"), ("A", "b")))


@query("A_05_contest_pivot", f"SELECT event_id, {PIVOT} FROM sides GROUP BY event_id")
def pivot(spark, root):
    return contest_pivot(sides(spark, root), METRICS)


FORM_COLS = ["points", *COLS]


def form_oracle(view: str, key: str, columns) -> str:
    """Inclusive form by a range join of days to rows, unlike the row frames of the query."""
    picked = ", ".join(columns)
    return f""", numbered AS (
      SELECT season, {key}, event_date, {picked}, row_number() OVER (PARTITION BY season, {key} ORDER BY event_date, event_id) AS rn FROM {view}),
    days AS (SELECT season, {key}, event_date AS as_of_date, max(rn) AS upto FROM numbered GROUP BY ALL),
    wins AS (SELECT unnest([3, 5, 10]) AS "window")
    SELECT d.season, d.{key}, d.as_of_date, CAST(w."window" AS BIGINT) AS "window", count(*) AS matches_used, {avgs(columns)}
    FROM days d CROSS JOIN wins w JOIN numbered n
      ON n.season = d.season AND n.{key} = d.{key} AND n.rn > d.upto - w."window" AND n.rn <= d.upto
    GROUP BY d.season, d.{key}, d.as_of_date, w."window" """


@query("A_06_form_last_n", form_oracle("sides", "side", FORM_COLS))
def form(spark, root):
    return agg.form(sides(spark, root), ["season", "side"], FORM_COLS)


FORM_PARTS = ["total_qty", "a_qty", "b_qty", "total_bulk", "total_lines"]


@query("A_07_official_form", form_oracle("officials", "official", FORM_PARTS))
def official_form(spark, root):
    return agg.form(officials(spark, root), ["season", "official"], FORM_PARTS)


@query(
    "A_08_league_season",
    "SELECT season, count(*) AS matches, "
    + ", ".join(f"round(avg(a_{m} + b_{m}), 6) AS {m}_avg" for m in METRICS)
    + ", " + avgs([f"{s}_{m}" for m in METRICS for s in ("a", "b")]) + " FROM contests GROUP BY season",
)
def league_season(spark, root):
    return agg.league_season(contests(spark, root), METRICS)


@query(
    "A_09_standings",
    """, dates AS (SELECT DISTINCT season, event_date FROM sides),
    daily AS (SELECT season, side, event_date, count(*) AS n, count(*) FILTER (result = 'W') AS w, count(*) FILTER (result = 'D') AS d,
      count(*) FILTER (result = 'L') AS l, sum(score_for) AS gf, sum(score_against) AS ga, sum(points) AS p FROM sides GROUP BY ALL),
    past AS (
      SELECT dates.season, dates.event_date AS as_of_date, side, CAST(sum(n) AS BIGINT) AS played, CAST(sum(w) AS BIGINT) AS wins,
        CAST(sum(d) AS BIGINT) AS draws, CAST(sum(l) AS BIGINT) AS losses, CAST(sum(gf) AS BIGINT) AS scored,
        CAST(sum(ga) AS BIGINT) AS conceded, CAST(sum(p) AS BIGINT) AS points
      FROM dates JOIN daily ON daily.season = dates.season AND daily.event_date <= dates.event_date GROUP BY ALL)
    SELECT season, as_of_date, side, played, wins, draws, losses, scored, conceded, scored - conceded AS difference, points,
      row_number() OVER (PARTITION BY season, as_of_date ORDER BY points DESC, scored - conceded DESC, scored DESC, side) AS position
    FROM past""",
)
def standings(spark, root):
    return agg.standings(sides(spark, root))


@query(
    "A_10_latest_rolling",
    f""", scoped AS (
      SELECT 'ALL' AS scope, * FROM sides UNION ALL
      SELECT CASE WHEN venue = 'H' THEN 'HOME' ELSE 'AWAY' END, * FROM sides),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY season, side, scope ORDER BY event_date DESC, event_id DESC) AS rn FROM scoped),
    wins AS (SELECT unnest([0, 3, 5, 10]) AS "window"),
    as_of AS (SELECT season, side, max(event_date) AS as_of_date FROM sides GROUP BY season, side)
    SELECT season, side, as_of_date, scope, CAST("window" AS BIGINT) AS "window", count(*) AS matches_used, {avgs(COLS)}
    FROM numbered JOIN as_of USING (season, side) JOIN wins ON "window" = 0 OR rn <= "window"
    GROUP BY season, side, as_of_date, scope, "window" """,
)
def latest_rolling(spark, root):
    return agg.latest_rolling(sides(spark, root), METRICS)


TALL = """, scoped AS (
      SELECT 'ALL' AS scope, * FROM sides UNION ALL
      SELECT CASE WHEN venue = 'H' THEN 'HOME' ELSE 'AWAY' END, * FROM sides),
    tall AS (""" + " UNION ALL ".join(
    f"SELECT season, side, scope, '{c}' AS metric, CAST({c} AS DOUBLE) AS v FROM scoped WHERE {c} IS NOT NULL" for c in COLS
) + ")"


@query(
    "A_11_distribution",
    TALL + """ SELECT season, side, scope, metric, count(*) AS matches, round(avg(v), 6) AS mean, round(median(v), 6) AS median,
    round(coalesce(stddev_samp(v), 0), 6) AS std, min(v) AS minimum, round(quantile_cont(v, 0.25), 6) AS p25,
    round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS maximum FROM tall GROUP BY ALL""",
)
def distribution(spark, root):
    return agg.distribution(agg.value_histogram(sides(spark, root), COLS))


LINE_VALUES = ", ".join(f"('{m}', CAST({x} AS DOUBLE))" for m, xs in LINES.items() for x in xs)


@query(
    "A_12_threshold_rates",
    TALL + f""", line_list(metric, line) AS (VALUES {LINE_VALUES})
    SELECT season, side, scope, metric, line, count(*) AS matches, count(*) FILTER (v > line) AS hits,
      round(count(*) FILTER (v > line) / count(*), 6) AS hit_rate
    FROM tall JOIN line_list USING (metric) GROUP BY ALL""",
)
def thresholds(spark, root):
    return agg.threshold_rates(agg.value_histogram(sides(spark, root), list(LINES)), LINES)


@query(
    "A_13_official_by_side",
    f"""SELECT season, official, side, count(*) AS matches, {avgs(COLS)} FROM sides
    WHERE official IS NOT NULL GROUP BY season, official, side""",
)
def official_by_side(spark, root):
    return agg.official_means(sides(spark, root).filter("official IS NOT NULL"), ["season", "official", "side"], COLS)


LEAGUE = [f"total_{m}" for m in METRICS] + [f"{s}_{m}" for m in METRICS for s in ("a", "b")]
LEAGUE_ORACLE = f""", per_day AS (
      SELECT season, event_date, count(*) AS n, {", ".join(f"coalesce(sum(a_{m} + b_{m}), 0) AS total_{m}" for m in METRICS)},
        {", ".join(f"coalesce(sum({s}_{m}), 0) AS {s}_{m}" for m in METRICS for s in ("a", "b"))}
      FROM contests GROUP BY ALL),
    league_before AS (
      SELECT d.season, d.event_date, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS league_matches_before,
        {", ".join(f"round(sum(p.{c}) / nullif(sum(p.n), 0), 6) AS league_{c}_avg_before" for c in LEAGUE)}
      FROM per_day d LEFT JOIN per_day p ON p.season = d.season AND p.event_date < d.event_date GROUP BY d.season, d.event_date)
"""


@query("A_14_league_before_day", LEAGUE_ORACLE + "SELECT * FROM league_before")
def league_before(spark, root):
    return league_daily(contests(spark, root), METRICS)


@query(
    "A_15_side_dashboard",
    f""", cur AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY event_date DESC, event_id DESC) AS rn
      FROM sides WHERE season = (SELECT max(season) FROM sides)),
    totals AS (SELECT season, side, count(*) AS matches, {avgs(COLS)}, CAST(sum(points) AS BIGINT) AS points,
      sum(score_for) - sum(score_against) AS diff, sum(score_for) AS gf FROM cur GROUP BY season, side),
    last5 AS (SELECT side, {avgs(FORM_COLS, prefix="last5_")} FROM cur WHERE rn <= 5 GROUP BY side)
    SELECT season, side, matches, {", ".join(f"{c}_avg" for c in COLS)}, row_number() OVER (ORDER BY points DESC, diff DESC, gf DESC, side) AS position,
      points, round(points / matches, 6) AS ppg, {", ".join(f"last5_{c}_avg" for c in FORM_COLS)}
    FROM totals JOIN last5 USING (side)""",
)
def side_dashboard(spark, root):
    return agg.side_dashboard(sides(spark, root), METRICS)


@query(
    "A_16_official_dashboard",
    f""", cur AS (SELECT *, row_number() OVER (PARTITION BY official ORDER BY event_date DESC, event_id DESC) AS rn
      FROM officials WHERE season = (SELECT max(season) FROM officials))
    SELECT season, official, count(*) AS matches, {avgs(PARTS)},
      {", ".join(f"round(avg(CASE WHEN rn <= 5 THEN {c} END), 6) AS last5_{c}_avg" for c in ("total_qty", "total_bulk"))}
    FROM cur GROUP BY season, official""",
)
def official_dashboard(spark, root):
    return agg.official_dashboard(officials(spark, root), PARTS, ["total_qty", "total_bulk"])


@query(
    "A_29_complete_totals",
    "SELECT event_id, " + ", ".join(f"a_{m} + b_{m} AS total_{m}" for m in METRICS) + " FROM contests",
)
def totals(spark, root):
    return complete_totals(sides(spark, root), METRICS)
