"""Queries A-22.., W-17.., V-*: validated observations and summaries for display."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinside.operators import models as md, views as vw
from twinside.operators.aggregates import latest_standings, standings
from twinside.operators.sides import official_rows, side_rows
from twinside.plans.aggregates import COLS, PARTS
from twinside.plans.base import avgs, query
from twinside.plans.gates import SCHEDULE, appointments, schedule
from twinside.plans.models import FORECASTS, MARKETS, forecasts
from twinside.sources.tables import METRICS, contests, fact

VM = ("qty", "lines", "bulk")

# Pairings meet many times in a season here: a contest's own number is its leg.
MATCHES = f""", copies AS (SELECT * FROM contests UNION ALL SELECT * FROM contests WHERE event_id % 7 = 0
    UNION ALL SELECT * REPLACE (a_score + 1 AS a_score) FROM contests WHERE event_id % 11 = 0),
  matches AS (SELECT event_id, season, event_date, kickoff_time AS kickoff, CAST(substr(kickoff_time, 1, 2) AS BIGINT) * 60 + CAST(substr(kickoff_time, 4, 2) AS BIGINT) AS kickoff_minutes,
    a_score || ':' || b_score AS score, side_a, side_b, coalesce(official, '') AS official, {", ".join(f"CAST(a_{m} + b_{m} AS DOUBLE) AS total_{m}" for m in VM)}
    FROM contests WHERE event_id % 11 <> 0),
  obs AS (SELECT s.event_id, s.season, s.event_date, s.side, s.opponent, s.venue, s.score_for || ':' || s.score_against AS score, m.kickoff_minutes,
    {", ".join(f"CAST({m}_for AS DOUBLE) AS {m}_for, CAST({m}_against AS DOUBLE) AS {m}_against, CAST({m}_for + {m}_against AS DOUBLE) AS {m}_total" for m in VM)}
    FROM sides s JOIN matches m USING (event_id))
"""


def matches_and_sides(spark, root):
    """Validated contests out of input with identical and conflicting copies."""
    c = fact(spark, root).withColumn("leg", F.col("event_id"))
    conflicting = c.filter("event_id % 11 = 0").withColumn("a_score", F.col("a_score") + 1)
    copies = c.unionByName(c.filter("event_id % 7 = 0")).unionByName(conflicting)
    rows = side_rows(c.drop("leg"), METRICS)
    return vw.match_statistics(copies, rows, VM, ("season", "side_a", "side_b", "leg")), rows


def observations(spark, root):
    m, rows = matches_and_sides(spark, root)
    return vw.side_observations(m, rows, VM)


@query("V_01_match_statistics", MATCHES + "SELECT * FROM matches")
def match_statistics(spark, root):
    return matches_and_sides(spark, root)[0]


@query("V_02_side_observations", MATCHES + "SELECT * FROM obs")
def side_observations(spark, root):
    return observations(spark, root)


@query(
    "V_03_round_overview",
    SCHEDULE + """, played AS (SELECT DISTINCT season, side_a, side_b FROM contests WHERE event_date < DATE '2001-06-01'),
    open AS (SELECT s.season, s.match_round, count(*) FILTER (p.side_a IS NULL) AS n FROM schedule s LEFT JOIN played p USING (season, side_a, side_b) GROUP BY ALL),
    cur AS (SELECT season, coalesce(min(match_round) FILTER (n > 0), max(match_round)) AS match_round FROM open GROUP BY season),
    newest AS (SELECT season, match_round, side_a, side_b, arg_max(official, event_id) AS official FROM appointments GROUP BY ALL)
    SELECT s.season, s.match_round, s.event_id, s.event_date, s.kickoff_time, s.side_a, s.side_b, coalesce(n.official, 'not appointed') AS official
    FROM schedule s JOIN cur USING (season, match_round) LEFT JOIN newest n USING (season, match_round, side_a, side_b)""",
)
def overview(spark, root):
    s = schedule(spark, root).drop("official")
    current = vw.current_round(s, s.filter("event_date < DATE '2001-06-01'"))
    return vw.round_overview(s, current, appointments(spark, root), "event_id")


ROUND = SCHEDULE + """, open AS (SELECT s.season, s.match_round, count(*) FILTER (p.side_a IS NULL) AS n FROM schedule s LEFT JOIN played p USING (season, side_a, side_b) GROUP BY ALL)
    SELECT season, coalesce(min(match_round) FILTER (n > 0), max(match_round)) AS match_round FROM open GROUP BY season"""


@query(
    "A_31_current_round",
    ROUND.replace(", open AS", ", played AS (SELECT DISTINCT season, side_a, side_b FROM contests WHERE event_id % 3 <> 0), open AS"),
)
def current_round(spark, root):
    s = schedule(spark, root)
    return vw.current_round(s, s.filter("event_id % 3 <> 0"))


@query(
    "A_34_newest_season_round",
    ROUND.replace(
        ", open AS",
        ", played AS (SELECT season, side AS side_a, opponent AS side_b FROM sides WHERE venue = 'H' AND event_date < DATE '2001-07-20' GROUP BY ALL), open AS",
    ).replace("FROM open GROUP BY season", "FROM open WHERE season = (SELECT max(season) FROM contests) GROUP BY season"),
)
def newest_round(spark, root):
    c = contests(spark, root)
    newest = c.agg(F.max("season")).scalar()
    done = side_rows(c, METRICS).filter("venue = 'H' AND event_date < DATE '2001-07-20'").selectExpr("season", "side AS side_a", "opponent AS side_b")
    return vw.current_round(schedule(spark, root).filter(F.col("season") == newest), done)


@query(
    "A_32_forecast_overview",
    FORECASTS + """SELECT event_id, side, market, round(prediction, 6) AS prediction FROM forecasts WHERE prediction IS NOT NULL
    UNION ALL SELECT event_id, 'TOTAL', market || '_total', round(sum(prediction), 6) FROM forecasts WHERE prediction IS NOT NULL GROUP BY event_id, market HAVING count(*) = 2""",
)
def compact(spark, root):
    rows = forecasts(spark, root).filter("prediction IS NOT NULL")
    totals = md.total_forecasts(rows, ["event_id"]).filter("prediction IS NOT NULL").withColumn("side", F.lit("TOTAL"))
    keep = ["event_id", "side", "market", "prediction"]
    priced = md.over_lines(rows, MARKETS).select(*keep, "line").unionByName(totals.select(*keep, F.lit(0.5).alias("line")))
    return md.forecast_overview(priced, ["event_id"], ["line"])


@query("A_33_official_choices", "SELECT DISTINCT official, 1::BIGINT AS place FROM contests WHERE official IS NOT NULL UNION ALL SELECT 'A Newcomer', 0::BIGINT")
def choices(spark, root):
    return vw.official_choices(contests(spark, root), "A Newcomer")


OFFICIAL_OBS = """, copies AS (SELECT * FROM officials UNION ALL SELECT * FROM officials WHERE event_id % 7 = 0 UNION ALL SELECT * REPLACE (a_lines + 1 AS a_lines) FROM officials WHERE event_id % 11 = 0),
    oobs AS (SELECT * FROM officials WHERE event_id % 11 <> 0)
"""


def official_observations(spark, root):
    o = official_rows(contests(spark, root), METRICS)
    conflicting = o.filter("event_id % 11 = 0").withColumn("a_lines", F.col("a_lines") + 1)
    return vw.official_observations(o.unionByName(o.filter("event_id % 7 = 0")).unionByName(conflicting), PARTS)


@query("A_22_official_summary", OFFICIAL_OBS + f"SELECT season, official, count(*) AS matches, {avgs(PARTS)} FROM oobs GROUP BY season, official")
def official_summary(spark, root):
    return vw.official_summary(official_observations(spark, root), PARTS)


@query(
    "A_23_official_detail",
    OFFICIAL_OBS + f""", n AS (SELECT *, row_number() OVER (PARTITION BY season, official ORDER BY event_date DESC, event_id DESC) AS back FROM oobs)
    SELECT season, official, 'season' AS span, count(*) AS matches, {avgs(PARTS)} FROM n GROUP BY season, official
    UNION ALL SELECT season, official, 'form', count(*), {avgs(PARTS)} FROM n WHERE back <= 5 GROUP BY season, official""",
)
def official_detail(spark, root):
    return vw.official_detail(official_observations(spark, root), PARTS)


def summary_sql(c: str) -> str:
    return f"count({c}) AS valid_n, CAST(sum({c}) AS DOUBLE) AS total, round(avg({c}), 6) AS mean, CAST(min({c}) AS DOUBLE) AS minimum, CAST(max({c}) AS DOUBLE) AS maximum"


@query(
    "A_24_official_ranking",
    MATCHES + f""", t AS (SELECT season, official, count(*) AS matches, {summary_sql('total_qty')}, avg(total_qty) AS m FROM matches WHERE official <> '' GROUP BY season, official)
    SELECT * EXCLUDE (m), CASE WHEN m IS NOT NULL THEN rank() OVER (PARTITION BY season ORDER BY m DESC NULLS LAST) END AS place FROM t""",
)
def official_ranking(spark, root):
    return vw.ranking(matches_and_sides(spark, root)[0], "official", "total_qty")


@query(
    "A_24_side_ranking",
    MATCHES + f""", t AS (SELECT season, side, count(*) AS matches, {summary_sql('lines_total')}, avg(lines_total) AS m FROM obs WHERE venue = 'H' GROUP BY season, side)
    SELECT * EXCLUDE (m), CASE WHEN m IS NOT NULL THEN rank() OVER (PARTITION BY season ORDER BY m DESC NULLS LAST) END AS place FROM t""",
)
def side_ranking(spark, root):
    return vw.ranking(observations(spark, root).filter("venue = 'H'"), "side", "lines_total")


TALL_OBS = MATCHES + ", tall AS (" + " UNION ALL ".join(f"SELECT season, side, event_id, '{m}_total' AS metric, {m}_total AS x FROM obs" for m in VM) + ")"


@query(
    "A_25_side_against_league",
    TALL_OBS + """, own AS (SELECT season, side, metric, avg(x) AS own_mean, count(x) AS own_n FROM tall GROUP BY ALL),
    once AS (SELECT DISTINCT season, event_id, metric, x FROM tall), lg AS (SELECT season, metric, avg(x) AS league_mean, count(x) AS league_n FROM once GROUP BY ALL)
    SELECT season, side, metric, round(own_mean, 6) AS own_mean, own_n, round(league_mean, 6) AS league_mean, league_n, round(own_mean - league_mean, 6) AS difference FROM own JOIN lg USING (season, metric)""",
)
def against_league(spark, root):
    return vw.compare_with_league(observations(spark, root), "side", [f"{m}_total" for m in VM], once="event_id")


@query("A_26_league_reference", MATCHES + f"SELECT season, {summary_sql('qty_total')} FROM (SELECT DISTINCT season, event_id, qty_total FROM obs) GROUP BY season")
def reference(spark, root):
    return vw.league_reference(observations(spark, root), "qty", "total")


PLACES = """, tab AS (SELECT season, side, CAST(row_number() OVER (PARTITION BY season ORDER BY sum(points) DESC, sum(score_for) - sum(score_against) DESC, sum(score_for) DESC, side) AS BIGINT) AS position FROM sides GROUP BY season, side)
"""


def places(spark, root):
    return latest_standings(standings(side_rows(contests(spark, root), METRICS)))


@query(
    "A_27_cross_table",
    PLACES + """, h AS (SELECT * FROM sides WHERE venue = 'H'), cells AS (
      SELECT season, side, side AS opponent, avg(qty_for) AS qty_for, avg(lines_for) AS lines_for FROM h GROUP BY season, side
      UNION ALL SELECT season, side, opponent, CASE WHEN count(*) = 1 THEN max(qty_for) END, CASE WHEN count(*) = 1 THEN max(lines_for) END FROM h GROUP BY season, side, opponent)
    SELECT c.season, c.side, t.position, c.opponent, round(qty_for, 6) AS qty_for, round(lines_for, 6) AS lines_for FROM cells c JOIN tab t ON t.season = c.season AND t.side = c.opponent""",
)
def cross_table(spark, root):
    return vw.cross_table(side_rows(contests(spark, root), METRICS), places(spark, root), ["qty_for", "lines_for"])


@query(
    "A_27_venue_table",
    PLACES + """SELECT t.season, t.side, t.position, round(avg(s.qty_for), 6) AS qty_for, round(avg(s.lines_for), 6) AS lines_for
    FROM tab t LEFT JOIN sides s ON s.season = t.season AND s.side = t.side AND s.venue = 'A' GROUP BY ALL""",
)
def venue_table(spark, root):
    return vw.venue_table(side_rows(contests(spark, root), METRICS), places(spark, root), ["qty_for", "lines_for"], "A")


@query(
    "A_28_latest_standings",
    PLACES + "SELECT season, side, position, CAST(sum(points) AS BIGINT) AS points FROM tab JOIN sides USING (season, side) GROUP BY ALL",
)
def latest(spark, root):
    return places(spark, root).select("season", "side", "position", "points")


@query("A_28_standings_checks", "SELECT season, 0::BIGINT AS repeated_sides, 0::BIGINT AS repeated_positions, 0::BIGINT AS bad_positions FROM contests GROUP BY season")
def latest_checks(spark, root):
    return vw.standings_violations(places(spark, root))


@query(
    "A_28_planted_faults",
    PLACES + """SELECT season, count(*) FILTER (position <= 2) AS repeated_sides, count(*) FILTER (position <= 2) + greatest(count(*) FILTER (position IN (3, 5)) - 1, 0) AS repeated_positions,
    count(*) FILTER (position IN (3, 5)) AS bad_positions FROM tab GROUP BY season""",
)
def planted_standings(spark, root):
    """The checks on standings that hold the first two sides twice, and the third and fifth at position zero."""
    rows = places(spark, root).select("season", "side", F.col("position").cast("bigint").alias("position"))
    return vw.standings_violations(rows.unionByName(rows.filter("position <= 2")).withColumn("position", F.when(F.col("position").isin(3, 5), 0).otherwise(F.col("position"))))


CLASSED = """, m AS (SELECT season, side, avg(qty_for) AS mean FROM sides GROUP BY season, side),
    cl AS (SELECT s.season, s.side, s.event_id, s.event_date, s.qty_for AS value, mean, s.qty_for - mean AS difference,
      CASE WHEN s.qty_for > mean THEN 'Over' WHEN s.qty_for < mean THEN 'Under' ELSE 'Equal' END AS category FROM sides s JOIN m USING (season, side) WHERE s.qty_for IS NOT NULL)
"""


def classed(spark, root):
    return vw.classed_history(side_rows(contests(spark, root), METRICS), ["season", "side"], "qty_for")


@query("W_17_classed_history", CLASSED + "SELECT event_id, side, value, round(mean, 6) AS mean, round(difference, 6) AS difference, category FROM cl")
def classed_history(spark, root):
    return classed(spark, root).select("event_id", "side", "value", "mean", "difference", "category")


@query(
    "W_18_run_lengths",
    CLASSED + """, i AS (SELECT *, row_number() OVER (PARTITION BY season, side ORDER BY event_date, event_id) AS rn,
      row_number() OVER (PARTITION BY season, side ORDER BY event_date, event_id) - row_number() OVER (PARTITION BY season, side, category ORDER BY event_date, event_id) AS island FROM cl),
    runs AS (SELECT season, side, category, island, count(*) AS n, max(rn) AS last_rn FROM i GROUP BY ALL)
    SELECT season, side, max(n) FILTER (category = 'Over') AS longest_over, max(n) FILTER (category = 'Under') AS longest_under,
      round(avg(n) FILTER (category = 'Over'), 6) AS mean_over, round(avg(n) FILTER (category = 'Under'), 6) AS mean_under,
      arg_max(category, last_rn) AS current_category, arg_max(n, last_rn) AS current_length FROM runs GROUP BY season, side""",
)
def run_lengths(spark, root):
    return vw.run_lengths(classed(spark, root), ["season", "side"], ["event_date", "event_id"])


@query(
    "W_19_recent_form",
    CLASSED + """, n AS (SELECT *, row_number() OVER (PARTITION BY season, side ORDER BY event_date DESC, event_id DESC) AS back FROM cl)
    SELECT season, side, count(*) AS recent_n, round(avg(value), 6) AS recent_mean, round(max(mean), 6) AS mean, round(avg(value) - max(mean), 6) AS difference FROM n WHERE back <= 5 GROUP BY season, side""",
)
def recent(spark, root):
    return vw.recent_form(classed(spark, root), ["season", "side"])


SIGNED = ["a_qty", "b_qty", "a_bulk", "b_bulk"]


@query(
    "W_20_sign_against_mean",
    ", m AS (SELECT season, official, " + ", ".join(f"avg({c}) AS m_{c}" for c in SIGNED) + " FROM officials GROUP BY season, official) SELECT event_id, season, official, "
    + ", ".join(f"CAST(sign({c} - m_{c}) AS BIGINT) AS {c}_sign" for c in SIGNED) + " FROM officials JOIN m USING (season, official)",
)
def signs(spark, root):
    return vw.sign_against_mean(official_rows(contests(spark, root), METRICS), ["season", "official"], SIGNED)
