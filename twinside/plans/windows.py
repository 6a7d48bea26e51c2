"""Queries W-*: leakage-safe windows and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinside.operators import features as ft
from twinside.operators.aggregates import table_before
from twinside.operators.scan import hot_keys, prior_features
from twinside.operators.sides import side_rows
from twinside.plans.aggregates import COLS, LEAGUE_ORACLE, PARTS, officials
from twinside.plans.base import query, shared
from twinside.sources.tables import METRICS, contests, fact

RECENT_TOTALS = ("qty", "bulk")
SPECS = ft.side_prior_specs(METRICS)
SEASON = "(PARTITION BY season, side ORDER BY event_date, event_id ROWS BETWEEN {} AND 1 PRECEDING)"
VENUE = "(PARTITION BY season, side, venue ORDER BY event_date, event_id ROWS BETWEEN {} AND 1 PRECEDING)"
CAREER = "(PARTITION BY side ORDER BY event_date, event_id ROWS BETWEEN {} AND 1 PRECEDING)"
H2H = "(PARTITION BY side, opponent ORDER BY event_date, event_id ROWS BETWEEN {} AND 1 PRECEDING)"
OFFICIAL = "(PARTITION BY season, official ORDER BY event_date, event_id ROWS BETWEEN {} AND 1 PRECEDING)"
OFFICIAL_ALL = "(PARTITION BY official ORDER BY event_date, event_id ROWS BETWEEN {} AND 1 PRECEDING)"


def sql_of(specs, frame: str) -> str:
    """DuckDB text of row-prior specs."""

    def one(s):
        reach = "UNBOUNDED PRECEDING" if s.rows is None else f"{s.rows} PRECEDING"
        over = frame.format(reach)
        if s.kind == "count":
            return f"count(*) OVER {over} AS {s.name}"
        if s.kind == "sum":
            return f"CAST(coalesce(sum({s.column}) OVER {over}, 0) AS BIGINT) AS {s.name}"
        return f"round(avg({s.column}) OVER {over}, 6) AS {s.name}"

    return ", ".join(one(s) for s in specs)


KEY = "event_id, side"


def sides(spark, root):
    """Side rows of the written contests: key sizes are measured without repeating the joins."""
    return side_rows(shared(spark, root, "contests", lambda: contests(spark, root)), METRICS)


def priors(spark, root, history, specs):
    return prior_features(sides(spark, root), ft.HISTORIES[history], specs).select(
        "event_id", "side", *[s.name for s in specs]
    )


def counts_query(spark, root):
    rows = sides(spark, root)
    for (h, keys), hot in zip(ft.HISTORIES.items(), hot_keys(rows, list(ft.HISTORIES.values()))):
        rows = prior_features(rows, keys, SPECS[h][:1], hot=hot)
    return rows.select("event_id", "side", *[SPECS[h][0].name for h in ft.HISTORIES])


query(
    "W_01_rows_before",
    "SELECT event_id, side, "
    + ", ".join(sql_of(SPECS[h][:1], f) for h, f in (("season", SEASON), ("venue", VENUE), ("career", CAREER), ("h2h", H2H)))
    + " FROM sides",
)(counts_query)


@query(
    "W_02_prior_sums",
    f""", x AS (SELECT event_id, side, {sql_of(SPECS['season'][:4], SEASON)} FROM sides)
    SELECT event_id, side, points_before, scored_before, conceded_before, scored_before - conceded_before AS diff_before,
      round(points_before / nullif(matches_before, 0), 6) AS ppg_before FROM x""",
)
def prior_sums(spark, root):
    rows = prior_features(sides(spark, root), ft.HISTORIES["season"], SPECS["season"][:4])
    return ft.with_derived(rows).select("event_id", "side", "points_before", "scored_before", "conceded_before", "diff_before", "ppg_before")


EXPANDING = [s for s in SPECS["season"] if s.kind == "mean" and s.rows is None]
ROLLING = [s for s in SPECS["season"] if s.rows]


@query("W_03_season_means", f"SELECT {KEY}, {sql_of(EXPANDING, SEASON)} FROM sides")
def season_means(spark, root):
    return priors(spark, root, "season", EXPANDING)


@query("W_04_venue_means", f"SELECT {KEY}, {sql_of(SPECS['venue'], VENUE)} FROM sides")
def venue_means(spark, root):
    return priors(spark, root, "venue", SPECS["venue"])


@query("W_05_rolling_means", f"SELECT {KEY}, {sql_of(ROLLING, SEASON)} FROM sides")
def rolling_means(spark, root):
    return priors(spark, root, "season", ROLLING)


@query("W_06_career_last5", f"SELECT {KEY}, {sql_of(SPECS['career'], CAREER)} FROM sides")
def career_means(spark, root):
    return priors(spark, root, "career", SPECS["career"])


@query(
    "W_07_rest_days",
    """, days AS (SELECT DISTINCT side, event_date FROM sides)
    SELECT side, event_date, date_diff('day', lag(event_date) OVER (PARTITION BY side ORDER BY event_date), event_date) AS days_rest FROM days""",
)
def rest(spark, root):
    return ft.rest_days(sides(spark, root))


TABLE_BEFORE = """, days AS (SELECT DISTINCT season, event_date FROM sides),
    entrants AS (SELECT DISTINCT season, side FROM sides),
    daily AS (SELECT season, side, event_date, count(*) AS n, sum(score_for) AS gf, sum(score_against) AS ga, sum(points) AS p FROM sides GROUP BY ALL),
    past AS (
      SELECT d.season, d.event_date, e.side, coalesce(sum(x.p), 0) AS p, coalesce(sum(x.gf), 0) AS gf,
        coalesce(sum(x.gf - x.ga), 0) AS gd, coalesce(sum(x.n), 0) AS n
      FROM days d JOIN entrants e ON e.season = d.season
      LEFT JOIN daily x ON x.season = e.season AND x.side = e.side AND x.event_date < d.event_date
      GROUP BY d.season, d.event_date, e.side),
    placed AS (SELECT *, row_number() OVER (PARTITION BY season, event_date ORDER BY p DESC, gd DESC, gf DESC, side) AS place FROM past),
    table_before AS (SELECT season, event_date, side, place AS position_before, CAST(p AS BIGINT) AS table_points_before,
      CAST(gd AS BIGINT) AS table_diff_before, CAST(n AS BIGINT) AS table_played_before
      FROM placed WHERE (season, side, event_date) IN (SELECT season, side, event_date FROM daily))
"""


@query("W_08_table_before_day", TABLE_BEFORE + "SELECT * FROM table_before")
def position(spark, root):
    return table_before(sides(spark, root))


OFFICIAL_SEASON = [ft.Prior("official_matches_before", "count"), *ft.means("official", PARTS, suffix="avg_before")] + [
    s for n in (5, 10) for s in ft.means(f"official_last{n}", [f"total_{m}" for m in RECENT_TOTALS], n, "avg_before")
]
OFFICIAL_CAREER = [
    ft.Prior("official_all_matches_before", "count"), *ft.means("official_all", PARTS, suffix="avg_before"),
    *ft.means("official_all_last10", [f"total_{m}" for m in RECENT_TOTALS], 10, "avg_before"),
]


@query("W_09_official_season", f"SELECT event_id, {sql_of(OFFICIAL_SEASON, OFFICIAL)} FROM officials")
def official_season(spark, root):
    return prior_features(officials(spark, root), ["season", "official"], OFFICIAL_SEASON).select(
        "event_id", *[s.name for s in OFFICIAL_SEASON]
    )


@query("W_10_official_career", f"SELECT event_id, {sql_of(OFFICIAL_CAREER, OFFICIAL_ALL)} FROM officials")
def official_career(spark, root):
    return prior_features(officials(spark, root), ["official"], OFFICIAL_CAREER).select(
        "event_id", *[s.name for s in OFFICIAL_CAREER]
    )


LEAGUE_NAMES = [f"league_{c}_avg_before" for m in METRICS for c in (f"total_{m}", f"a_{m}", f"b_{m}")]


@query(
    "W_11_league_before",
    LEAGUE_ORACLE + f"""SELECT event_id, league_matches_before, {", ".join(LEAGUE_NAMES)}
    FROM contests JOIN league_before USING (season, event_date)""",
)
def league_before(spark, root):
    rows = contests(spark, root)
    return rows.join(ft.league_daily(rows, METRICS), ["season", "event_date"], "left").select(
        "event_id", "league_matches_before", *LEAGUE_NAMES
    )


LEAGUE_RECENT = f""", ordered AS (SELECT event_date, event_id, {", ".join(f"a_{m} + b_{m} AS total_{m}" for m in METRICS)},
      row_number() OVER (ORDER BY event_date, event_id) AS rn FROM contests),
    firsts AS (SELECT event_date, min(rn) AS first_rn FROM ordered GROUP BY event_date),
    league_recent AS (
      SELECT f.event_date, {", ".join(f"round(avg(total_{m}), 6) AS recent20_league_total_{m}_avg_before" for m in METRICS)}
      FROM firsts f JOIN ordered o ON o.rn < f.first_rn AND o.rn >= f.first_rn - 20 GROUP BY f.event_date)
"""


@query("W_12_league_last20", LEAGUE_RECENT + "SELECT * FROM league_recent")
def league_recent(spark, root):
    return ft.league_recent(contests(spark, root), METRICS)


@query("W_13_head_to_head", f"SELECT {KEY}, {sql_of(SPECS['h2h'], H2H)} FROM sides")
def head_to_head(spark, root):
    return priors(spark, root, "h2h", SPECS["h2h"])


@query(
    "W_14_targets",
    f"SELECT event_id, side, venue, {', '.join(f'{c} AS target_{c}' for c in COLS)} FROM sides",
)
def targets(spark, root):
    rows = ft.training_features(fact(spark, root), METRICS, RECENT_TOTALS)
    return rows.select("event_id", "side", "venue", *[f"target_{c}" for c in COLS])


CONTEXT_SHARED = ["official_matches_before", "league_matches_before"] + [
    c for m in METRICS for c in (f"official_total_{m}_avg_before", f"league_total_{m}_avg_before")
]

FEATURES = (
    TABLE_BEFORE + LEAGUE_ORACLE + LEAGUE_RECENT
    + f""", side_priors AS (SELECT event_id, season, event_date, side, opponent, venue, official,
      {sql_of(SPECS['season'], SEASON)}, {sql_of(SPECS['venue'], VENUE)}, {sql_of(SPECS['career'], CAREER)}, {sql_of(SPECS['h2h'], H2H)} FROM sides),
    official_priors AS (SELECT event_id, {sql_of(OFFICIAL_SEASON, OFFICIAL)}, {sql_of(OFFICIAL_CAREER, OFFICIAL_ALL)} FROM officials),
    side_days AS (SELECT DISTINCT side, event_date FROM sides),
    rests AS (SELECT side, event_date, date_diff('day', lag(event_date) OVER (PARTITION BY side ORDER BY event_date), event_date) AS days_rest FROM side_days),
    own AS (
      SELECT s.*, scored_before - conceded_before AS diff_before, round(points_before / nullif(matches_before, 0), 6) AS ppg_before,
        o.* EXCLUDE (event_id), l.* EXCLUDE (season, event_date), r.* EXCLUDE (event_date), t.* EXCLUDE (season, event_date, side), days_rest
      FROM side_priors s LEFT JOIN official_priors o USING (event_id) LEFT JOIN league_before l USING (season, event_date)
      LEFT JOIN league_recent r ON r.event_date = s.event_date LEFT JOIN table_before t ON t.season = s.season AND t.event_date = s.event_date AND t.side = s.side
      LEFT JOIN rests ON rests.side = s.side AND rests.event_date = s.event_date)
"""
)


@query(
    "W_15_contest_context",
    FEATURES + f"""SELECT h.event_id, h.season, h.event_date, h.side AS side_a, h.opponent AS side_b, h.official,
      {", ".join(f"{v}.{c} AS {p}_{n}" for c, n in (("position_before",) * 2, ("points_before",) * 2, ("ppg_before",) * 2, ("days_rest", "rest_days")) for v, p in (("h", "a"), ("a", "b")))},
      {", ".join(f"h.{c}" for c in CONTEXT_SHARED)}
    FROM own h JOIN own a ON a.event_id = h.event_id AND a.venue = 'A' WHERE h.venue = 'H'""",
)
def context(spark, root):
    return ft.contest_context(ft.training_features(fact(spark, root), METRICS, RECENT_TOTALS, opposite=ft.PAIRED), METRICS)


BASIC = {
    "season": [SPECS["season"][0]] + ft.means("season", ["qty_for", "qty_against", "lines_for", "lines_against", "bulk_for"]),
    "venue": [SPECS["venue"][0]] + ft.means("venue", ["qty_for", "qty_against", "lines_for", "lines_against"]),
}
BASIC["season"] += [s for n in (3, 5, 10) for s in ft.means(f"last{n}", ["qty_for", "qty_against"], n)]
BASIC["season"] += ft.means("last5", ["lines_for", "lines_against", "bulk_for"], 5)
BASIC_KEEP = "event_id, season, event_date, side, opponent, venue, official"
BASIC_RAW = ["qty_for", "qty_against", "lines_for", "bulk_for"]


@query(
    "W_16_basic_features",
    f"""SELECT {BASIC_KEEP}, {sql_of(BASIC['season'], SEASON)}, {sql_of(BASIC['venue'], VENUE)}, {", ".join(BASIC_RAW)} FROM sides""",
)
def basic(spark, root):
    rows = sides(spark, root)
    for h, specs in BASIC.items():
        rows = prior_features(rows, ft.HISTORIES[h], specs)
    return rows.select(*BASIC_KEEP.split(", "), *[s.name for h in BASIC.values() for s in h], *BASIC_RAW)


@query(
    "W_16_feature_table",
    FEATURES + """, fcols AS (SELECT * EXCLUDE (season, event_date, side, opponent, venue, official) FROM own)
    SELECT own.*, opp.* EXCLUDE (opp_event_id, opp_side), """
    + ", ".join(f"s.{c} AS target_{c}" for c in COLS)
    + """ FROM own JOIN (SELECT COLUMNS(lambda c: c NOT IN ('season', 'event_date', 'opponent', 'venue', 'official')) AS 'opp_\\0' FROM own) opp
      ON opp.opp_event_id = own.event_id AND opp.opp_side = own.opponent
    JOIN sides s ON s.event_id = own.event_id AND s.side = own.side""",
)
def feature_table(spark, root):
    return ft.training_features(fact(spark, root), METRICS, RECENT_TOTALS)
