"""Queries J-*, U-* and T-*: joins, integrity gates, order and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from twinside.operators import features as ft, joins as jn, quality as qa
from twinside.operators.aggregates import tail_rows
from twinside.operators.ordering import rank_rows
from twinside.operators.scan import asof, day_states, means, prior_features
from twinside.operators.sides import side_rows
from twinside.plans.aggregates import COLS, sides
from twinside.plans.base import query
from twinside.plans.sources import NAMES, ZONE
from twinside.plans.windows import FEATURES, RECENT_TOTALS, SEASON, sql_of
from twinside.sources.tables import METRICS, contests, fact, table

SCHEDULE = """, schedule AS (SELECT season, CAST(1 + (event_date - make_date(CAST(substr(season, 1, 4) AS BIGINT), 7, 1)) // 10 AS BIGINT) AS match_round,
  event_id, event_date, kickoff_time, side_a, side_b FROM contests),
appointments AS (SELECT match_round, s.season, s.event_id, s.side_a, s.side_b, 'Ref ' || chr(64 + CAST(substr(official, 7) AS INTEGER)) AS official
  FROM schedule s JOIN contests USING (event_id) WHERE official IS NOT NULL)
"""


def schedule(spark, root):
    c = contests(spark, root)
    first = F.make_date(F.substring("season", 1, 4).cast("int"), F.lit(7), F.lit(1))
    return c.select(
        "season", F.floor(F.datediff("event_date", first) / 10 + 1).alias("match_round"),
        "event_id", "event_date", "kickoff_time", "side_a", "side_b", "official",
    )


def appointments(spark, root):
    letter = F.char(F.lit(64) + F.substring("official", 7, 9).cast("int"))
    return schedule(spark, root).filter("official IS NOT NULL").select(
        "match_round", "season", "event_id", "side_a", "side_b", F.concat(F.lit("Ref "), letter).alias("official")
    )


@query(
    "J_01_contest_with_sides",
    "SELECT event_id, a_qty AS home_qty_for, b_qty AS away_qty_for, a_lines AS home_lines_for, b_lines AS away_lines_for FROM contests",
)
def both(spark, root):
    c = contests(spark, root)
    return jn.with_both_sides(c.select("event_id"), side_rows(c, METRICS), ["qty_for", "lines_for"])


@query("J_02_many_to_one", "SELECT s.event_id, s.side, c.side_a, c.kickoff_time AS kickoff FROM sides s JOIN contests c USING (event_id)")
def validated(spark, root):
    c = contests(spark, root)
    right = c.select("event_id", "side_a", F.col("kickoff_time").alias("kickoff"))
    return jn.many_to_one(side_rows(c, METRICS).select("event_id", "side"), right, ["event_id"], label="contests")


MEANS = means("season", COLS)


@query(
    "J_03_opponent_mirror",
    f""", f AS (SELECT event_id, side, opponent, {sql_of(MEANS, SEASON)} FROM sides)
    SELECT f.event_id, f.side, {", ".join(f"f.{s.name}, o.{s.name} AS opp_{s.name}" for s in MEANS)}
    FROM f LEFT JOIN f o ON o.event_id = f.event_id AND o.side = f.opponent""",
)
def mirrored(spark, root):
    names = [s.name for s in MEANS]
    rows = prior_features(sides(spark, root), ["season", "side"], MEANS).select("event_id", "side", "venue", *names)
    return ft.mirror(rows, names).drop("venue")


STITCHED = ["season_qty_for_avg", "official_total_qty_avg_before", "league_total_qty_avg_before", "position_before", "days_rest"]


@query("J_04_feature_stitching", FEATURES + f"SELECT event_id, side, {', '.join(STITCHED)} FROM own")
def stitched(spark, root):
    return ft.training_features(fact(spark, root), METRICS, RECENT_TOTALS).select("event_id", "side", *STITCHED)


FIXTURE_DAY = "2001-01-01"
FIXTURES = f""", fixtures AS (SELECT event_id AS fixture_id, season, event_date, official, side_a, side_b FROM contests WHERE event_date >= DATE '{FIXTURE_DAY}'),
fixture_sides AS (SELECT fixture_id, season, event_date, official, side_a AS side, side_b AS opponent, 'H' AS venue FROM fixtures
  UNION ALL SELECT fixture_id, season, event_date, official, side_b, side_a, 'A' FROM fixtures)
"""


def fixtures(spark, root):
    return fixtures_of(contests(spark, root))


def fixtures_of(c):
    return c.filter(F.col("event_date") >= FIXTURE_DAY).select(
        F.col("event_id").alias("fixture_id"), "season", "event_date", "official", "side_a", "side_b"
    )


@query(
    "J_05_asof_last5",
    FIXTURES + """, h AS (SELECT f.fixture_id, f.side, s.qty_for, s.points, row_number() OVER (PARTITION BY f.fixture_id, f.side ORDER BY s.event_date DESC, s.event_id DESC) AS rn
      FROM fixture_sides f LEFT JOIN sides s ON s.side = f.side AND s.event_date < f.event_date)
    SELECT fixture_id, side, round(avg(qty_for), 6) AS last5_qty_for, round(avg(points), 6) AS last5_points FROM h WHERE rn <= 5 GROUP BY fixture_id, side""",
)
def asof_last5(spark, root):
    states = day_states(sides(spark, root), ["side"], last=[(5, "qty_for"), (5, "points")])
    probe = fixtures(spark, root).select("fixture_id", "event_date", F.explode(F.array("side_a", "side_b")).alias("side"))
    return asof(probe, states, ["side"], "event_date").select("fixture_id", "side", "last5_qty_for", "last5_points")


def _filtered(columns, condition, name):
    return ", ".join(f"round(avg({c}) FILTER ({condition}), 6) AS {name.format(c)}" for c in columns)


LAST = "same AND rn_season <= {}"
FIXTURE_SIDE_FEATURES = f"""{FIXTURES}, h AS (
  SELECT f.fixture_id, f.season, f.event_date, f.side, f.opponent, f.venue, f.official, s.event_id, s.event_date AS d, s.points, {", ".join("s." + c for c in COLS)},
    coalesce(s.season = f.season, false) AS same, coalesce(s.season = f.season AND s.venue = f.venue, false) AS same_venue, coalesce(s.opponent = f.opponent, false) AS met,
    row_number() OVER (PARTITION BY f.fixture_id, f.side ORDER BY s.event_date DESC, s.event_id DESC) AS rn,
    row_number() OVER (PARTITION BY f.fixture_id, f.side, s.season = f.season ORDER BY s.event_date DESC, s.event_id DESC) AS rn_season,
    row_number() OVER (PARTITION BY f.fixture_id, f.side, s.opponent = f.opponent ORDER BY s.event_date DESC, s.event_id DESC) AS rn_met
  FROM fixture_sides f LEFT JOIN sides s ON s.side = f.side AND s.event_date < f.event_date),
side_feats AS (
  SELECT fixture_id, season, event_date, side, opponent, venue, official,
    count(*) FILTER (same) AS matches_before, {_filtered(COLS, "same", "season_{}_avg")},
    {", ".join(_filtered(COLS, LAST.format(n), f"last{n}_{{}}_avg") for n in (3, 5, 10))},
    count(*) FILTER (same_venue) AS venue_matches_before, {_filtered(COLS, "same_venue", "venue_{}_avg")},
    count(event_id) AS career_matches_before, {_filtered([*COLS, "points"], "rn <= 5", "career_last5_{}_avg")},
    count(*) FILTER (met) AS h2h_matches_before, {_filtered(COLS, "met", "h2h_{}_avg_before")}, {_filtered(COLS, "met AND rn_met <= 3", "h2h_last3_{}_avg_before")},
    date_diff('day', max(d), event_date) AS days_rest
  FROM h GROUP BY fixture_id, season, event_date, side, opponent, venue, official)
"""
SIDE_FEATURE_NAMES = (
    ["matches_before"] + [f"season_{c}_avg" for c in COLS] + [f"last{n}_{c}_avg" for n in (3, 5, 10) for c in COLS]
    + ["venue_matches_before"] + [f"venue_{c}_avg" for c in COLS] + ["career_matches_before"]
    + [f"career_last5_{c}_avg" for c in [*COLS, "points"]] + ["h2h_matches_before"]
    + [f"h2h_{c}_avg_before" for c in COLS] + [f"h2h_last3_{c}_avg_before" for c in COLS] + ["days_rest"]
)
SIDE_KEYS = ["fixture_id", "season", "event_date", "side", "opponent", "venue", "official"]


@query(
    "A_20_fixture_features",
    FIXTURE_SIDE_FEATURES + f"""SELECT {", ".join("f." + c for c in SIDE_KEYS + SIDE_FEATURE_NAMES)}, {", ".join(f"o.{c} AS opp_{c}" for c in SIDE_FEATURE_NAMES)}
    FROM side_feats f JOIN side_feats o ON o.fixture_id = f.fixture_id AND o.side = f.opponent""",
)
def fixture_features(spark, root):
    c = fact(spark, root)
    rows = ft.fixture_features(c, fixtures_of(c), METRICS, RECENT_TOTALS)
    return rows.select(*SIDE_KEYS, *SIDE_FEATURE_NAMES, *[f"opp_{c}" for c in SIDE_FEATURE_NAMES])


OFFICIAL_FIXTURE = [f"{p}_{m}" for m in METRICS for p in ("a", "b", "total")]


@query(
    "A_20_fixture_official_league",
    FIXTURES + f""", oh AS (SELECT f.fixture_id, o.*, o.season = f.season AS same,
        row_number() OVER (PARTITION BY f.fixture_id ORDER BY o.event_date DESC, o.event_id DESC) AS rn,
        row_number() OVER (PARTITION BY f.fixture_id, o.season = f.season ORDER BY o.event_date DESC, o.event_id DESC) AS rn_season
      FROM fixtures f JOIN officials o ON o.official = f.official AND o.event_date < f.event_date),
    off AS (SELECT fixture_id, count(*) FILTER (same) AS official_matches_before, count(*) AS official_all_matches_before,
      {_filtered(OFFICIAL_FIXTURE, "same", "official_{}_avg_before")}, {", ".join(_filtered(["total_qty", "total_bulk"], f"same AND rn_season <= {n}", f"official_last{n}_{{}}_avg_before") for n in (5, 10))},
      {_filtered(OFFICIAL_FIXTURE, "true", "official_all_{}_avg_before")}, {_filtered(["total_qty", "total_bulk"], "rn <= 10", "official_all_last10_{}_avg_before")}
      FROM oh GROUP BY fixture_id),
    tot AS (SELECT *, {", ".join(f"a_{m} + b_{m} AS total_{m}" for m in METRICS)} FROM contests),
    lg AS (SELECT f.fixture_id, {_filtered(OFFICIAL_FIXTURE, "true", "league_{}_avg_before")} FROM fixtures f JOIN tot ON tot.season = f.season AND tot.event_date < f.event_date GROUP BY f.fixture_id),
    ord AS (SELECT *, row_number() OVER (ORDER BY event_date, event_id) AS rn FROM tot),
    before AS (SELECT f.fixture_id, max(rn) AS upto FROM fixtures f JOIN ord ON ord.event_date < f.event_date GROUP BY f.fixture_id),
    rec AS (SELECT fixture_id, {_filtered([f"total_{m}" for m in METRICS], "true", "recent20_league_{}_avg_before")} FROM before JOIN ord ON rn > upto - 20 AND rn <= upto GROUP BY fixture_id)
    SELECT f.fixture_id, coalesce(official_matches_before, 0) AS official_matches_before, coalesce(official_all_matches_before, 0) AS official_all_matches_before,
      off.* EXCLUDE (fixture_id, official_matches_before, official_all_matches_before), lg.* EXCLUDE (fixture_id), rec.* EXCLUDE (fixture_id)
    FROM fixtures f LEFT JOIN off USING (fixture_id) LEFT JOIN lg USING (fixture_id) LEFT JOIN rec USING (fixture_id)""",
)
def fixture_shared(spark, root):
    c = fact(spark, root)
    got = ft.fixture_shared(c, fixtures_of(c).drop("side_a", "side_b"), METRICS, RECENT_TOTALS)
    return got.drop("season", "event_date", "official")


@query(
    "J_06_bounded_history",
    """SELECT s.event_id, s.side, s.qty_for FROM sides s JOIN contests c USING (event_id)
    WHERE c.event_date < DATE '2000-01-15' AND c.season <= '1999-00' AND NOT (c.season = '1999-00' AND c.side_a = 'NATION_3' AND c.side_b = 'NATION_7')""",
)
def bounded(spark, root):
    c = contests(spark, root)
    kept = jn.bounded_history(c, F.lit("2000-01-15").cast("date"), "1999-00", "NATION_3", "NATION_7")
    return side_rows(c, METRICS).join(kept.select("event_id"), "event_id", "left_semi").select("event_id", "side", "qty_for")


@query(
    "J_07_append_only",
    """SELECT event_id, 'stored' AS origin FROM contests WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'new' FROM contests WHERE event_id % 3 = 0 AND event_id % 2 <> 0""",
)
def appended(spark, root):
    c = contests(spark, root).select("event_id")
    return jn.append_only(c.filter("event_id % 2 = 0").withColumn("origin", F.lit("stored")), c.filter("event_id % 3 = 0").withColumn("origin", F.lit("new")), "event_id")


@query(
    "J_08_completed_fixtures",
    """SELECT season, side_a, side_b, max(event_id) AS event_id, max(a_qty) AS a_qty, max(b_qty) AS b_qty FROM contests GROUP BY season, side_a, side_b HAVING count(*) = 1""",
)
def completed(spark, root):
    got = jn.completed_fixtures(sides(spark, root))
    return got.select("season", "side_a", "side_b", "event_id", F.col("h.qty_for").alias("a_qty"), F.col("a.qty_for").alias("b_qty"))


@query(
    "J_09_dictionary_lookup",
    "SELECT event_id, ra.r_name AS region_a, rb.r_name AS region_b FROM contests JOIN nation na ON na.n_name = side_a JOIN region ra ON ra.r_regionkey = na.n_regionkey JOIN nation nb ON nb.n_name = side_b JOIN region rb ON rb.r_regionkey = nb.n_regionkey",
)
def lookup(spark, root):
    regions = table(spark, root, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    names = table(spark, root, "nation").join(regions, "n_regionkey")
    pick = lambda s: names.select(F.col("n_name").alias(f"side_{s}"), F.col("r_name").alias(f"region_{s}"))
    return contests(spark, root).select("event_id", "side_a", "side_b").join(pick("a"), "side_a").join(pick("b"), "side_b").drop("side_a", "side_b")


COMPLETE = """, entrants AS (SELECT season, side_a AS side FROM contests UNION SELECT season, side_b FROM contests),
    n AS (SELECT season, count(*) AS sides FROM entrants GROUP BY season),
    expected AS (SELECT x.season, count(*) AS expected_pairs FROM entrants x JOIN entrants y ON y.season = x.season AND y.side <> x.side GROUP BY x.season),
    f AS (SELECT season, count(*) AS row_count, count(DISTINCT (side_a, side_b)) AS present_pairs FROM contests GROUP BY season)
    SELECT season, sides, row_count, expected_pairs, present_pairs, present_pairs = expected_pairs AND row_count = expected_pairs AS complete FROM f JOIN n USING (season) JOIN expected USING (season)"""


@query("J_10_expected_pairs", COMPLETE)
def pairs(spark, root):
    return jn.season_completeness(contests(spark, root))


@query("J_11_membership", "SELECT event_id, side FROM sides WHERE event_id IN (SELECT event_id FROM officials WHERE total_bulk >= 4)")
def members(spark, root):
    from twinside.plans.aggregates import officials

    return sides(spark, root).join(officials(spark, root).filter("total_bulk >= 4"), "event_id", "left_semi").select("event_id", "side")


@query(
    "J_12_rows_to_date",
    """, d AS (SELECT DISTINCT season, event_date FROM contests) SELECT d.season, d.event_date, count(*) AS rows_to_date
    FROM d JOIN contests c ON c.season = d.season AND c.event_date <= d.event_date GROUP BY d.season, d.event_date""",
)
def to_date(spark, root):
    states = day_states(contests(spark, root), ["season"], count="rows_to_date")
    return states


@query(
    "J_13_appointment_lookup",
    SCHEDULE + """, newest AS (SELECT season, match_round, side_a, side_b, arg_max(official, event_id) AS official FROM appointments GROUP BY ALL)
    SELECT s.event_id, n.official FROM schedule s LEFT JOIN newest n USING (season, match_round, side_a, side_b)""",
)
def appointed(spark, root):
    got = jn.appointment_lookup(schedule(spark, root).drop("official"), appointments(spark, root), "event_id")
    return got.select("event_id", "official")


@query(
    "J_14_prematch_context",
    SCHEDULE + """, once AS (SELECT season, event_date, side_a, side_b, min(kickoff_time) AS kickoff_time, min(match_round) AS match_round FROM schedule GROUP BY season, event_date, side_a, side_b HAVING count(*) = 1),
    named AS (SELECT season, match_round, side_a, side_b, count(*) AS k, min(official) AS o FROM appointments GROUP BY ALL)
    SELECT season, event_date, once.side_a, once.side_b, kickoff_time, once.match_round, CASE WHEN k = 1 THEN o END AS official
    FROM once LEFT JOIN named USING (season, match_round, side_a, side_b)
    WHERE timezone('UTC', timezone('Europe/London', event_date + CAST(kickoff_time || ':00' AS TIME))) > TIMESTAMP '2000-08-01 12:00:00'""",
)
def prematch(spark, root):
    now = F.lit("2000-08-01 12:00:00").cast("timestamp_ntz")
    return jn.prematch_context(schedule(spark, root), appointments(spark, root), now, ZONE)


@query("U_01_union_all", "SELECT event_id, official, NULL::VARCHAR AS side FROM contests UNION ALL SELECT event_id, NULL, side FROM sides")
def union_all(spark, root):
    return contests(spark, root).select("event_id", "official").unionByName(sides(spark, root).select("event_id", "side"), allowMissingColumns=True)


@query(
    "U_02_set_difference",
    """, x AS (SELECT DISTINCT side_a, side_b FROM contests WHERE season = '1999-00'), y AS (SELECT DISTINCT side_a, side_b FROM contests WHERE season = '1998-99')
    SELECT * FROM x EXCEPT SELECT * FROM y""",
)
def difference(spark, root):
    c = contests(spark, root)
    return qa.subset_gap(c.filter("season = '1999-00'"), c.filter("season = '1998-99'"), ["side_a", "side_b"])


@query("U_03_frame_equality", "SELECT 0::BIGINT AS only_left, count(*) FILTER (event_id % 100 = 0) AS only_right, count(*) FILTER (event_id % 100 = 0) = 0 AS equal FROM contests")
def equality(spark, root):
    s = schedule(spark, root).select("season", "event_id", "side_a", "side_b")
    return qa.same_set(s.filter("event_id % 100 <> 0"), s)


@query("U_04_distinct_rows", "SELECT DISTINCT season, side, opponent, result FROM sides")
def distinct_rows(spark, root):
    return sides(spark, root).select("season", "side", "opponent", "result").distinct()


@query("U_05_season_completeness", COMPLETE)
def completeness(spark, root):
    return jn.season_completeness(contests(spark, root))


@query(
    "U_06_schedule_rules",
    SCHEDULE + """, p AS (SELECT season, side_a, side_b, count(*) AS n FROM schedule GROUP BY ALL), q AS (SELECT season, CAST(sum(n) AS BIGINT) AS fixtures, max(n) AS copies FROM p GROUP BY season),
    r AS (SELECT season, match_round, count(*) AS n FROM schedule GROUP BY ALL), t AS (SELECT season, count(*) AS rounds, min(n) AS lo, max(n) AS hi FROM r GROUP BY season),
    e AS (SELECT season, count(DISTINCT s) AS sides FROM (SELECT season, unnest([side_a, side_b]) AS s FROM schedule) GROUP BY season)
    SELECT season, fixtures, array_to_string(list_filter([CASE WHEN fixtures <> 380 THEN 'fixture count' END, CASE WHEN copies > 1 THEN 'repeated pair' END,
      CASE WHEN rounds <> 38 OR lo <> 10 OR hi <> 10 THEN 'round sizes' END, CASE WHEN sides <> 20 THEN 'side count' END], lambda z: z IS NOT NULL), ',') AS violations
    FROM q JOIN t USING (season) JOIN e USING (season)""",
)
def schedule_rules(spark, root):
    return qa.schedule_violations(schedule(spark, root)).withColumn("violations", F.array_join("violations", ","))


BROKEN = """, broken AS (SELECT event_id, season, event_date, side, opponent, venue, qty_for, CASE WHEN event_id % 23 = 0 AND venue = 'A' THEN qty_against + 1 ELSE qty_against END AS qty_against
    FROM sides WHERE NOT (event_id % 17 = 0 AND venue = 'A')
    UNION ALL SELECT event_id, season, event_date, CASE WHEN event_id % 38 = 0 THEN 'X' ELSE side END, opponent, venue, qty_for, qty_against FROM sides WHERE event_id % 19 = 0 AND venue = 'H')
"""


def broken_sides(spark, root):
    s = sides(spark, root).select("event_id", "season", "event_date", "side", "opponent", "venue", "qty_for", "qty_against")
    kept = s.filter("NOT (event_id % 17 = 0 AND venue = 'A')").withColumn(
        "qty_against", F.expr("CASE WHEN event_id % 23 = 0 AND venue = 'A' THEN qty_against + 1 ELSE qty_against END")
    )
    extra = s.filter("event_id % 19 = 0 AND venue = 'H'").withColumn("side", F.expr("CASE WHEN event_id % 38 = 0 THEN 'X' ELSE side END"))
    return kept.unionByName(extra)


@query(
    "U_08_reciprocal_pairs",
    BROKEN + """SELECT event_id, CASE WHEN count(*) <> 2 OR count(*) FILTER (venue = 'H') <> 1 THEN 'not one H and one A row'
      WHEN max(qty_for) FILTER (venue = 'H') <> max(qty_against) FILTER (venue = 'A') THEN 'shared metrics differ' END AS reason FROM broken GROUP BY event_id""",
)
def reciprocal(spark, root):
    return qa.pair_verdicts(broken_sides(spark, root), [("qty_for", "qty_against")])


@query(
    "U_09_current_state",
    SCHEDULE + """, cur AS (SELECT * FROM sides WHERE season = (SELECT max(season) FROM sides) AND venue = 'H'),
    sched AS (SELECT DISTINCT unnest([side_a, side_b]) AS side FROM schedule WHERE season = (SELECT max(season) FROM sides)),
    v AS (SELECT (SELECT count(*) FROM sched) AS scheduled_sides, (SELECT count(*) FROM (SELECT DISTINCT side FROM cur WHERE side NOT IN (SELECT side FROM sched))) AS sides_outside,
      (SELECT count(*) FROM (SELECT side, opponent FROM cur GROUP BY ALL HAVING count(*) > 1)) AS repeated_fixtures)
    SELECT *, scheduled_sides = 20 AND sides_outside = 0 AND repeated_fixtures = 0 AS ok FROM v""",
)
def state(spark, root):
    return qa.current_state(sides(spark, root), schedule(spark, root))


@query(
    "U_10_snapshot_gate",
    SCHEDULE + """, fx AS (SELECT *, event_date < DATE '1999-01-01' AS played, event_date + CAST(kickoff_time || ':00' AS TIME) AS loc FROM schedule),
    tz AS (SELECT *, timezone('UTC', timezone('Europe/London', loc)) AS utc FROM fx),
    pr AS (SELECT season, match_round, side_a, side_b, count(*) AS n, bool_or(played) AS played, min(utc) AS kickoff,
      count(*) FILTER (timezone('Europe/London', timezone('UTC', utc)) <> loc OR timezone('Europe/London', timezone('UTC', utc + INTERVAL 1 HOUR)) = loc OR timezone('Europe/London', timezone('UTC', utc - INTERVAL 1 HOUR)) = loc) AS bad FROM tz GROUP BY ALL),
    ap AS (SELECT season, match_round, side_a, side_b, count(*) AS k FROM appointments GROUP BY ALL),
    apr AS (SELECT season, match_round, count(*) AS total FROM appointments GROUP BY ALL),
    rd AS (SELECT season, match_round, CAST(sum(n) AS BIGINT) AS fixtures, count(*) AS pairs, sum(bad) AS bad, bool_or(played) AS played, min(kickoff) AS kickoff, count(*) FILTER (k = 1) AS appointed
      FROM pr LEFT JOIN ap USING (season, match_round, side_a, side_b) GROUP BY ALL)
    SELECT season, match_round, fixtures, appointed, CASE WHEN fixtures <> 40 OR pairs <> 40 THEN 'invalid fixture identities'
      WHEN season = '1999-00' AND match_round % 2 = 0 THEN 'round already archived' WHEN bad > 0 THEN 'kickoff cannot be verified'
      WHEN played OR TIMESTAMP '1999-01-01 00:00:00' >= kickoff THEN 'kickoff reached or already played' WHEN appointed <> 40 OR coalesce(total, 0) <> 40 THEN 'officials incomplete' END AS reason
    FROM rd LEFT JOIN apr USING (season, match_round)""",
)
def gate(spark, root):
    s = schedule(spark, root)
    archive = s.filter("season = '1999-00' AND match_round % 2 = 0").select("season", "match_round")
    now = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    played = s.withColumn("played", F.col("event_date") < "1999-01-01").drop("official")
    return qa.snapshot_gate(played, archive, appointments(spark, root), now, ZONE, expected=40)


APPOINT = SCHEDULE + """, cand AS (SELECT season, match_round, side_a, side_b, event_id, CASE WHEN event_id % 13 = 0 THEN 'TBC' ELSE official END AS official FROM appointments),
    uniq AS (SELECT season, match_round, side_a, side_b, max(event_id) AS event_id, max(official) AS official FROM cand GROUP BY season, match_round, side_a, side_b HAVING count(*) = 1),
    ok AS (SELECT season, match_round, side_a, side_b, event_id, 'R ' || substr(official, 5) AS official FROM uniq WHERE official <> 'TBC')
"""


def clean_appointments(spark, root):
    rows = appointments(spark, root).withColumn("official", F.expr("CASE WHEN event_id % 13 = 0 THEN 'TBC' ELSE official END"))
    return qa.valid_appointments(rows, schedule(spark, root), NAMES)


@query("U_11_valid_appointments", APPOINT + "SELECT event_id, official FROM ok")
def appointment_rules(spark, root):
    return clean_appointments(spark, root).select("event_id", "official")


@query(
    "U_11_appointment_merge",
    APPOINT + """, live AS (SELECT season, match_round, side_a, side_b, official FROM ok WHERE event_id % 2 = 0), ver AS (SELECT season, match_round, side_a, side_b, official FROM ok WHERE event_id % 3 = 0),
    cache AS (SELECT season, match_round, side_a, side_b, CASE WHEN event_id % 500 = 0 THEN 'R Z' ELSE official END AS official FROM ok WHERE event_id % 5 = 0),
    m AS (SELECT season, match_round, side_a, side_b, live.official AS l, ver.official AS v, cache.official AS c FROM live FULL JOIN ver USING (season, match_round, side_a, side_b) FULL JOIN cache USING (season, match_round, side_a, side_b)),
    j AS (SELECT *, coalesce(coalesce(l, v) <> c, false) OR coalesce(l <> v, false) AS conflict FROM m),
    fz AS (SELECT season, match_round, bool_or(conflict) AS frozen FROM j GROUP BY season, match_round)
    SELECT season, match_round, side_a, side_b, coalesce(c, l, v) AS official, conflict, NOT frozen OR c IS NOT NULL AS kept FROM j JOIN fz USING (season, match_round)""",
)
def appointment_merge(spark, root):
    ok = clean_appointments(spark, root)
    cache = ok.filter("event_id % 5 = 0").withColumn("official", F.expr("CASE WHEN event_id % 500 = 0 THEN 'R Z' ELSE official END"))
    return qa.merge_appointments(ok.filter("event_id % 2 = 0"), ok.filter("event_id % 3 = 0"), cache)


@query("U_13_blank_identities", """SELECT 'side_a' AS column_name, 0::BIGINT AS blanks UNION ALL SELECT 'official', count(*) FILTER (official IS NULL) FROM contests
    UNION ALL SELECT 'event_id', 0::BIGINT""")
def identities(spark, root):
    c = qa.require_columns(contests(spark, root), ["side_a", "official", "event_id"], "contests")
    return qa.blank_identities(c, ["side_a", "official", "event_id"])


@query(
    "U_14_round_slice",
    SCHEDULE + """, p AS (SELECT season, match_round, side_a, side_b, count(*) AS n FROM schedule GROUP BY ALL)
    SELECT season, match_round, CAST(sum(n) AS BIGINT) AS fixtures, count(*) AS unique_fixtures, sum(n) = 10 AND count(*) = 10 AS ok FROM p GROUP BY season, match_round""",
)
def slices(spark, root):
    return qa.round_slice(schedule(spark, root), NAMES)


@query("U_15_rollback_guard", "SELECT count(*) AS local_rows, 0::BIGINT AS remote_rows, count(*) > 0 AS rollback FROM contests")
def rollback(spark, root):
    c = contests(spark, root)
    return qa.rollback_guard(c, c.filter("side_a = side_b"))


@query(
    "U_13_planted_blanks",
    """SELECT 'side_a' AS column_name, count(*) FILTER (event_id % 9 = 0 OR event_id % 10 = 0) AS blanks FROM contests UNION ALL SELECT 'official', count(*) FILTER (official IS NULL OR event_id % 7 = 0) FROM contests
    UNION ALL SELECT 'event_id', count(*) FILTER (event_id % 23 = 0) FROM contests""",
)
def planted_blanks(spark, root):
    """Blank identities with empty names, names of blanks and missing ids in the table."""
    hit, c = (lambda n: F.col("event_id") % n == 0), contests(spark, root)
    changes = {
        "side_a": F.when(hit(9), "").when(hit(10), "  ").otherwise(F.col("side_a")), "official": F.when(~hit(7), F.col("official")),
        "event_id": F.when(~hit(23), F.col("event_id")),
    }
    return qa.blank_identities(c.withColumns(changes), ["side_a", "official", "event_id"])


@query(
    "U_15_guarded_copies",
    """, n AS (SELECT count(*) AS whole, count(*) FILTER (event_id % 2 = 0) AS half FROM contests)
    SELECT 'same' AS remote, whole AS local_rows, whole AS remote_rows, FALSE AS rollback FROM n UNION ALL SELECT 'half', whole, half, FALSE FROM n
    UNION ALL SELECT 'empty', whole, 0, whole > 0 FROM n UNION ALL SELECT 'both empty', 0, 0, FALSE FROM n""",
)
def guarded_copies(spark, root):
    """The guard on a copy that is whole, a part, empty, and on two empty ones."""
    c = contests(spark, root)
    none = c.filter("side_a = side_b")
    cases = {"same": (c, c), "half": (c, c.filter("event_id % 2 = 0")), "empty": (c, none), "both empty": (none, none)}
    parts = [qa.rollback_guard(a, b).select(F.lit(n).alias("remote"), "*") for n, (a, b) in cases.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("U_16_pair_keys", "SELECT DISTINCT season, side_a, side_b FROM contests")
def pair_keys(spark, root):
    return contests(spark, root).select("season", "side_a", "side_b").distinct()


@query(
    "W_21_repeated_flags",
    "SELECT event_id, count(*) OVER (PARTITION BY season, side_a, side_b) > 1 AS repeated FROM contests",
)
def flags(spark, root):
    return jn.flag_copies(contests(spark, root), ["season", "side_a", "side_b"]).select("event_id", "repeated")


@query(
    "A_17_quality_report",
    """, made AS (SELECT event_id, side, CASE WHEN event_id % 17 <> 0 THEN qty_for END AS target_qty FROM sides WHERE event_id % 19 <> 0), broken AS (SELECT * FROM made UNION ALL SELECT * FROM made WHERE event_id % 23 = 0),
    x AS (SELECT (SELECT count(*) FROM contests) AS n, (SELECT count(*) FROM sides) AS s, (SELECT count(*) FROM sides WHERE official IS NULL) AS o, (SELECT count(*) FROM broken WHERE target_qty IS NULL) AS t, (SELECT count(*) FROM broken) AS f, (SELECT count(*) - count(DISTINCT (event_id, side)) FROM broken) AS r)
    SELECT 'contests' AS check_name, n::DOUBLE AS value, CASE WHEN n > 0 THEN 'OK' ELSE 'WARN' END AS status FROM x
    UNION ALL SELECT 'side_rows', s, CASE WHEN s = 2 * n THEN 'OK' ELSE 'WARN' END FROM x UNION ALL SELECT 'repeated_event_ids', 0, 'OK' FROM x UNION ALL SELECT 'repeated_side_rows', r, CASE WHEN r = 0 THEN 'OK' ELSE 'WARN' END FROM x
    UNION ALL SELECT 'missing_officials', o, CASE WHEN o = 0 THEN 'OK' ELSE 'WARN' END FROM x UNION ALL SELECT 'missing_targets', t, CASE WHEN t = 0 THEN 'OK' ELSE 'WARN' END FROM x
    UNION ALL SELECT 'feature_rows', f, CASE WHEN f = 2 * n THEN 'OK' ELSE 'WARN' END FROM x""",
)
def report(spark, root):
    c = contests(spark, root)
    rows = side_rows(c, METRICS)
    # A feature table with lost rows, copies and lost targets.
    made = rows.filter("event_id % 19 <> 0").select("event_id", "side", F.when(F.col("event_id") % 17 != 0, F.col("qty_for")).alias("target_qty"))
    return qa.quality_report(c, rows, made.unionByName(made.filter("event_id % 23 = 0")), "target_qty")


@query(
    "A_30_coverage_report",
    SCHEDULE + """SELECT s.season, count(*) AS expected, count(a.event_id) AS found, count(*) - count(a.event_id) AS missing FROM schedule s LEFT JOIN appointments a USING (event_id) GROUP BY s.season""",
)
def coverage(spark, root):
    return qa.coverage(schedule(spark, root), appointments(spark, root), ["event_id"], "season")


@query(
    "T_01_stable_order",
    """, x AS (SELECT event_id, row_number() OVER (PARTITION BY season ORDER BY a_qty DESC NULLS LAST, event_date, kickoff_time, event_id) AS place FROM contests) SELECT * FROM x""",
)
def ordered(spark, root):
    order = ["event_date", "kickoff_time", "event_id"]
    return rank_rows(contests(spark, root), ["season"], "a_qty", order).select("event_id", "place")


@query(
    "T_04_tail_rows",
    """, x AS (SELECT season, side, event_id, qty_for, row_number() OVER (PARTITION BY season, side ORDER BY event_date DESC, event_id DESC) AS back FROM sides) SELECT * FROM x WHERE back <= 10""",
)
def tails(spark, root):
    return tail_rows(sides(spark, root), ["season", "side"], 10).select("season", "side", "event_id", "qty_for", "back")
