"""Queries P-*: scalar derivations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinside.functions import calendar as cal, numbers as num, text as tx
from twinside.operators.sides import official_rows, side_rows
from twinside.operators.views import official_impact, official_label
from twinside.operators.aggregates import league_season
from twinside.plans.aggregates import COLS, PARTS, officials, sides
from twinside.plans.base import query
from twinside.plans.sources import NAMES, RAW, ZONE, raw_feed, _name
from twinside.sources.tables import METRICS, contests, table


@query("P_01_canonical_name", RAW + f"SELECT event_id, {_name('HomeTeam')} AS side_a, {_name('AwayTeam')} AS side_b FROM raw")
def canonical(spark, root):
    raw = raw_feed(spark, root)
    return raw.select("event_id", tx.canonical_name(F.col("HomeTeam"), NAMES).alias("side_a"), tx.canonical_name(F.col("AwayTeam"), NAMES).alias("side_b"))


PEOPLE = """WITH people AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' (Pictured)' WHEN 1 THEN '  ' || replace(p_name, ' ', '   ')
    WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 3 THEN upper(substr(p_name, 1, 1)) || '. ' || p_name WHEN 4 THEN 'tbd ' || p_name ELSE p_name END AS name FROM part)
"""


def people(spark, root):
    name, k = F.col("p_name"), F.col("p_partkey") % 6
    made = (
        F.when(k == 0, F.concat(name, F.lit(" (Pictured)")))
        .when(k == 1, F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit("   "))))
        .when(k == 2, F.split_part(name, F.lit(" "), F.lit(1)))
        .when(k == 3, F.concat(F.upper(F.substring(name, 1, 1)), F.lit(". "), name))
        .when(k == 4, F.concat(F.lit("tbd "), name))
        .otherwise(name)
    )
    return table(spark, root, "part").select("p_partkey", made.alias("name"))


@query(
    "P_02_person_name",
    PEOPLE + r""", clean AS (SELECT p_partkey, regexp_replace(trim(regexp_replace(name, '(?i)\s*\(pictured\)\s*', '', 'g')), '\s+', ' ', 'g') AS n FROM people)
    SELECT p_partkey, CASE WHEN n NOT LIKE '% %' THEN n ELSE upper(substr(replace(split_part(n, ' ', 1), '.', ''), 1, 1)) || substr(n, strpos(n, ' ')) END AS person FROM clean""",
    raw=True,
)
def person(spark, root):
    return people(spark, root).select("p_partkey", tx.person_name(F.col("name")).alias("person"))


@query("P_03_short_name", "SELECT event_id, CASE side_a WHEN 'NATION_1' THEN 'N1' WHEN 'NATION_10' THEN 'N10' ELSE side_a END AS short FROM contests")
def short(spark, root):
    return contests(spark, root).select("event_id", tx.short_name(F.col("side_a"), {"NATION_1": "N1", "NATION_10": "N10"}).alias("short"))


@query(
    "P_04_text_id",
    """SELECT event_id, substr(sha1(season || '|' || CAST(event_date AS VARCHAR) || '|' || side_a || '|' || side_b), 1, 20) AS match_id,
    substr(sha1(season || '|' || coalesce(official, 'None')), 1, 20) AS other_id FROM contests""",
)
def ids(spark, root):
    pick = lambda *cs: tx.text_id([F.col(c) for c in cs])
    return contests(spark, root).select("event_id", pick("season", "event_date", "side_a", "side_b").alias("match_id"), pick("season", "official").alias("other_id"))


@query(
    "P_05_numbers_and_sums",
    RAW + """SELECT event_id, try_cast(HF AS DOUBLE) AS hf, CASE WHEN try_cast(HF AS DOUBLE) IS NOT NULL OR try_cast(AF AS DOUBLE) IS NOT NULL
      THEN coalesce(try_cast(HF AS DOUBLE), 0) + coalesce(try_cast(AF AS DOUBLE), 0) END AS total FROM raw""",
)
def numbers(spark, root):
    hf, af = num.to_number(F.col("HF")), num.to_number(F.col("AF"))
    return raw_feed(spark, root).select("event_id", hf.alias("hf"), num.null_safe_sum(hf, af).alias("total"))


@query(
    "P_06_result_points",
    """SELECT event_id, CASE WHEN a_qty > b_qty THEN 'W' WHEN a_qty < b_qty THEN 'L' WHEN a_qty = b_qty THEN 'D' END AS result,
    CAST(CASE WHEN a_qty > b_qty THEN 3 WHEN a_qty < b_qty THEN 0 WHEN a_qty = b_qty THEN 1 END AS BIGINT) AS points FROM contests""",
)
def result_points(spark, root):
    a, b = F.col("a_qty"), F.col("b_qty")
    return contests(spark, root).select("event_id", num.outcome(a, b).alias("result"), num.outcome_points(a, b).alias("points"))


SIDE_COLS = ["event_id", "season", "event_date", "kickoff_time", "official", "side", "opponent", "venue", *COLS, "result", "points"]


@query("P_07_side_rows", f"SELECT {', '.join(SIDE_COLS)} FROM sides")
def side(spark, root):
    return side_rows(contests(spark, root), METRICS)


OFFICIAL_COLS = ["event_id", "season", "event_date", "official", "side_a", "side_b", *PARTS]


@query("P_09_official_rows", f"SELECT {', '.join(OFFICIAL_COLS)} FROM officials")
def official(spark, root):
    return official_rows(contests(spark, root), METRICS)


@query(
    "P_10_weekday",
    """SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN dayname(event_date) END AS weekday FROM contests""",
)
def weekday(spark, root):
    text = F.when(F.col("event_id") % 9 == 0, F.date_format("event_date", "yyyy/MM/dd")).otherwise(F.col("event_date").cast("string"))
    return contests(spark, root).select("event_id", cal.weekday(cal.iso_date(text)).alias("weekday"))


@query(
    "P_11_daypart",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN kickoff_time < '15:00' THEN 'early' WHEN kickoff_time < '17:30' THEN 'afternoon' ELSE 'late' END AS daypart FROM contests""",
)
def daypart(spark, root):
    clock = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("2"), F.col("kickoff_time"))).otherwise(F.col("kickoff_time"))
    return contests(spark, root).select("event_id", cal.daypart(clock).alias("daypart"))


@query(
    "P_12_valid_count",
    RAW + """, x AS (SELECT event_id, try_cast(HF AS DOUBLE) AS a, try_cast(HC AS DOUBLE) AS b FROM raw)
    SELECT event_id, CASE WHEN a >= 0 AND a = floor(a) THEN a END AS hf, CASE WHEN b >= 0 AND b = floor(b) THEN b END AS hc FROM x""",
)
def valid(spark, root):
    return raw_feed(spark, root).select("event_id", num.valid_count(F.col("HF")).alias("hf"), num.valid_count(F.col("HC")).alias("hc"))


@query(
    "P_13_sample_class",
    """SELECT season, side, opponent, count(*) AS n, CASE WHEN count(*) < 3 THEN 'insufficient' WHEN count(*) < 5 THEN 'very_small'
    WHEN count(*) < 8 THEN 'small' ELSE 'usable' END AS sample_class FROM sides GROUP BY ALL""",
)
def sample(spark, root):
    return sides(spark, root).groupBy("season", "side", "opponent").agg(F.count("*").alias("n")).withColumn("sample_class", num.sample_class(F.col("n")))


@query("P_14_season_start", "SELECT DISTINCT season, CAST(substr(season, 1, 4) AS BIGINT) AS start_year FROM contests")
def season_start(spark, root):
    return contests(spark, root).select("season").distinct().withColumn("start_year", cal.season_start(F.col("season")))


@query(
    "P_15_season_of_date",
    "SELECT event_id, year(event_date - INTERVAL 6 MONTH) AS start_year FROM contests",
)
def season_of(spark, root):
    return contests(spark, root).select("event_id", cal.season_start_of(F.col("event_date")).alias("start_year"))


@query(
    "P_16_zone_conversion",
    """, t AS (SELECT event_id, event_date + CAST(kickoff_time || ':00' AS TIME) AS local FROM contests),
    u AS (SELECT *, timezone('UTC', timezone('Europe/London', local)) AS utc FROM t),
    p AS (SELECT *, CASE WHEN timezone('Europe/London', timezone('UTC', utc)) <> local THEN 'nonexistent'
      WHEN timezone('Europe/London', timezone('UTC', utc + INTERVAL 1 HOUR)) = local OR timezone('Europe/London', timezone('UTC', utc - INTERVAL 1 HOUR)) = local THEN 'ambiguous' END AS problem FROM u)
    SELECT event_id, CASE WHEN problem IS NULL THEN strftime(utc, '%Y-%m-%d %H:%M') END AS utc, problem FROM p""",
)
def zones(spark, root):
    local = F.concat(F.col("event_date").cast("string"), F.lit(" "), F.col("kickoff_time")).cast("timestamp_ntz")
    problem = cal.wall_time_problem(local, ZONE)
    utc = F.when(problem.isNull(), F.date_format(cal.local_to_utc(local, ZONE), "yyyy-MM-dd HH:mm"))
    return contests(spark, root).select("event_id", utc.alias("utc"), problem.alias("problem"))


@query("P_17_half_line", "SELECT event_id, side, greatest(0.5::DOUBLE, ceil(qty_for / 7) - 0.5) AS test_line FROM sides WHERE qty_for IS NOT NULL")
def half_line(spark, root):
    return sides(spark, root).filter("qty_for IS NOT NULL").select("event_id", "side", num.half_line_below(F.col("qty_for") / 7).alias("test_line"))


@query(
    "P_18_valid_person",
    PEOPLE + r"""SELECT p_partkey, regexp_matches(trim(name), '^[.''’\-]*\p{L}[\p{L}.''’\-]*(\s+[.''’\-]*\p{L}[\p{L}.''’\-]*)+$') AND NOT regexp_matches(lower(name), '\btbd\b') AS valid FROM people""",
    raw=True,
)
def valid_person(spark, root):
    return people(spark, root).select("p_partkey", tx.is_person(F.col("name")).alias("valid"))


@query("P_19_reversed_score", "SELECT event_id, CAST(b_score AS VARCHAR) || ':' || CAST(a_score AS VARCHAR) AS away_view FROM contests")
def reversed_score(spark, root):
    score = F.concat_ws(":", "a_score", "b_score")
    return contests(spark, root).select("event_id", tx.reversed_score(score).alias("away_view"))


@query(
    "P_20_last_seasons",
    """, s AS (SELECT DISTINCT season, CAST(substr(season, 1, 4) AS BIGINT) AS y FROM contests)
    SELECT season, y AS season_key, season || ',' || (y - 1)::VARCHAR || '-' || lpad((y % 100)::VARCHAR, 2, '0') || ',' || (y - 2)::VARCHAR || '-' || lpad(((y - 1) % 100)::VARCHAR, 2, '0') AS last_three FROM s""",
)
def last_seasons(spark, root):
    s = contests(spark, root).select("season").distinct()
    return s.select("season", cal.season_key(F.col("season")).alias("season_key"), F.array_join(cal.last_seasons(F.col("season")), ",").alias("last_three"))


@query(
    "P_21_actual_sides",
    "SELECT s.event_id, s.side, c.side_a, c.side_b, c.a_score || ':' || c.b_score AS score FROM sides s JOIN contests c USING (event_id)",
)
def actual_sides(spark, root):
    from twinside.operators.views import actual_context

    rows = sides(spark, root).withColumn("score", F.concat_ws(":", "score_for", "score_against"))
    return actual_context(rows).select("event_id", "side", "side_a", "side_b", "score")


@query("P_22_filtered_observations", "SELECT event_id, side, qty_for FROM sides WHERE season = '1998-99' AND venue = 'A'")
def filtered(spark, root):
    return sides(spark, root).filter("season = '1998-99' AND venue = 'A'").select("event_id", "side", "qty_for")


IMPACT = """, own AS (SELECT season, official, count(DISTINCT event_id) AS matches, avg(total_qty) AS q, avg(total_bulk) AS b FROM officials GROUP BY season, official),
    lg AS (SELECT season, avg(a_qty + b_qty) AS q, avg(a_bulk + b_bulk) AS b FROM contests GROUP BY season),
    ranked AS (SELECT *, row_number() OVER (ORDER BY season DESC) AS back FROM lg),
    parts AS (SELECT official, own.season, CASE back WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS w, matches, own.q / r.q AS cq, own.b / r.b AS cb
      FROM own JOIN ranked r USING (season) WHERE back <= 3),
    impact AS (SELECT official, sum(cq * w) / sum(CASE WHEN cq IS NOT NULL THEN w END) AS qty_coeff, sum(cb * w) / sum(CASE WHEN cb IS NOT NULL THEN w END) AS bulk_coeff,
      count(*) AS seasons_used, string_agg(season || '=' || matches::VARCHAR, ',' ORDER BY season DESC) AS seasons FROM parts GROUP BY official)
"""


def impacts(spark, root):
    c = contests(spark, root)
    return official_impact(official_rows(c, METRICS), league_season(c, METRICS), ["qty", "bulk"])


@query(
    "A_21_official_impact",
    IMPACT + """SELECT official, round(qty_coeff, 6) AS qty_coeff, round(bulk_coeff, 6) AS bulk_coeff, seasons_used, seasons,
      round((qty_coeff - 1) * (SELECT q FROM ranked WHERE back = 1), 6) AS qty_impact, round((bulk_coeff - 1) * (SELECT b FROM ranked WHERE back = 1), 6) AS bulk_impact FROM impact""",
)
def impact(spark, root):
    pairs = F.transform("season_detail", lambda d: F.concat_ws("=", d["season"], d["matches"]))
    return impacts(spark, root).select(
        "official", "qty_coeff", "bulk_coeff", "seasons_used", F.array_join(pairs, ",").alias("seasons"), "qty_impact", "bulk_impact"
    )


@query(
    "P_23_official_label",
    IMPACT + """SELECT c.event_id, CASE WHEN c.official IS NULL THEN '' WHEN i.official IS NULL THEN c.official ELSE c.official
      || ' · qty ' || printf('%+.1f', (qty_coeff - 1) * (SELECT q FROM ranked WHERE back = 1))
      || ' · bulk ' || printf('%+.1f', (bulk_coeff - 1) * (SELECT b FROM ranked WHERE back = 1)) END AS label
    FROM contests c LEFT JOIN impact i USING (official)""",
)
def label(spark, root):
    names = contests(spark, root).select("event_id", "official")
    return official_label(names, impacts(spark, root), ["qty", "bulk"]).select("event_id", "label")
