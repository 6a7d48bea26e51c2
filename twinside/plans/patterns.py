"""Queries Q-*: pattern mining and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinside.functions.calendar import daypart, weekday
from twinside.operators import patterns as pt
from twinside.operators.sides import side_rows
from twinside.plans.base import kept, query, shared
from twinside.plans.gates import BROKEN, FIXTURE_DAY, broken_sides
from twinside.sources.tables import METRICS, contests

PM = ("qty", "lines", "bulk")
KEY = ", ".join(pt.KEY)
PART = "CASE WHEN kickoff_time < '15:00' THEN 'early' WHEN kickoff_time < '17:30' THEN 'afternoon' ELSE 'late' END"
FRAMES = f""", frames AS (
  SELECT 'side' AS kind, event_id, season, event_date, side AS entity, venue, dayname(event_date) AS weekday, {PART} AS daypart,
    {", ".join(f"CAST({m}_for AS DOUBLE) AS x_{m}" for m in PM)}, CASE venue WHEN 'H' THEN side ELSE opponent END AS side_a, CASE venue WHEN 'H' THEN opponent ELSE side END AS side_b FROM sides
  UNION ALL SELECT 'official', event_id, season, event_date, official, '', dayname(event_date), {PART}, {", ".join(f"CAST(a_{m} + b_{m} AS DOUBLE)" for m in PM)}, side_a, side_b
  FROM contests WHERE official IS NOT NULL)
"""
TALL = FRAMES + ", tall AS (" + " UNION ALL ".join(
    f"SELECT kind, event_id, season, event_date, entity, venue, side_a, side_b, '{f}' AS factor, {f} AS category, '{m}' AS metric, x_{m} AS x FROM frames"
    for f in ("weekday", "daypart") for m in PM
) + ")"


def effect_sql(cells: str, keys: str = "") -> str:
    """CTEs from (ng, nb, mg, mb, vg, vb, rows) cells to the season-pattern columns."""
    return f""", eff AS (SELECT {keys} season, kind || '_' || factor AS pattern_type, entity, venue, CASE factor WHEN 'weekday' THEN category ELSE '' END AS weekday,
      CASE factor WHEN 'daypart' THEN category ELSE '' END AS daypart, metric, ng AS n_group, nb AS n_baseline, mg AS group_mean, mb AS baseline_mean,
      CASE WHEN ng > 0 AND nb > 0 THEN mg - mb END AS effect, CASE WHEN ng > 0 AND nb > 0 AND mb <> 0 THEN (mg - mb) / mb END AS relative_effect,
      CASE WHEN ng < 3 THEN 'insufficient' WHEN ng < 5 THEN 'very_small' WHEN ng < 8 THEN 'small' ELSE 'usable' END AS sample_class, ng > 0 AND nb > 0 AS evaluable, n_rows < 3 AS sparse_identity,
      CASE WHEN ng < 2 OR nb < 2 THEN 'insufficient_n' WHEN vg = 0 OR vb = 0 THEN 'zero_variance' ELSE 'available' END AS uncertainty_status,
      CASE WHEN ng >= 2 AND nb >= 2 AND vg > 0 AND vb > 0 THEN sqrt(vg / ng + vb / nb) END AS effect_se,
      CASE WHEN ng > 0 AND nb > 0 THEN ng * nb / (ng + nb) END AS effective_n FROM {cells}),
    pats AS (SELECT *, effect - 1.96 * effect_se AS ci_low, effect + 1.96 * effect_se AS ci_high, effective_n / (effective_n + 5) AS reliability_weight,
      effect * (effective_n / (effective_n + 5)) AS shrunk_effect, n_group >= 5 AND n_baseline > 0 AND effect IS NOT NULL AS ok, CAST(substr(season, 1, 4) AS BIGINT) AS y FROM eff)
"""


SEASONAL = TALL + """, ctx AS (SELECT kind, season, entity, venue, count(DISTINCT event_id) AS n_rows FROM frames GROUP BY ALL),
    cats AS (SELECT DISTINCT kind, season, entity, venue, factor, category FROM tall),
    cells AS (SELECT c.*, t.metric, n_rows, count(x) FILTER (t.category = c.category) AS ng, count(x) FILTER (t.category <> c.category) AS nb,
      avg(x) FILTER (t.category = c.category) AS mg, avg(x) FILTER (t.category <> c.category) AS mb, var_samp(x) FILTER (t.category = c.category) AS vg, var_samp(x) FILTER (t.category <> c.category) AS vb
      FROM cats c JOIN tall t USING (kind, season, entity, venue, factor) JOIN ctx USING (kind, season, entity, venue) GROUP BY ALL)
""" + effect_sql("cells")


def summaries(keys: str = "") -> str:
    part = keys + KEY
    return f""", stab AS (SELECT {part}, count(*) FILTER (ok) AS eligible_seasons, count(*) FILTER (ok AND effect > 0) AS positive_seasons,
      count(*) FILTER (ok AND effect < 0) AS negative_seasons, count(*) FILTER (ok AND effect = 0) AS neutral_seasons FROM pats GROUP BY {part}),
    stability AS (SELECT *, CASE WHEN eligible_seasons = 0 THEN 'insufficient' WHEN positive_seasons = eligible_seasons THEN 'up' WHEN negative_seasons = eligible_seasons THEN 'down'
      WHEN neutral_seasons = eligible_seasons THEN 'neutral' ELSE 'mixed' END AS direction,
      CASE WHEN eligible_seasons > 0 THEN greatest(positive_seasons, negative_seasons, neutral_seasons) / eligible_seasons END AS direction_consistency FROM stab),
    hist AS (SELECT {", ".join("t." + k.strip() for k in part.split(","))}, t.season AS target_season, t.n_group AS target_n_group, t.n_baseline AS target_n_baseline, t.effect AS target_effect,
      t.relative_effect AS target_relative_effect, t.ok AS target_ok, count(h.season) AS n, count(*) FILTER (h.effect > 0) AS up, count(*) FILTER (h.effect < 0) AS down,
      coalesce(string_agg(h.season, ',' ORDER BY h.season), '') AS used
      FROM pats t LEFT JOIN pats h ON {" AND ".join(f"h.{k.strip()} = t.{k.strip()}" for k in part.split(","))} AND h.y < t.y AND h.ok GROUP BY ALL),
    expect AS (SELECT *, CASE WHEN n >= 2 THEN CASE WHEN up = n THEN 'up' WHEN down = n THEN 'down' ELSE 'mixed' END END AS expected_direction FROM hist),
    wf AS (SELECT *, CASE WHEN n < 2 THEN 'not_testable' WHEN NOT target_ok THEN 'pending' WHEN expected_direction = 'mixed' THEN 'mixed' WHEN target_effect = 0 THEN 'neutral'
      WHEN (target_effect > 0) = (expected_direction = 'up') THEN 'hit' ELSE 'miss' END AS validation_result FROM expect),
    oos AS (SELECT {part}, count(*) FILTER (expected_direction IN ('up', 'down') AND validation_result IN ('hit', 'miss', 'neutral')) AS oos_tests,
      count(*) FILTER (validation_result = 'hit') AS oos_hits, count(*) FILTER (validation_result = 'miss') AS oos_misses, count(*) FILTER (validation_result = 'neutral') AS oos_neutral FROM wf GROUP BY {part})
"""


def tables(spark, root):
    c = shared(spark, root, "contests", lambda: contests(spark, root))
    return kept(spark, root, "analysis", lambda: pt.analyze(c, side_rows(c, METRICS), PM))


@query(
    "Q_01_prepared_sides",
    f"SELECT event_id, side AS entity, venue, season, dayname(event_date) AS weekday, {PART} AS daypart, {', '.join(f'CAST({m}_for AS DOUBLE) AS x_{m}' for m in PM)} FROM sides",
)
def prepared(spark, root):
    c = contests(spark, root)
    return pt.prepare(c, side_rows(c, METRICS), PM)[0].drop("event_date")


@query(
    "Q_01_prepared_gate",
    BROKEN + f"""SELECT b.event_id, b.side AS entity, b.venue, b.season, dayname(b.event_date) AS weekday, {PART} AS daypart, CAST(b.qty_for AS DOUBLE) AS x_qty
    FROM broken b JOIN contests c USING (event_id) WHERE event_id % 17 <> 0 AND event_id % 19 <> 0""",
)
def prepared_gate(spark, root):
    return pt.prepare(contests(spark, root), broken_sides(spark, root), ["qty"])[0].drop("event_date")


@query(
    "Q_01_prepared_officials",
    f"SELECT event_id, official AS entity, season, dayname(event_date) AS weekday, {PART} AS daypart, {', '.join(f'CAST(a_{m} + b_{m} AS DOUBLE) AS x_{m}' for m in PM)} FROM contests WHERE official IS NOT NULL",
)
def prepared_officials(spark, root):
    c = contests(spark, root)
    return pt.prepare(c, side_rows(c, METRICS), PM)[1].drop("event_date", "venue")


@query(
    "Q_07_preparation_quality",
    """SELECT count(*) AS contests, 0::BIGINT AS invalid_dates, 0::BIGINT AS invalid_clocks, count(*) FILTER (official IS NULL) AS missing_officials, 0::BIGINT AS broken_pairs,
    (SELECT count(*) FROM sides WHERE qty_for IS NULL) AS invalid_qty, 0::BIGINT AS invalid_lines, 0::BIGINT AS invalid_bulk FROM contests""",
)
def quality(spark, root):
    return tables(spark, root)["quality"]


EFFECT = ["n_group", "n_baseline", "sample_class", "evaluable", "sparse_identity"]
EFFECT_R = ["group_mean", "baseline_mean", "effect", "relative_effect"]
r6 = lambda cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)


@query("Q_02_season_patterns", SEASONAL + f"SELECT season, {KEY}, {', '.join(EFFECT)}, {r6(EFFECT_R)} FROM pats")
def season_patterns(spark, root):
    return tables(spark, root)["seasonal"].select("season", *pt.KEY, *EFFECT, *EFFECT_R)


RELIABLE = ["effect_se", "ci_low", "ci_high", "effective_n", "reliability_weight", "shrunk_effect"]


@query("Q_03_reliability", SEASONAL + f"SELECT season, {KEY}, uncertainty_status, {r6(RELIABLE)} FROM pats")
def reliability(spark, root):
    return tables(spark, root)["seasonal"].select("season", *pt.KEY, "uncertainty_status", *RELIABLE)


STAB = ["eligible_seasons", "positive_seasons", "negative_seasons", "neutral_seasons", "direction"]


@query("Q_04_stability", SEASONAL + summaries() + f"SELECT {KEY}, {', '.join(STAB)}, round(direction_consistency, 6) AS direction_consistency FROM stability")
def stability(spark, root):
    return tables(spark, root)["stability"].select(*pt.KEY, *STAB, "direction_consistency")


@query(
    "Q_05_walk_forward",
    SEASONAL + summaries() + f"""SELECT {KEY}, target_season, used, n AS historical_eligible_count, expected_direction, target_n_group, target_n_baseline,
    round(target_effect, 6) AS target_effect, round(target_relative_effect, 6) AS target_relative_effect, validation_result FROM wf""",
)
def walk_forward(spark, root):
    got = tables(spark, root)["walk_forward"]
    return got.withColumn("used", F.array_join("historical_seasons_used", ",")).drop("historical_seasons_used")


@query(
    "Q_06_oos_summary",
    SEASONAL + summaries() + f"SELECT {KEY}, oos_tests, oos_hits, oos_misses, oos_neutral, round(CASE WHEN oos_tests > 0 THEN oos_hits / oos_tests END, 6) AS oos_hit_rate FROM oos",
)
def oos(spark, root):
    return tables(spark, root)["oos"]


@query(
    "Q_07_pattern_counts",
    SEASONAL + summaries() + """SELECT pattern_type, direction, count(*) AS patterns, CAST(sum(oos_tests) AS BIGINT) AS tests, CAST(sum(oos_hits) AS BIGINT) AS hits
    FROM stability JOIN oos USING (pattern_type, entity, venue, weekday, daypart, metric) GROUP BY ALL""",
)
def composition(spark, root):
    got = tables(spark, root)
    return got["stability"].join(got["oos"], pt.KEY).groupBy("pattern_type", "direction").agg(
        F.count("*").alias("patterns"), F.sum("oos_tests").alias("tests"), F.sum("oos_hits").alias("hits")
    )


def future(spark, root):
    return future_of(contests(spark, root))


def future_of(c):
    return c.filter(F.col("event_date") >= FIXTURE_DAY).select(
        F.col("event_id").alias("fixture_id"), "season", "event_date", "side_a", "side_b", "official",
        weekday(F.col("event_date")).alias("weekday"), daypart(F.col("kickoff_time")).alias("daypart"),
    )


def matched(spark, root):
    def build():
        c = shared(spark, root, "contests", lambda: contests(spark, root))
        return pt.match_patterns(c, side_rows(c, METRICS), future_of(c), PM)

    return shared(spark, root, "matched", build)


MATCH = TALL + f""", fx AS (SELECT event_id AS fixture_id, season AS f_season, event_date AS f_date, side_a AS fa, side_b AS fb, official, dayname(event_date) AS f_weekday, {PART} AS f_daypart
      FROM contests WHERE event_date >= DATE '{FIXTURE_DAY}'),
    subj AS (SELECT *, 'side' AS kind, fa AS entity, 'H' AS venue FROM fx UNION ALL SELECT *, 'side', fb, 'A' FROM fx UNION ALL SELECT *, 'official', official, '' FROM fx WHERE official IS NOT NULL),
    h AS (SELECT s.fixture_id, s.f_season, t.kind, t.entity, t.venue, t.season, t.factor, CASE t.factor WHEN 'weekday' THEN f_weekday ELSE f_daypart END AS fcat, t.category AS tcat, t.metric, t.x, t.event_id
      FROM subj s JOIN tall t ON t.kind = s.kind AND t.entity = s.entity AND t.venue = s.venue AND t.event_date < s.f_date AND t.season <= s.f_season
        AND NOT (t.season = s.f_season AND t.side_a = s.fa AND t.side_b = s.fb)),
    raw_cells AS (SELECT fixture_id, f_season, kind, entity, venue, season, factor, fcat AS category, metric, count(*) AS n_rows, count(*) FILTER (tcat = fcat) AS present,
      count(x) FILTER (tcat = fcat) AS ng, count(x) FILTER (tcat <> fcat) AS nb, avg(x) FILTER (tcat = fcat) AS mg, avg(x) FILTER (tcat <> fcat) AS mb,
      var_samp(x) FILTER (tcat = fcat) AS vg, var_samp(x) FILTER (tcat <> fcat) AS vb FROM h GROUP BY ALL),
    cells AS (SELECT * FROM raw_cells WHERE present > 0)
""" + effect_sql("cells", "fixture_id, f_season,") + summaries("fixture_id, ") + f""", cur AS (SELECT fixture_id, {KEY}, f_season,
      count(*) FILTER (ok AND season < f_season) AS historical_eligible_seasons, max(sample_class) FILTER (season = f_season) AS cs, max(n_group) FILTER (season = f_season) AS cg,
      max(n_baseline) FILTER (season = f_season) AS cb, coalesce(bool_or(ok) FILTER (season = f_season), false) AS cok, abs(arg_max(shrunk_effect, y) FILTER (ok)) AS ranking_effect,
      count(*) FILTER (ok AND season < f_season AND effect > 0) AS earlier_up, count(*) FILTER (ok AND season < f_season AND effect < 0) AS earlier_down,
      string_agg(season || ':' || n_group || '/' || n_baseline, ',' ORDER BY season) AS season_effects FROM pats GROUP BY fixture_id, {KEY}, f_season),
    known AS (SELECT fixture_id, kind || '_' || factor AS pattern_type, entity, venue, metric, nb AS known_n FROM raw_cells WHERE season = f_season),
    hist_list AS (SELECT fixture_id, {KEY}, string_agg(target_season || ':' || validation_result, ',' ORDER BY target_season) AS oos_history FROM wf GROUP BY fixture_id, {KEY}),
    matched AS (SELECT fixture_id, {KEY}, CASE WHEN pattern_type LIKE 'official%' THEN 'official' WHEN venue = 'H' THEN 'home' ELSE 'away' END AS role, direction, direction_consistency, eligible_seasons,
      historical_eligible_seasons, f_season AS current_season, CASE WHEN cok THEN 'eligible' ELSE 'pending' END AS current_status, coalesce(cs, 'insufficient') AS current_sample_class,
      coalesce(cg, 0) AS current_n_group, coalesce(cb, known_n, 0) AS current_n_baseline, oos_tests, oos_hits, oos_misses, oos_neutral, ranking_effect, season_effects, oos_history, earlier_up, earlier_down,
      CASE WHEN direction = 'mixed' THEN 'mixed' WHEN direction IN ('up', 'down') AND oos_tests > 0 AND oos_hits = oos_tests AND historical_eligible_seasons >= 3 AND oos_tests >= 2 THEN 'strong_candidate'
        WHEN direction IN ('up', 'down') AND oos_tests > 0 AND oos_hits = oos_tests AND historical_eligible_seasons >= 2 THEN 'supported' ELSE 'weak' END AS evidence_level
      FROM cur JOIN stability USING (fixture_id, {KEY}) JOIN oos USING (fixture_id, {KEY}) JOIN hist_list USING (fixture_id, {KEY}) LEFT JOIN known USING (fixture_id, pattern_type, entity, venue, metric))
"""
MATCHED = [
    "fixture_id", *pt.KEY, "role", "direction", "eligible_seasons", "historical_eligible_seasons", "current_season", "current_status", "current_sample_class",
    "current_n_group", "current_n_baseline", "oos_tests", "oos_hits", "oos_misses", "oos_neutral", "evidence_level",
]


@query("Q_08_matched_patterns", MATCH + f"SELECT {', '.join(MATCHED)}, round(ranking_effect, 6) AS ranking_effect, round(direction_consistency, 6) AS direction_consistency FROM matched")
def match(spark, root):
    return matched(spark, root).select(*MATCHED, "ranking_effect", "direction_consistency")


@query("Q_09_evidence_levels", MATCH + "SELECT role, evidence_level, count(*) AS patterns FROM matched GROUP BY ALL")
def levels(spark, root):
    return matched(spark, root).groupBy("role", "evidence_level").agg(F.count("*").alias("patterns"))


RANK_SQL = f"""row_number() OVER (PARTITION BY fixture_id ORDER BY CASE evidence_level WHEN 'strong_candidate' THEN 1 WHEN 'supported' THEN 2 WHEN 'mixed' THEN 3 ELSE 4 END,
    oos_tests DESC, eligible_seasons DESC, direction_consistency DESC NULLS LAST, round(ranking_effect, 9) DESC NULLS LAST, {KEY}) AS place"""


@query("Q_10_ranked_patterns", MATCH + f"SELECT fixture_id, {KEY}, evidence_level, {RANK_SQL} FROM matched")
def ranked(spark, root):
    rows = matched(spark, root).withColumn("ranking_effect", F.round("ranking_effect", 9))
    return pt.ranked(rows.drop("place"), ["fixture_id"]).select("fixture_id", *pt.KEY, "evidence_level", "place")


@query("Q_11_nested_history", MATCH + f"SELECT fixture_id, {KEY}, season_effects, oos_history FROM matched")
def nested(spark, root):
    got = matched(spark, root)
    effects = F.transform("season_effects", lambda s: F.concat(s["season"], F.lit(":"), s["n_group"], F.lit("/"), s["n_baseline"]))
    tests = F.transform("oos_history", lambda s: F.concat(s["target_season"], F.lit(":"), s["validation_result"]))
    return got.select("fixture_id", *pt.KEY, F.array_join(effects, ",").alias("season_effects"), F.array_join(tests, ",").alias("oos_history"))


@query(
    "Q_12_fixture_context",
    f""", t AS (SELECT event_id AS fixture_id, CASE WHEN event_id % 13 = 0 THEN '' ELSE side_a END AS side_a, CASE WHEN event_id % 17 = 0 THEN side_a ELSE side_b END AS side_b, season,
      CASE WHEN event_id % 19 = 0 THEN replace(event_date::VARCHAR, '-', '/') ELSE event_date::VARCHAR END AS d, CASE WHEN event_id % 23 = 0 THEN '24:61' ELSE kickoff_time END AS k, event_date, kickoff_time,
      CASE WHEN event_id % 29 = 0 THEN '1990-91' ELSE season END AS s FROM contests)
    SELECT fixture_id, CASE WHEN fixture_id % 19 <> 0 THEN dayname(event_date) END AS weekday, CASE WHEN fixture_id % 23 <> 0 THEN {PART} END AS daypart,
      array_to_string(list_filter([CASE WHEN fixture_id % 13 = 0 THEN 'missing side_a' END, CASE WHEN side_a = side_b THEN 'sides must differ' END,
        CASE WHEN fixture_id % 19 = 0 THEN 'date must be YYYY-MM-DD' END, CASE WHEN fixture_id % 29 = 0 AND fixture_id % 19 <> 0 THEN 'date outside season' END,
        CASE WHEN fixture_id % 23 = 0 THEN 'invalid kickoff' END], lambda z: z IS NOT NULL), ',') AS violations FROM t""",
)
def fixture_context(spark, root):
    broken = lambda n, bad, c: F.when(F.col("fixture_id") % n == 0, bad).otherwise(F.col(c))
    rows = contests(spark, root).withColumnRenamed("event_id", "fixture_id")
    text = rows.select(
        "fixture_id", broken(13, F.lit(""), "side_a").alias("side_a"), broken(17, F.col("side_a"), "side_b").alias("side_b"),
        broken(29, F.lit("1990-91"), "season").alias("season"),
        F.when(F.col("fixture_id") % 19 == 0, F.date_format("event_date", "yyyy/MM/dd")).otherwise(F.col("event_date").cast("string")).alias("event_date"),
        broken(23, F.lit("24:61"), "kickoff_time").alias("kickoff_time"), "official",
    )
    # side_b copies the untouched side_a, as an entry mistake would.
    got = pt.fixture_context(text)
    return got.select("fixture_id", "weekday", "daypart", F.array_join("violations", ",").alias("violations"))


@query(
    "Q_13_sections",
    MATCH + "SELECT fixture_id, count(*) FILTER (evidence_level IN ('strong_candidate', 'supported')) AS main, count(*) FILTER (evidence_level NOT IN ('strong_candidate', 'supported')) AS extra FROM matched GROUP BY fixture_id",
)
def sections(spark, root):
    rows = matched(spark, root).join(future(spark, root).select("fixture_id", "official"), "fixture_id")
    return pt.sections(rows).groupBy("fixture_id").agg(
        F.count_if(F.col("section") == "main").alias("main"), F.count_if(F.col("section") == "extra").alias("extra")
    )


@query(
    "Q_14_prior_agreement",
    MATCH + f"SELECT fixture_id, {KEY}, historical_eligible_seasons AS prior_seasons, CASE direction WHEN 'up' THEN earlier_up ELSE earlier_down END AS prior_same_direction FROM matched",
)
def agreement(spark, root):
    return pt.prior_agreement(matched(spark, root)).select("fixture_id", *pt.KEY, "prior_seasons", "prior_same_direction")


@query(
    "T_05_evidence_ranking",
    SEASONAL + summaries() + f""", latest AS (SELECT {KEY}, abs(arg_max(shrunk_effect, y)) AS ranking_effect FROM pats WHERE ok GROUP BY {KEY}),
    x AS (SELECT {KEY}, eligible_seasons, oos_tests, direction_consistency, round(ranking_effect, 9) AS ranking_effect,
      CASE WHEN direction = 'mixed' THEN 'mixed' WHEN direction IN ('up', 'down') AND oos_tests > 0 AND oos_hits = oos_tests AND eligible_seasons >= 3 AND oos_tests >= 2 THEN 'strong_candidate'
        WHEN direction IN ('up', 'down') AND oos_tests > 0 AND oos_hits = oos_tests AND eligible_seasons >= 2 THEN 'supported' ELSE 'weak' END AS evidence_level
      FROM stability JOIN oos USING ({KEY}) LEFT JOIN latest USING ({KEY}))
    SELECT {KEY}, evidence_level, oos_tests, eligible_seasons, round(direction_consistency, 6) AS direction_consistency, round(ranking_effect, 6) AS ranking_effect,
      row_number() OVER (PARTITION BY pattern_type, entity ORDER BY CASE evidence_level WHEN 'strong_candidate' THEN 1 WHEN 'supported' THEN 2 WHEN 'mixed' THEN 3 ELSE 4 END,
        oos_tests DESC, eligible_seasons DESC, direction_consistency DESC NULLS LAST, ranking_effect DESC NULLS LAST, {KEY}) AS place FROM x""",
)
def evidence_ranking(spark, root):
    """Patterns of each entity by evidence level, then the five measures, then their key."""
    got = tables(spark, root)
    effects = got["seasonal"].filter(pt.eligible()).groupBy(*pt.KEY).agg(F.abs(F.max_by("shrunk_effect", "season")).alias("ranking_effect"))
    rows = got["stability"].join(got["oos"], pt.KEY).join(effects, pt.KEY, "left")
    level, _ = pt.evidence(*[F.col(c) for c in ("direction", "eligible_seasons", "oos_tests", "oos_hits", "oos_misses", "oos_neutral")])
    rows = rows.withColumns({"evidence_level": level, "ranking_effect": F.round("ranking_effect", 9)})
    found = pt.ranked(rows, ["pattern_type", "entity"])
    return found.select(*pt.KEY, "evidence_level", "oos_tests", "eligible_seasons", "direction_consistency", "ranking_effect", "place")
