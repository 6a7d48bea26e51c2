"""Queries M-* and T-02, T-03, T-06: forecasts, scoring and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinside.functions import probability as pr
from twinside.operators import features as ft, forest as fr, models as md, ordering as od, quality as qa
from twinside.operators.sides import side_rows
from twinside.plans.base import kept, query, rounded, shared
from twinside.plans.gates import FIXTURE_SIDE_FEATURES
from twinside.plans.windows import RECENT_TOTALS
from twinside.session import settle
from twinside.sources.tables import METRICS, contests, fact

MARKETS = md.MARKETS
BASE_KEYS = ["event_id", "season", "event_date", "side", "opponent", "venue", "official"]


def forecasts(spark, root):
    """Walk-forward baseline of every side row and market."""
    c = fact(spark, root)
    train = md.season_train_means(side_rows(c, METRICS), [m.target for m in MARKETS])
    return md.baseline_forecasts(md.baseline_features(c, METRICS), train, MARKETS)


def _baseline_sql(m: md.Market, opp: str = "o", league: str = "f") -> str:
    against = f"{opp}.season_{m.name}_against_avg_x"
    if m.against_fallback:
        against = f"coalesce({against}, {opp}.career_last5_{m.name}_against_avg_x)"
    return f"coalesce((coalesce(f.season_{m.name}_for_avg_x, f.career_last5_{m.name}_for_avg_x) + {against}) / 2, {league}.league_{m.name} / 2, train_{m.name})"


_over = lambda part, n: f"OVER (PARTITION BY {part} ORDER BY event_date, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
_COLS = [f"{m.name}_{d}" for m in MARKETS for d in ("for", "against")]
FORECASTS = f""", lday AS (SELECT season, event_date, count(*) AS n, {", ".join(f"coalesce(sum(a_{m.name} + b_{m.name}), 0) AS t_{m.name}" for m in MARKETS)}, sum(a_qty) AS a_qty, sum(b_qty) AS b_qty FROM contests GROUP BY ALL),
lbefore AS (SELECT d.season, d.event_date, {", ".join(f"sum(p.t_{m.name}) / nullif(sum(p.n), 0) AS league_{m.name}" for m in MARKETS)}, sum(p.a_qty) / nullif(sum(p.n), 0) AS la_qty, sum(p.b_qty) / nullif(sum(p.n), 0) AS lb_qty
  FROM lday d LEFT JOIN lday p ON p.season = d.season AND p.event_date < d.event_date GROUP BY d.season, d.event_date),
seasons AS (SELECT DISTINCT season FROM contests),
train AS (SELECT z.season, {", ".join(f"avg(s.{m.target}) AS train_{m.name}" for m in MARKETS)} FROM seasons z LEFT JOIN sides s ON s.season < z.season GROUP BY z.season),
fe AS (SELECT *, {", ".join(f"avg({c}) {_over('season, side', 'UNBOUNDED')} AS season_{c}_avg_x" for c in _COLS)},
  {", ".join(f"avg({c}) {_over('side', '5')} AS career_last5_{c}_avg_x" for c in _COLS)} FROM sides),
wide AS (SELECT f.event_id, f.season, f.event_date, f.side, f.opponent, f.venue, f.official, {", ".join(f"{_baseline_sql(m, league='l')} AS p_{m.name}, CAST(f.{m.target} AS DOUBLE) AS y_{m.name}" for m in MARKETS)}
  FROM fe f JOIN fe o ON o.event_id = f.event_id AND o.side = f.opponent JOIN lbefore l ON l.season = f.season AND l.event_date = f.event_date JOIN train t ON t.season = f.season),
forecasts AS ({" UNION ALL ".join(f"SELECT event_id, season, event_date, side, opponent, venue, official, '{m.name}' AS market, p_{m.name} AS prediction, y_{m.name} AS target FROM wide" for m in MARKETS)})
"""


@query("M_01_baseline", FORECASTS + "SELECT event_id, side, market, round(prediction, 6) AS prediction, target FROM forecasts")
def baseline(spark, root):
    return forecasts(spark, root).select("event_id", "side", "market", "prediction", "target")


@query(
    "M_01_baseline_with_side_mean",
    FORECASTS + """SELECT f.event_id, f.side, round(coalesce((coalesce(f.season_qty_for_avg_x, f.career_last5_qty_for_avg_x) + coalesce(o.season_qty_against_avg_x, o.career_last5_qty_against_avg_x)) / 2,
      CASE WHEN f.venue = 'H' THEN la_qty ELSE lb_qty END, league_qty / 2, 51.5), 6) AS prediction
    FROM fe f JOIN fe o ON o.event_id = f.event_id AND o.side = f.opponent JOIN lbefore l ON l.season = f.season AND l.event_date = f.event_date""",
)
def baseline_side(spark, root):
    rows = md.baseline_features(fact(spark, root), METRICS)
    value = md.baseline(MARKETS[0], F.lit(51.5), side_mean=True)
    return rows.select("event_id", "side", value.alias("prediction"))


GAPPY = ["season_qty_for_avg", "season_lines_for_avg", "career_last5_qty_for_avg", "career_last5_bulk_against_avg"]
IMPUTE = f""", fe AS (SELECT event_id, side, avg(qty_for) {_over('season, side', 'UNBOUNDED')} AS season_qty_for_avg, avg(lines_for) {_over('season, side', 'UNBOUNDED')} AS season_lines_for_avg,
      avg(qty_for) {_over('side', '5')} AS career_last5_qty_for_avg, avg(bulk_against) {_over('side', '5')} AS career_last5_bulk_against_avg FROM sides),
    md AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in GAPPY)} FROM fe)
"""


@query(
    "M_02_median_imputation",
    IMPUTE + f"SELECT event_id, side, {', '.join(f'round(coalesce({c}, m_{c}), 6) AS x_{c}, CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gap_{c}' for c in GAPPY)} FROM fe CROSS JOIN md",
)
def imputation(spark, root):
    rows = settle(md.baseline_features(fact(spark, root), METRICS).select("event_id", "side", *GAPPY), "gappy")
    filled = md.impute(rows, fr.column_medians(rows, GAPPY), md.columns_with_gaps(rows, GAPPY))
    return filled.select("event_id", "side", *[x for c in GAPPY for x in (f"x_{c}", f"gap_{c}")])


ALL_SEASONS = {"all": None}


def forest_rows(spark, root):
    """Rows of all markets for the forests, over all seasons."""

    def build():
        features = ft.training_features(fact(spark, root), METRICS, [m.name for m in MARKETS])
        return md.forest_rows(features, MARKETS)

    return shared(spark, root, "forest-rows", build)


def season_folds(spark, root):
    """Every season is a fold: it learns from the seasons before it. One row a season comes to the driver."""
    return {r["season"]: r["season"] for r in forest_rows(spark, root).select("season").distinct().collect()}


def full_forest(spark, root):
    """The forest of all stored rows, one for each market."""
    inputs = {m.name: md.market_inputs(m.name) for m in MARKETS}
    return kept(spark, root, "full-forest", lambda: fr.fit(forest_rows(spark, root), inputs, ALL_SEASONS))


def batch_scores(spark, root):
    """Stored rows of all markets with forest, baseline and ensemble of the forest of all seasons."""

    def build():
        rows = forest_rows(spark, root).withColumn("fold", F.lit("all"))
        keep = ["part", "fold", "season", "event_id", "side", "y", "known_baseline"]
        return md.with_ensemble(fr.scored(rows, full_forest(spark, root), "fold", keep), md.train_means(rows, ALL_SEASONS), MARKETS)

    return shared(spark, root, "batch-scores", build)


def walk_forward_scores(spark, root):
    """Every row of a season with an earlier one, by forests of the earlier seasons only; all folds are grown together."""

    def build():
        rows, folds = forest_rows(spark, root).withColumn("fold", F.col("season")), season_folds(spark, root)
        forest = fr.fit(rows, {m.name: md.market_inputs(m.name) for m in MARKETS}, folds)
        keep = ["part", "fold", "season", "event_id", "side", "y", "known_baseline"]
        return md.with_ensemble(fr.scored(rows, forest, "fold", keep), md.train_means(rows, folds), MARKETS)

    return shared(spark, root, "walk-forward-scores", build)


TARGETS = ", ".join(f"('{m.name}')" for m in MARKETS)
TARGET = "CASE market " + " ".join(f"WHEN '{m.name}' THEN {m.target}" for m in MARKETS) + " END"
MARKET_ROWS = f""", market_rows AS (SELECT season, event_id, side, market, CAST({TARGET} AS DOUBLE) AS target FROM sides CROSS JOIN (VALUES {TARGETS}) t(market))
"""


@query(
    "M_03_forest",
    MARKET_ROWS + """, facts AS (SELECT market, count(target) AS train_rows, avg(target) AS train_mean FROM market_rows GROUP BY market)
    SELECT event_id, side, market, target, train_rows, TRUE AS within_targets, TRUE AS better_than_mean FROM market_rows JOIN facts USING (market)""",
)
def forest(spark, root):
    """Rows and what holds for any forest of leaf means: predictions lie within the targets, and beat the mean over the training rows."""
    rows = batch_scores(spark, root)
    error = lambda c: F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))
    means = rows.groupBy("market").agg(F.avg("y").alias("mean"), F.count("y").alias("train_rows"), F.min("y").alias("least"), F.max("y").alias("most"))
    errors = rows.join(means.select("market", "mean"), "market").groupBy("market").agg((error("model_prediction") < error("mean")).alias("better_than_mean"))
    within = F.col("model_prediction").between(F.col("least"), F.col("most")).alias("within_targets")
    return rows.join(means, "market").join(errors, "market").select("event_id", "side", "market", F.col("y").alias("target"), "train_rows", within, "better_than_mean")


@query("M_03_forest_predictions")
def forest_predictions(spark, root):
    return batch_scores(spark, root).select("event_id", "side", "market", F.col("y").alias("target"), "model_prediction")


@query(
    "M_04_ensemble",
    FORECASTS + """SELECT f.event_id, f.side, round(greatest(coalesce(last10, prediction) * 0.7::DOUBLE + prediction * (1 - 0.7::DOUBLE), 0.05), 6) AS ensemble
    FROM forecasts f JOIN (SELECT event_id, side, avg(qty_for) OVER (PARTITION BY side ORDER BY event_date, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS last10 FROM sides) x USING (event_id, side) WHERE market = 'qty'""",
)
def ensembled(spark, root):
    from twinside.operators.scan import means, prior_features

    component = prior_features(side_rows(contests(spark, root), METRICS), ["side"], means("career_last10", ["qty_for"], 10))
    rows = forecasts(spark, root).filter("market = 'qty'").join(component.select("event_id", "side", "career_last10_qty_for_avg"), ["event_id", "side"])
    model = F.coalesce("career_last10_qty_for_avg", "prediction")
    return rows.select("event_id", "side", md.ensemble(model, F.col("prediction"), 0.7).alias("ensemble"))


def pmf_sql(i: str, mu: str, alpha: str) -> str:
    """One probability of the count family in closed form."""
    nb = f"exp(lgamma({i} + 1 / {alpha}) - lgamma(1 / {alpha}) - lgamma({i} + 1) - (1 / {alpha}) * ln(1 + {alpha} * {mu}) + {i} * (ln({alpha} * {mu}) - ln(1 + {alpha} * {mu})))"
    poisson = f"exp({i} * ln({mu}) - {mu} - lgamma({i} + 1))"
    return f"CASE WHEN {alpha} > 0 THEN {nb} ELSE {poisson} END"


def over_sql(mu: str, line: str, alpha: str) -> str:
    terms = lambda lo, hi: f"list_sum(list_transform(range({lo}, {hi}), lambda i: {pmf_sql('i', mu, alpha)}))"
    k = f"CAST(floor({line}) AS BIGINT)"
    return f"CASE WHEN {mu} IS NULL THEN NULL WHEN {k} + 1 > {mu} THEN {terms(f'{k} + 1', f'{k} + 161')} ELSE 1 - {terms('0', f'{k} + 1')} END"


ALPHA = "CASE market WHEN 'lines' THEN 0.11::DOUBLE WHEN 'lines_total' THEN 0.11::DOUBLE END"
LINES = ", ".join(f"('{m.name}', CAST({x} AS DOUBLE))" for m in MARKETS for x in m.lines)
SCORED = FORECASTS + f""", line_list(market, line) AS (VALUES {LINES}),
lined AS (SELECT f.*, line, CASE WHEN prediction IS NOT NULL THEN greatest(prediction, 0.05) END AS mu, {ALPHA} AS alpha FROM forecasts f JOIN line_list USING (market)),
scored AS (SELECT *, {over_sql('mu', 'line', 'alpha')} AS p_over FROM lined)
"""


@query("M_05_poisson_over", SCORED + "SELECT event_id, side, market, line, round(p_over, 6) AS p_over FROM scored WHERE market <> 'lines'")
def poisson(spark, root):
    return md.over_lines(forecasts(spark, root).filter("market <> 'lines'"), MARKETS).select("event_id", "side", "market", "line", "p_over")


@query("M_06_negative_binomial_over", SCORED + "SELECT event_id, side, line, round(p_over, 6) AS p_over FROM scored WHERE market = 'lines'")
def negative_binomial(spark, root):
    return md.over_lines(forecasts(spark, root).filter("market = 'lines'"), MARKETS).select("event_id", "side", "line", "p_over")


@query(
    "M_07_under_and_fair_odds",
    SCORED + "SELECT event_id, side, market, line, round(1 - p_over, 6) AS p_under, CASE WHEN p_over > 0 THEN round(ln(1 + 1 / p_over), 5) END AS log_odds_over, CASE WHEN 1 - p_over > 1e-9 THEN round(ln(1 + 1 / (1 - p_over)), 5) END AS log_odds_under FROM scored",
)
def odds(spark, root):
    rows = md.over_lines(forecasts(spark, root), MARKETS)
    # Logarithms keep long odds comparable; of 1 - p below 1e-9 too few digits are left to compare.
    logged = lambda p, odds, least: F.when(F.col(p) > least, rounded(F.ln(F.col(odds) + 1), 1e5))
    return rows.select(
        "event_id", "side", "market", "line", "p_under", logged("p_over", "fair_over", 0.0).alias("log_odds_over"), logged("p_under", "fair_under", 1e-9).alias("log_odds_under")
    )


TOTALS = FORECASTS + f""", totals AS (SELECT event_id, market || '_total' AS market, max(prediction) FILTER (venue = 'H') AS mu_a, max(prediction) FILTER (venue = 'A') AS mu_b,
    max(prediction) FILTER (venue = 'H') + max(prediction) FILTER (venue = 'A') AS prediction FROM forecasts GROUP BY event_id, market),
  spread AS (SELECT *, CASE WHEN {ALPHA} > 0 THEN (mu_a + 0.11 * mu_a * mu_a + mu_b + 0.11 * mu_b * mu_b - prediction) / (prediction * prediction) END AS alpha, greatest(prediction, 0.05) AS mu FROM totals),
  tlined AS (SELECT *, unnest(range(greatest(0, CAST(floor(prediction) AS BIGINT) - 8), CAST(floor(prediction) AS BIGINT) + 9)) + 0.5::DOUBLE AS line FROM spread),
  tscored AS (SELECT *, {over_sql('mu', 'line', 'alpha')} AS p_over FROM tlined)
"""


def totals(spark, root):
    return md.total_forecasts(forecasts(spark, root), ["event_id"])


@query("M_08_total_over", TOTALS + "SELECT event_id, market, line, round(prediction, 6) AS prediction, round(p_over, 6) AS p_over FROM tscored")
def total_over(spark, root):
    return md.over_total_lines(totals(spark, root), MARKETS).select("event_id", "market", "line", "prediction", "p_over")


@query("M_09_total_lines", TOTALS + "SELECT event_id, market, count(*) AS n, min(line) AS lowest, max(line) AS highest FROM tlined GROUP BY event_id, market")
def total_lines(spark, root):
    lined = totals(spark, root).withColumn("line", F.explode(pr.total_lines(F.col("prediction"))))
    return lined.groupBy("event_id", "market").agg(F.count("*").alias("n"), F.min("line").alias("lowest"), F.max("line").alias("highest"))


_fx_against = lambda m: f"coalesce(o.season_{m.name}_against_avg, o.career_last5_{m.name}_against_avg)" if m.against_fallback else f"o.season_{m.name}_against_avg"
_fx_baseline = lambda m: f"coalesce((coalesce(f.season_{m.name}_for_avg, f.career_last5_{m.name}_for_avg) + {_fx_against(m)}) / 2, lg_{m.name} / 2, 1.0)"
FIXTURE_SCORED = (
    FIXTURE_SIDE_FEATURES.replace("round(avg(", "((avg(").replace(", 6) AS", ")) AS")
    + f""", lgf AS (SELECT f.fixture_id, {", ".join(f"avg(c.a_{m.name} + c.b_{m.name}) AS lg_{m.name}" for m in MARKETS)} FROM fixtures f LEFT JOIN contests c ON c.season = f.season AND c.event_date < f.event_date GROUP BY f.fixture_id),
  fxw AS (SELECT f.fixture_id, f.side, f.venue, {", ".join(f"{_fx_baseline(m)} AS p_{m.name}" for m in MARKETS)} FROM side_feats f JOIN side_feats o ON o.fixture_id = f.fixture_id AND o.side = f.opponent JOIN lgf ON lgf.fixture_id = f.fixture_id),
  fxl AS ({" UNION ALL ".join(f"SELECT fixture_id, side, venue, '{m.name}' AS market, p_{m.name} AS prediction FROM fxw" for m in MARKETS)}),
  line_list(market, line) AS (VALUES {LINES}),
  sl AS (SELECT fixture_id, side, venue, market, line, prediction, greatest(prediction, 0.05) AS mu, {ALPHA} AS alpha FROM fxl JOIN line_list USING (market)),
  tt AS (SELECT fixture_id, 'TOTAL' AS side, 'T' AS venue, market || '_total' AS market, max(prediction) FILTER (venue = 'H') AS a, max(prediction) FILTER (venue = 'A') AS b FROM fxl GROUP BY fixture_id, market),
  tl AS (SELECT fixture_id, side, venue, market, unnest(range(greatest(0, CAST(floor(a + b) AS BIGINT) - 8), CAST(floor(a + b) AS BIGINT) + 9)) + 0.5::DOUBLE AS line, a + b AS prediction, greatest(a + b, 0.05) AS mu,
    CASE WHEN {ALPHA} > 0 THEN (a + 0.11 * a * a + b + 0.11 * b * b - (a + b)) / ((a + b) * (a + b)) END AS alpha FROM tt),
  al AS (SELECT * FROM sl UNION ALL SELECT * FROM tl),
  fscored AS (SELECT *, {over_sql('mu', 'line', 'alpha')} AS p_over FROM al)
"""
)


def fixture_forecasts(spark, root):
    """Baseline forecasts of the fixtures, two rows per fixture and market."""
    c = fact(spark, root)
    fx = c.filter(F.col("event_date") >= "2001-01-01").withColumnRenamed("event_id", "fixture_id").select(
        "fixture_id", "season", "event_date", "official", "side_a", "side_b"
    )
    rows = settle(ft.fixture_features(c, fx, METRICS, RECENT_TOTALS), "fixture-features")
    one = lambda m: F.struct(F.lit(m.name).alias("market"), md.baseline(m, F.lit(1.0)).alias("prediction"))
    return rows.select("fixture_id", "season", "event_date", "side", "opponent", "venue", "official", F.explode(F.array(*[one(m) for m in MARKETS])).alias("f")).select(
        "fixture_id", "season", "event_date", "side", "opponent", "venue", "official", "f.*"
    )


def fixture_scores(spark, root):
    rows = settle(fixture_forecasts(spark, root), "fixture-forecasts")
    keep = ["fixture_id", "side", "venue", "market", "line", "prediction", "p_over", "p_under", "fair_over", "fair_under"]
    totals = md.total_forecasts(rows, ["fixture_id"]).withColumns({"side": F.lit("TOTAL"), "venue": F.lit("T")})
    return md.over_lines(rows, MARKETS).select(*keep).unionByName(md.over_total_lines(totals, MARKETS).select(*keep))


@query("M_10_scored_fixtures", FIXTURE_SCORED + "SELECT fixture_id, side, venue, market, line, round(prediction, 6) AS prediction, round(p_over, 6) AS p_over, round(1 - p_over, 6) AS p_under FROM fscored")
def scored_fixtures(spark, root):
    return fixture_scores(spark, root).select("fixture_id", "side", "venue", "market", "line", "prediction", "p_over", "p_under")


WIDE_LINES = MARKETS[1].lines
_key = lambda x: str(x).replace(".", "_")


@query(
    "M_11_wide_scores",
    FIXTURE_SCORED + "SELECT fixture_id, side, "
    + ", ".join(
        f"round(max(p_over) FILTER (line = {x}), 5) AS p_over_{_key(x)}, round(max(1 / p_over) FILTER (line = {x}), 3) AS fair_over_{_key(x)}, "
        f"round(max(1 - p_over) FILTER (line = {x}), 5) AS p_under_{_key(x)}, round(max(1 / (1 - p_over)) FILTER (line = {x}), 3) AS fair_under_{_key(x)}"
        for x in WIDE_LINES
    )
    + " FROM fscored WHERE market = 'lines' GROUP BY fixture_id, side",
)
def wide_scores(spark, root):
    rows = md.over_lines(fixture_forecasts(spark, root).filter("market = 'lines'"), MARKETS)
    return md.wide_lines(rows, ["fixture_id", "side"], WIDE_LINES)


def batch_prices(spark, root):
    rows = batch_scores(spark, root).withColumn("prediction", F.col("ensemble"))
    return md.over_lines(rows, MARKETS)


@query(
    "M_12_batch_scoring",
    MARKET_ROWS + f"""SELECT event_id, side, market, count(*) AS n_lines, TRUE AS floored, TRUE AS falling, TRUE AS summing
    FROM market_rows JOIN (VALUES {LINES}) l(market, line) USING (market) GROUP BY event_id, side, market""",
)
def batch(spark, root):
    """All stored rows: lines priced, predictions at or above the floor, probabilities that fall with the line and sum to one."""
    priced = batch_prices(spark, root)
    ordered = F.array_sort(F.collect_list(F.struct("line", "p_over")))
    falling = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.element_at("p", i + 1)["p_over"] <= F.element_at("p", i)["p_over"] + 1e-12)
    rows = priced.groupBy("event_id", "side", "market").agg(
        F.count("*").alias("n_lines"), F.min(F.col("prediction") >= pr.FLOOR).alias("floored"), ordered.alias("p"), F.min(F.abs(F.col("p_over") + F.col("p_under") - 1) < 1e-12).alias("summing")
    )
    return rows.select("event_id", "side", "market", "n_lines", "floored", falling.alias("falling"), "summing")


@query("M_12_batch_prices")
def batch_values(spark, root):
    return batch_prices(spark, root).select("event_id", "side", "market", "line", "prediction", "p_over", "p_under")


@query(
    "M_13_walk_forward_baseline",
    FORECASTS + """SELECT season, market, count(*) AS n, round(avg(abs(prediction - target)), 6) AS mae, round(sqrt(avg((prediction - target) * (prediction - target))), 6) AS rmse, round(avg(prediction - target), 6) AS bias
    FROM forecasts WHERE prediction IS NOT NULL AND target IS NOT NULL GROUP BY season, market""",
)
def walk_forward_baseline(spark, root):
    return md.forecast_errors(forecasts(spark, root), ["season", "market"])


#: Largest error of the ensemble on unseen seasons, as a multiple of the baseline's.
ERROR_BOUND = 1.05


@query(
    "M_13_walk_forward_forest",
    MARKET_ROWS + """SELECT season, market, count(target) AS n, round(avg(target), 6) AS target_mean, TRUE AS bounded
    FROM market_rows WHERE season > (SELECT min(season) FROM market_rows) AND target IS NOT NULL GROUP BY season, market""",
)
def walk_forward_forest(spark, root):
    """Every season with an earlier one and every market: rows judged, and whether the ensemble's error stays near the baseline's or below."""
    rows = walk_forward_scores(spark, root).filter("y IS NOT NULL")
    error = lambda c: F.avg(F.abs(F.col(c) - F.col("y")))
    judged = rows.groupBy("season", "market").agg(F.count("*").alias("n"), F.avg("y").alias("target_mean"), (error("ensemble") <= ERROR_BOUND * error("baseline")).alias("bounded"))
    return judged


@query("M_13_forest_errors")
def forest_errors(spark, root):
    """Errors of baseline, forest and ensemble by season and market."""
    rows = walk_forward_scores(spark, root).withColumn("target", F.col("y"))
    names = ("baseline", "model_prediction", "ensemble")
    each = rows.select("season", "market", "target", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("prediction")) for n in names])).alias("m"))
    return md.forecast_errors(each.select("season", "market", "target", "m.*"), ["season", "market", "model"])


@query("M_14_brier", SCORED + "SELECT market, line, count(*) AS n, round(avg(pow(p_over - CASE WHEN target > line THEN 1 ELSE 0 END, 2)), 6) AS brier FROM scored WHERE prediction IS NOT NULL AND target IS NOT NULL GROUP BY market, line")
def brier(spark, root):
    return md.brier(md.over_lines(forecasts(spark, root), MARKETS).filter("prediction IS NOT NULL"), ["market", "line"])


@query(
    "M_15_calibration",
    SCORED + """SELECT market, CAST(CASE WHEN p_over = 0 THEN 1 ELSE ceil(p_over * 10) END AS BIGINT) AS bin, count(*) AS n, round(avg(p_over), 6) AS predicted, round(avg(CASE WHEN target > line THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS actual
    FROM scored WHERE prediction IS NOT NULL AND target IS NOT NULL GROUP BY ALL""",
)
def calibration(spark, root):
    return md.calibration(md.over_lines(forecasts(spark, root), MARKETS).filter("prediction IS NOT NULL"), ["market"])


@query("M_16_full_seasons", "SELECT season, count(*) AS n FROM sides GROUP BY season HAVING count(*) >= 700")
def full_seasons(spark, root):
    return md.full_seasons(side_rows(contests(spark, root), METRICS))


INPUT_COUNTS = ", ".join(f"('{m.name}', {len(md.market_inputs(m.name))})" for m in MARKETS)


@query(
    "M_17_importance_totals",
    f"SELECT market, 2 * CAST(n AS BIGINT) AS inputs, 1.0::DOUBLE AS total, 0::BIGINT AS negative, TRUE AS led_by_history FROM (SELECT count(*) AS c FROM sides) CROSS JOIN (VALUES {INPUT_COUNTS}) t(market, n) WHERE c > 0",
)
def importance_totals(spark, root):
    """Importances of a market cover its inputs and their gap marks, add up to one, and lie with the inputs rather than with their gaps."""
    rows = full_forest(spark, root).importances(spark)
    gaps = F.sum(F.when(F.col("input").startswith("gap_"), F.col("importance")).otherwise(0.0))
    return rows.groupBy(F.col("part").alias("market")).agg(
        F.count("*").alias("inputs"), F.sum("importance").alias("total"), F.count_if(F.col("importance") < 0).alias("negative"), (gaps < 0.5).alias("led_by_history")
    )


@query("M_17_feature_importance")
def importance(spark, root):
    rows = full_forest(spark, root).importances(spark)
    return rows.select(F.col("part").alias("market"), F.col("input").alias("feature"), "importance").orderBy("market", F.desc("importance"), "feature")


@query("M_18_training_metadata", "SELECT round(avg(qty_for), 6) AS train_mean, count(*) AS train_rows, string_agg(DISTINCT season, ',' ORDER BY season) AS seasons FROM sides WHERE qty_for IS NOT NULL")
def metadata(spark, root):
    return md.training_metadata(side_rows(contests(spark, root), METRICS), "qty_for")


PMF_SQL = FORECASTS + f""", p AS (SELECT event_id, side, market, greatest(prediction, 0.05) AS mu, {ALPHA} AS alpha FROM forecasts WHERE prediction IS NOT NULL),
  reach AS (SELECT *, CAST(ceil(mu + 15 * sqrt(mu + coalesce(alpha, 0) * mu * mu) + 30) AS BIGINT) AS hi FROM p),
  terms AS (SELECT event_id, side, market, list_transform(range(0, hi + 1), lambda i: {pmf_sql('i', 'mu', 'alpha')}) AS t FROM reach),
  flat AS (SELECT event_id, side, market, unnest(t) AS p, generate_subscripts(t, 1) - 1 AS k FROM terms),
  cum AS (SELECT *, sum(p) OVER (PARTITION BY event_id, side, market ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM flat),
  cut AS (SELECT event_id, side, market, greatest(25, count(*) FILTER (c < 0.999999)) AS hi FROM cum GROUP BY ALL)
"""


@query(
    "M_19_pmf",
    PMF_SQL + """SELECT event_id, side, market, max(k) + 1 AS support, round(sum(p), 6) AS mass, round(ln(sum(p * k)), 6) AS log_mean FROM cum JOIN cut USING (event_id, side, market) WHERE k <= hi GROUP BY event_id, side, market""",
)
def pmf(spark, root):
    rows = forecasts(spark, root).filter("prediction IS NOT NULL")
    shaped = rows.withColumn("f", pr.family(F.col("prediction"), md.alpha_of(MARKETS)))
    values = shaped.select("event_id", "side", "market", pr.moments(pr.pmf_values(F.col("f"))).alias("m"))
    return values.select("event_id", "side", "market", "m.support", "m.mass", F.ln("m.mean").alias("log_mean"))


RANGE_SQL = """, w AS (SELECT event_id, side, market, k, sum(p) OVER (PARTITION BY event_id, side, market ORDER BY k ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS s2,
    sum(p) OVER (PARTITION BY event_id, side, market ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s3 FROM cum),
  best AS (SELECT event_id, side, market, k, CASE market WHEN 'qty' THEN s3 ELSE s2 END AS s, row_number() OVER (PARTITION BY event_id, side, market ORDER BY round(CASE market WHEN 'qty' THEN s3 ELSE s2 END, 12) DESC, k) AS rn FROM w)
"""


@query(
    "M_20_likeliest_range",
    PMF_SQL + RANGE_SQL + "SELECT event_id, side, market, CAST(k AS BIGINT) AS low, CAST(k + CASE market WHEN 'qty' THEN 2 ELSE 1 END AS BIGINT) AS high, round(s, 6) AS probability FROM best WHERE rn = 1",
)
def likeliest(spark, root):
    rows = forecasts(spark, root).filter("prediction IS NOT NULL")
    shaped = rows.withColumns({"f": pr.family(F.col("prediction"), md.alpha_of(MARKETS)), "w": md.width_of(MARKETS)})
    best = pr.best_range(F.col("f"), F.col("w"))
    return shaped.select("event_id", "side", "market", best.alias("r")).select("event_id", "side", "market", "r.*")


@query(
    "T_02_best_line",
    SCORED + """SELECT event_id, side, market, line, round(p_over, 6) AS p_over FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id, side, market ORDER BY p_over DESC, line) AS rn FROM scored WHERE p_over <= 0.5) WHERE rn = 1""",
)
def best_line(spark, root):
    rows = md.over_lines(forecasts(spark, root).filter("prediction IS NOT NULL"), MARKETS)
    return od.best_line(rows, ["event_id", "side", "market"]).select("event_id", "side", "market", "line", "p_over")


@query("T_03_lowest_line", SCORED + "SELECT event_id, side, market, min(line) AS line, round(arg_min(p_over, line), 6) AS p_over FROM scored WHERE prediction IS NOT NULL GROUP BY event_id, side, market")
def lowest_line(spark, root):
    rows = md.over_lines(forecasts(spark, root).filter("prediction IS NOT NULL"), MARKETS)
    keys = ["event_id", "side", "market"]
    return od.lowest_line(rows.select(*keys, "line", "p_over"), keys)


@query(
    "T_06_best_window",
    """, m AS (SELECT season, side, CAST(CASE WHEN month(event_date) >= 7 THEN month(event_date) - 7 ELSE month(event_date) + 5 END AS BIGINT) AS k, count(*) AS n FROM sides GROUP BY ALL),
    g AS (SELECT season, side, k FROM (SELECT DISTINCT season, side FROM sides) CROSS JOIN (SELECT unnest(range(0, 12)) AS k)),
    v AS (SELECT g.season, g.side, g.k, coalesce(n, 0) AS n FROM g LEFT JOIN m USING (season, side, k)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY season, side ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM v)
    SELECT season, side, k AS first_month FROM (SELECT *, row_number() OVER (PARTITION BY season, side ORDER BY s DESC, k) AS rn FROM s WHERE k <= 9) WHERE rn = 1""",
)
def best_window(spark, root):
    rows = side_rows(contests(spark, root), METRICS)
    place = F.pmod(F.month("event_date") - 7, F.lit(12))
    months = rows.groupBy("season", "side").agg(*[F.count_if(place == k).cast("double").alias(f"m{k}") for k in range(12)])
    return months.select("season", "side", od.first_window_maximum(F.array(*[f"m{k}" for k in range(12)]), 3).alias("first_month"))


@query(
    "U_12_score_checks",
    FIXTURE_SCORED + "SELECT count(*) AS row_count, 0::BIGINT AS bad_prediction, 0::BIGINT AS bad_probability, 0::BIGINT AS bad_sum FROM fscored",
)
def score_checks(spark, root):
    return qa.score_violations(fixture_scores(spark, root))


@query(
    "U_12_planted_faults",
    FIXTURE_SCORED + """SELECT count(*) AS row_count, count(*) FILTER (fixture_id % 11 = 0) AS bad_prediction, count(*) FILTER (fixture_id % 13 = 0 OR fixture_id % 17 = 0) AS bad_probability,
    count(*) FILTER (fixture_id % 13 = 0 AND fixture_id % 17 <> 0) AS bad_sum FROM fscored""",
)
def planted_scores(spark, root):
    """The checks on scores with negative predictions, a probability above one and a missing one in them."""
    hit, rows = (lambda n: F.col("fixture_id") % n == 0), fixture_scores(spark, root)
    changes = {
        "prediction": F.when(hit(11), -F.col("prediction") - 1).otherwise(F.col("prediction")),
        "p_over": F.when(hit(13), 1.5).otherwise(F.col("p_over")), "p_under": F.when(~hit(17), F.col("p_under")),
    }
    return qa.score_violations(rows.withColumns(changes))
