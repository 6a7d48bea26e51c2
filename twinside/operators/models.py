"""Count forecasts: baseline, forest, scoring over lines and backtests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinside.functions import probability as pr
from twinside.operators.features import league_daily, mirror
from twinside.operators.ordering import ordered_by
from twinside.operators.scan import hot_keys, means, prior_features
from twinside.operators.sides import for_against, side_rows


@dataclass(frozen=True)
class Market:
    """One forecast market.  ``alpha`` None means Poisson; widths are for the likeliest range."""

    name: str
    lines: tuple[float, ...]
    alpha: float | None = None
    width: int = 2
    total_width: int = 2
    model_weight: float = 0.8
    against_fallback: bool = True
    floor: float = pr.FLOOR

    @property
    def target(self) -> str:
        return f"{self.name}_for"

    @property
    def total(self) -> str:
        return f"{self.name}_total"


MARKETS = (
    Market("qty", (30.5, 40.5, 50.5, 60.5, 70.5), None, 3, 4, 0.7),
    Market("lines", (0.5, 1.5, 2.5, 3.5, 4.5), 0.11, 2, 3),
    Market("bulk", (0.5, 1.5, 2.5), None, 2, 2, against_fallback=False),
)


def by_market(markets: Sequence[Market], value) -> Column:
    """``value(market)`` picked by market name; a total goes by its base market."""
    out = F.lit(None)
    for m in reversed(markets):
        out = F.when(F.col("market").isin(m.name, m.total), value(m)).otherwise(out)
    return out


def alpha_of(markets: Sequence[Market]) -> Column:
    return by_market(markets, lambda m: F.lit(m.alpha)).cast("double")


def width_of(markets: Sequence[Market]) -> Column:
    return by_market(markets, lambda m: F.when(F.col("market") == m.total, m.total_width).otherwise(m.width)).cast("int")


def baseline(market: Market, train_mean: Column, side_mean: bool = False) -> Column:
    """Own rate and opponent rate, then (optionally) the venue's league mean, half the league total, the training mean."""
    m = market.name
    own = F.coalesce(F.col(f"season_{m}_for_avg"), F.col(f"career_last5_{m}_for_avg"))
    other = F.col(f"opp_season_{m}_against_avg")
    if market.against_fallback:
        other = F.coalesce(other, F.col(f"opp_career_last5_{m}_against_avg"))
    parts = [(own + other) / 2.0]
    if side_mean:
        parts.append(F.when(F.col("venue") == "H", F.col(f"league_a_{m}_avg_before")).otherwise(F.col(f"league_b_{m}_avg_before")))
    return F.coalesce(*parts, F.col(f"league_total_{m}_avg_before") / 2.0, train_mean)


def ensemble(model: Column, base: Column, weight: float | Column, floor: float = pr.FLOOR) -> Column:
    return F.greatest(model * weight + base * (1.0 - weight if isinstance(weight, float) else F.lit(1.0) - weight), F.lit(floor))


def baseline_features(contests: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Only the features the baseline reads, with both sides' values and the raw targets."""
    cols = for_against(metrics)
    sides = side_rows(contests, metrics)
    hot = hot_keys(sides, [["season", "side"], ["side"]])
    rows = prior_features(sides, ["season", "side"], means("season", cols), hot=hot[0])
    rows = prior_features(rows, ["side"], means("career_last5", cols, 5), hot=hot[1])
    own = [f"season_{c}_avg" for c in cols] + [f"career_last5_{c}_avg" for c in cols]
    return mirror(rows, own).join(league_daily(contests, metrics), ["season", "event_date"], "left")


def season_train_means(sides: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Per season the target means over all earlier seasons: the training mean of each walk-forward fold."""
    per = sides.groupBy("season").agg(*[F.sum(t).alias(f"_s_{t}") for t in targets], *[F.count(t).alias(f"_n_{t}") for t in targets])
    w = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)  # one row per season
    return per.select("season", *[F.try_divide(F.sum(f"_s_{t}").over(w), F.sum(f"_n_{t}").over(w)).alias(f"train_{t}") for t in targets])


def baseline_forecasts(features: DataFrame, train_means: DataFrame, markets: Sequence[Market]) -> DataFrame:
    """Long rows (event, side, market) with the walk-forward baseline and the realised target."""
    rows = features.join(train_means, "season")
    one = lambda m: F.struct(
        F.lit(m.name).alias("market"), baseline(m, F.col(f"train_{m.target}")).alias("prediction"), F.col(m.target).cast("double").alias("target")
    )
    return rows.select(
        "event_id", "season", "event_date", "side", "opponent", "venue", "official", F.explode(F.array(*[one(m) for m in markets])).alias("f")
    ).select("event_id", "season", "event_date", "side", "opponent", "venue", "official", "f.*")


def forecast_errors(rows: DataFrame, keys: Sequence[str], prediction: str = "prediction", target: str = "target") -> DataFrame:
    """Count, MAE, RMSE and bias by key over rows with a target."""
    e = F.col(prediction) - F.col(target)
    return rows.filter(e.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")
    )


def over_lines(rows: DataFrame, markets: Sequence[Market], min_fair: float | None = None) -> DataFrame:
    """One row per line with over/under probability and fair odds.

    With ``min_fair`` only the likeliest line of each forecast whose fair odds
    reach it (the lower one of a tie): all lines are priced, but never become rows.
    """
    if min_fair is not None:
        return with_prices(_likeliest_lines(rows, markets, min_fair))
    lines = by_market(markets, lambda m: F.array(*[F.lit(x) for x in m.lines]))
    priced = rows.withColumn("line", F.explode(lines))
    return with_prices(priced.withColumn("p_over", pr.over_of(F.col("prediction"), alpha_of(markets), F.col("line"))))


def _likeliest_lines(rows: DataFrame, markets: Sequence[Market], min_fair: float) -> DataFrame:
    places = range(max(len(m.lines) for m in markets))
    line = {i: by_market(markets, lambda m: F.lit(m.lines[i] if i < len(m.lines) else None)).cast("double") for i in places}
    priced = rows.withColumns({f"_p{i}": pr.over_of(F.col("prediction"), alpha_of(markets), line[i]) for i in places})
    fair = lambda i: line[i].isNotNull() & (pr.fair_odds(F.col(f"_p{i}")) >= min_fair)
    best = F.array_max(F.array(*[F.when(fair(i), F.struct(F.col(f"_p{i}").alias("p"), (-line[i]).alias("n"))) for i in places]))
    found = priced.withColumn("_best", best).filter("_best IS NOT NULL")
    return found.select(*rows.columns, (-F.col("_best.n")).alias("line"), F.col("_best.p").alias("p_over"))


def with_prices(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p_under", 1.0 - F.col("p_over")).withColumns(
        {"fair_over": pr.fair_odds(F.col("p_over")), "fair_under": pr.fair_odds(F.col("p_under"))}
    )


def total_forecasts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two side forecasts of a market to one total with both means (``mu_a``, ``mu_b``)."""
    at = lambda v: F.max(F.when(F.col("venue") == v, F.col("prediction")))
    return rows.groupBy(*keys, "market").agg(at("H").alias("mu_a"), at("A").alias("mu_b")).select(
        *keys, F.concat("market", F.lit("_total")).alias("market"), "mu_a", "mu_b", (F.col("mu_a") + F.col("mu_b")).alias("prediction")
    )


def forecast_overview(scored: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One prediction per fixture, side and market of priced rows: the first by ``order``."""
    return scored.groupBy(*keys, "side", "market").agg(F.min_by("prediction", ordered_by(scored, [F.col(c) for c in order])).alias("prediction"))


def total_dispersion(markets: Sequence[Market]) -> Column:
    return pr.total_alpha(F.col("mu_a"), F.col("mu_b"), alpha_of(markets))


def over_total_lines(totals: DataFrame, markets: Sequence[Market]) -> DataFrame:
    """Half-lines around each total; the dispersion matches the variance of the two sides' sum."""
    lined = totals.withColumn("line", F.explode(pr.total_lines(F.col("prediction"))))
    return with_prices(lined.withColumn("p_over", pr.over_of(F.col("prediction"), total_dispersion(markets), F.col("line"))))


def wide_lines(scored: DataFrame, keys: Sequence[str], lines: Sequence[float]) -> DataFrame:
    """One row per forecast with rounded probability and odds columns per line."""
    key = lambda x: str(x).replace(".", "_")
    at = lambda x, c, d, n: F.round(F.max(F.when(F.col("line") == x, F.col(c))), d).alias(f"{n}_{key(x)}")
    return scored.groupBy(*keys).agg(
        *[a for x in lines for a in (at(x, "p_over", 5, "p_over"), at(x, "fair_over", 3, "fair_over"), at(x, "p_under", 5, "p_under"), at(x, "fair_under", 3, "fair_under"))]
    )


def brier(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brier score by key; rows carry ``line``, ``p_over`` and ``target``."""
    hit = (F.col("target") > F.col("line")).cast("double")
    return scored.filter("target IS NOT NULL").groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((F.col("p_over") - hit) * (F.col("p_over") - hit)).alias("brier")
    )


def calibration(scored: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Right-closed probability bins (the first also holds 0) with predicted and actual share."""
    hit = (F.col("target") > F.col("line")).cast("double")
    edge = F.when(F.col("p_over") == 0, 1)
    for b in range(1, bins + 1):
        edge = edge.when(F.col("p_over") <= b / bins, b)
    return scored.filter("target IS NOT NULL").withColumn("bin", edge).groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg("p_over").alias("predicted"), F.avg(hit).alias("actual")
    )


def full_seasons(rows: DataFrame, least: int = 700) -> DataFrame:
    return rows.groupBy("season").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def training_metadata(rows: DataFrame, target: str) -> DataFrame:
    """Training mean, row count and season list of one target."""
    return rows.filter(F.col(target).isNotNull()).agg(
        F.avg(target).alias("train_mean"), F.count("*").alias("train_rows"), F.array_join(F.array_sort(F.collect_set("season")), ",").alias("seasons")
    )


def fill_ranges(log: DataFrame, markets: Sequence[Market], fixture: Sequence[str]) -> DataFrame:
    """Fill missing likeliest ranges only; a total uses its two sibling forecasts when both exist."""
    base = F.regexp_replace("market", "_total$", "")
    total = F.col("market").endswith("_total")
    # Order of the two sides does not matter: the total dispersion is symmetric. A window moves the log once, and not at all
    # where it lies by fixtures already; rows without a whole fixture have no siblings.
    own_row = F.when(~total & reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in fixture]), F.col("prediction"))
    family = Window.partitionBy(*fixture, "_base")
    rows = log.withColumns({"_base": base, "_own": own_row}).withColumns(
        {"_lo": F.min("_own").over(family), "_hi": F.max("_own").over(family), "_n": F.count("_own").over(family)}
    )
    a, b = pr.mean_of(F.col("_lo")), pr.mean_of(F.col("_hi"))
    own = alpha_of(markets)
    dispersion = F.when(total & (F.col("_n") >= 2), F.coalesce(_summed_alpha(F.col("prediction"), a, b, own), own)).otherwise(own)
    missing = F.col("range_low").isNull() | F.col("range_high").isNull() | F.col("range_probability").isNull()
    known = width_of(markets).isNotNull() & F.col("prediction").isNotNull()
    shaped = rows.withColumns({"_f": pr.family(F.col("prediction"), dispersion), "_w": F.when(missing & known, width_of(markets))})
    filled = shaped.withColumn("_best", F.when(F.col("_w").isNotNull(), pr.best_range(F.col("_f"), F.col("_w"))))
    pick = lambda c, f: F.when(F.col("_best").isNotNull(), F.col(f"_best.{f}")).otherwise(F.col(c))
    return filled.withColumns(
        {
            "range_low": pick("range_low", "low").cast("bigint"),
            "range_high": pick("range_high", "high").cast("bigint"),
            "range_probability": pick("range_probability", "probability"),
        }
    ).select(*log.columns)


def _summed_alpha(mu: Column, a: Column, b: Column, alpha: Column) -> Column:
    m = pr.mean_of(mu)
    var = a + alpha * a * a + b + alpha * b * b
    return F.when((alpha > 0) & (var > m), (var - m) / (m * m))


def exact_medians(df: DataFrame, columns: Sequence[str], buckets: int = 256, small: int = 4096, collected: int = 65_536) -> dict[str, float | None]:
    """Exact medians of many columns by narrowing value ranges.

    Every pass is one aggregate that returns at most ``buckets`` counts per
    column, so no task ever holds a column.  A column is finished when the
    range around its middle ranks holds few distinct values; what a pass sends
    to the driver is bounded by ``collected`` rows for all columns together.
    NaN and infinite values count as missing.
    """
    share = max(1, collected // max(1, len(columns)))
    small, buckets = min(small, share), max(2, min(buckets, share))
    real = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double"))
    df = df.select(*[real(c).alias(c) for c in columns])
    first = df.agg(*[f(c).alias(f"{c}|{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]).first()
    state, out = {}, {}
    for c in columns:
        n = first[f"{c}|n"]
        if n == 0:
            out[c] = None
        else:
            state[c] = dict(lo=float(first[f"{c}|lo"]), hi=float(first[f"{c}|hi"]), below=0, inside=n, ranks=((n - 1) // 2, n // 2))
    while state:
        done = [c for c, s in state.items() if s["inside"] <= small or s["lo"] == s["hi"]]
        if done:
            spans = [_between(c, state[c]["lo"], state[c]["hi"]) for c in done]
            tall = df.select(F.explode(F.array(*spans)).alias("v")).filter("v.x IS NOT NULL").groupBy("v.c", "v.x").count()
            values: dict[str, list] = {c: [] for c in done}
            for r in tall.collect():  # at most `small` rows per column
                values[r["c"]].append((r["x"], r["count"]))
            for c in done:
                s, seen, found = state.pop(c), 0, []
                seen = s["below"]
                for x, k in sorted(values[c]):
                    found += [x for rank in s["ranks"] if seen <= rank < seen + k]
                    seen += k
                out[c] = sum(found) / 2.0
            continue
        cells = []
        for c, s in state.items():
            width = (s["hi"] - s["lo"]) / buckets
            inside = F.col(c).between(s["lo"], s["hi"])
            cell = F.least(F.floor((F.col(c) - s["lo"]) / width), F.lit(buckets - 1))
            cells.append(F.struct(F.lit(c).alias("c"), F.when(inside, cell).alias("b"), F.col(c).cast("double").alias("x")))
        counts = df.select(F.explode(F.array(*cells)).alias("v")).filter("v.b IS NOT NULL").groupBy("v.c", "v.b").agg(
            F.count("*").alias("k"), F.min("v.x").alias("lo"), F.max("v.x").alias("hi")
        )
        found = {}
        for r in counts.collect():  # at most `buckets` rows per column
            found.setdefault(r["c"], []).append((r["b"], r["k"], r["lo"], r["hi"]))
        for c, s in state.items():
            seen, keep = s["below"], []
            for b, k, lo, hi in sorted(found[c]):
                if any(seen <= rank < seen + k for rank in s["ranks"]):
                    keep.append((seen, k, lo, hi))
                seen += k
            s.update(lo=keep[0][2], hi=keep[-1][3], below=keep[0][0], inside=sum(k for _, k, _, _ in keep))
            if len(keep) == 2 and s["inside"] > small:
                # The middle falls between two buckets: its ends are known exactly.
                out[c] = (keep[0][3] + keep[1][2]) / 2.0
        for c in [c for c in state if c in out]:
            state.pop(c)
    return out


def _between(c: str, lo: float, hi: float) -> Column:
    return F.struct(F.lit(c).alias("c"), F.when(F.col(c).between(lo, hi), F.col(c).cast("double")).alias("x"))


def impute(df: DataFrame, medians: Mapping[str, float | None], flagged: Sequence[str]) -> DataFrame:
    """Median-filled ``x_<c>`` and, for columns with gaps in training, ``gap_<c>`` indicators."""
    fill = {f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(m if m is not None else 0.0)) for c, m in medians.items()}
    return df.withColumns(fill | {f"gap_{c}": F.col(c).isNull().cast("double") for c in flagged})


def columns_with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c]]


def market_inputs(market: str) -> list[str]:
    """Inputs of a market's forest: own, opponent's, official's, league's and head-to-head histories."""
    m, both = market, ("for", "against")
    own = [f"{h}_{m}_{d}_avg" for h in ("season", "venue") for d in both] + [f"last{n}_{m}_{d}_avg" for d in both for n in (3, 5, 10)]
    own += [f"career_last5_{m}_{d}_avg" for d in both]
    other = [f"opp_{h}_{m}_{d}_avg" for h in ("season", "venue") for d in both] + [f"opp_last{n}_{m}_against_avg" for n in (3, 5, 10)]
    other += [f"opp_career_last5_{m}_against_avg"]
    official = [f"{h}_total_{m}_avg_before" for h in ("official", "official_last5", "official_all", "official_all_last10")]
    venues = [f"league_{s}_{m}_avg_before" for s in ("a", "b")]
    league = [f"league_total_{m}_avg_before", f"recent20_league_total_{m}_avg_before"]
    rest = [f"h2h_{m}_for_avg_before", f"h2h_last3_{m}_for_avg_before", "days_rest", "opp_days_rest"]
    volume = ["season_qty_for_avg", "last5_qty_for_avg", "opp_season_qty_against_avg", "opp_last5_qty_against_avg"]
    if market == "qty":
        return [*own, *other, *official, *league, *venues, *rest]
    if market == "lines":  # no official; volume in place of it
        return [*own, *other, *league, *rest, *volume]
    return [*own, *other, *[f"official_{s}_{m}_avg_before" for s in ("a", "b")], *official, *league, *volume, *rest]


def forest_rows(features: DataFrame, markets: Sequence[Market]) -> DataFrame:
    """Long training rows: part (the market), season, event_id, side, target ``y``, inputs ``x`` and what the baseline reads."""
    one = lambda m: F.struct(
        F.lit(m.name).alias("part"), F.col(f"target_{m.target}").cast("double").alias("y"), F.array(*[F.col(c).cast("float") for c in market_inputs(m.name)]).alias("x"),
        baseline(m, F.lit(None).cast("double")).alias("known_baseline"),
    )
    return features.select("event_id", "season", "side", F.explode(F.array(*[one(m) for m in markets])).alias("r")).select("event_id", "season", "side", "r.*")


def train_means(rows: DataFrame, folds: Mapping[str, str | None]) -> DataFrame:
    """(part, fold, train_mean) over the rows each fold learns from."""
    bounds = rows.sparkSession.createDataFrame([(f, b) for f, b in folds.items()], "fold string, bound string")
    per = rows.filter("y IS NOT NULL").groupBy("part", "season").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    met = per.join(F.broadcast(bounds), F.col("bound").isNull() | (F.col("season") < F.col("bound")))
    return met.groupBy("part", "fold").agg((F.sum("s") / F.sum("n")).alias("train_mean"))


def with_ensemble(scored: DataFrame, means: DataFrame, markets: Sequence[Market]) -> DataFrame:
    """Adds the walk-forward ``baseline`` and the ``ensemble`` of it with the forest; (part, fold, known_baseline, model_prediction, ...)."""
    rows = scored.join(means, ["part", "fold"]).withColumn("baseline", F.coalesce("known_baseline", "train_mean")).withColumn("market", F.col("part"))
    weight, floor = by_market(markets, lambda m: F.lit(m.model_weight)), by_market(markets, lambda m: F.lit(m.floor))
    mixed = F.col("model_prediction") * weight + F.col("baseline") * (F.lit(1.0) - weight)
    return rows.withColumn("ensemble", F.greatest(mixed, floor)).drop("known_baseline", "train_mean", "part")
