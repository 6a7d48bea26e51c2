"""Season, venue, form, distribution and standings tables.

Every aggregate combines on the map side, so a key holding a third of the
rows costs no more than any other.  Form and standings work on day grain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinside.operators.sides import for_against, tall_metrics


def mean_columns(columns: Sequence[str], suffix: str = "avg") -> list[Column]:
    return [F.avg(c).alias(f"{c}_{suffix}") for c in columns]


def dimension(df: DataFrame, entity: str) -> DataFrame:
    """First and last season of each entity; active when last seen in the newest season."""
    spans = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.min("season").alias("first_season"), F.max("season").alias("last_season")
    )
    newest = spans.agg(F.max("last_season")).scalar()
    return spans.select(entity, "first_season", "last_season", (F.col("last_season") == newest).alias("active"))


def profile(sides: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Matches, W/D/L, points and means by key."""
    return sides.groupBy(*keys).agg(
        F.count("*").alias("matches"),
        *[F.count_if(F.col("result") == r).alias(n) for r, n in (("W", "wins"), ("D", "draws"), ("L", "losses"))],
        F.sum(F.coalesce("points", F.lit(0))).alias("points"),
        *mean_columns(for_against(metrics)),
    )


def profiles(sides: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Season and season-by-venue profiles from one pass; ``venue`` is null on the season level.

    Reduced by venue once; the season level adds up those few rows instead of
    reading the facts a second time.
    """
    cols = for_against(metrics)
    fine = sides.groupBy("season", "side", "venue").agg(
        F.count("*").alias("matches"),
        *[F.count_if(F.col("result") == r).alias(n) for r, n in (("W", "wins"), ("D", "draws"), ("L", "losses"))],
        F.sum(F.coalesce("points", F.lit(0))).alias("points"),
        *[F.sum(c).alias(f"_s_{c}") for c in cols],
        *[F.count(c).alias(f"_n_{c}") for c in cols],
    )
    levels = fine.withColumn("venue", F.explode(F.array(F.col("venue"), F.lit(None).cast("string"))))
    return levels.groupBy("season", "side", "venue").agg(
        *[F.sum(c).alias(c) for c in ("matches", "wins", "draws", "losses", "points")],
        *[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(f"{c}_avg") for c in cols],
    )


def league_season(contests: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Season means of totals (both sides needed) and of each side."""
    return contests.groupBy("season").agg(
        F.count("*").alias("matches"),
        *[F.avg(F.col(f"a_{m}") + F.col(f"b_{m}")).alias(f"{m}_avg") for m in metrics],
        *[F.avg(f"{s}_{m}").alias(f"{s}_{m}_avg") for m in metrics for s in ("a", "b")],
    )


def form(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    windows: Sequence[int] = (3, 5, 10),
    day: str = "event_date",
    tie: str = "event_id",
) -> DataFrame:
    """Per key and day: mean of the last ``w`` rows up to and including that day.

    Only the newest ``max(windows)`` rows of a day can matter; the limited
    ranking drops the others before the shuffle, which bounds a key by its
    calendar however many events it has.
    """
    deepest = max(windows)
    newest = Window.partitionBy(*keys, day).orderBy(F.desc(tie))
    w = Window.partitionBy(*keys).orderBy(day, tie)

    def at(n: int) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        return F.struct(
            F.lit(n).alias("window"),
            F.count("*").over(frame).alias("matches_used"),
            *[F.avg(c).over(frame).alias(f"{c}_avg") for c in columns],
        )

    return (
        df.select(*keys, day, tie, *columns)
        .withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= deepest)
        .select(*keys, F.col(day).alias("as_of_date"), "_back", F.array(*[at(n) for n in windows]).alias("_w"))
        .filter("_back = 1")
        .select(*keys, "as_of_date", F.explode("_w").alias("_f"))
        .select(*keys, "as_of_date", "_f.*")
    )


def tail_rows(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str] = ("event_date", "event_id")) -> DataFrame:
    """The newest ``n`` rows of each key with ``back`` = 1 for the newest; limited before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def latest_rolling(sides: DataFrame, metrics: Sequence[str], windows: Sequence[int] = (3, 5, 10)) -> DataFrame:
    """Newest means by (season, side), scope ALL/HOME/AWAY and window (0 = whole season)."""
    cols = for_against(metrics)
    whole = profiles(sides, metrics).select(
        "season", "side", _scope(F.col("venue")).alias("scope"), F.lit(0).alias("window"),
        F.col("matches").alias("matches_used"), *[f"{c}_avg" for c in cols],
    )
    # The last n of a whole season are among the last n of each venue.
    deepest = max(windows)
    tails = tail_rows(sides.select("season", "side", "venue", "event_date", "event_id", *cols), ["season", "side", "venue"], deepest)
    scoped = tails.drop("back").withColumn("scope", F.explode(F.array(F.lit("ALL"), _scope(F.col("venue")))))
    last = tail_rows(scoped, ["season", "side", "scope"], deepest)
    per_window = last.withColumn("window", F.explode(F.array(*[F.lit(n) for n in windows]))).filter("back <= window")
    recent = per_window.groupBy("season", "side", "scope", "window").agg(
        F.count("*").alias("matches_used"), *mean_columns(cols)
    )
    as_of = sides.groupBy("season", "side").agg(F.max("event_date").alias("as_of_date"))
    return whole.unionByName(recent).join(as_of, ["season", "side"])


def _scope(venue: Column) -> Column:
    return F.when(venue == "H", "HOME").when(venue == "A", "AWAY").otherwise("ALL")


def value_histogram(sides: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count of each metric value by (season, side, scope, metric).

    Metrics are counts, so distinct values per group are few: the histogram
    replaces the raw rows for exact quantiles and hit rates.
    """
    tall = tall_metrics(sides, ["season", "side", "venue"], columns, "metric", "value")
    fine = tall.groupBy("season", "side", "venue", "metric", "value").agg(F.count("*").alias("n"))
    return (
        fine.withColumn("scope", F.explode(F.array(F.lit("ALL"), _scope(F.col("venue")))))
        .groupBy("season", "side", "scope", "metric", "value")
        .agg(F.sum("n").alias("n"))
    )


def distribution(hist: DataFrame) -> DataFrame:
    """Count, mean, median, sample deviation (0 for one row), quartiles and range from a histogram."""
    n, x = F.col("n"), F.col("value")
    moments = hist.groupBy("season", "side", "scope", "metric").agg(
        F.sum(n).alias("matches"),
        F.sum(n * x).alias("_s"),
        F.sum(n * x * x).alias("_q"),
        F.percentile(x, [0.25, 0.5, 0.75], n).alias("_p"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
    )
    spread = F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * F.col("_s") / F.col("matches"))
    return moments.select(
        "season", "side", "scope", "metric", "matches",
        (F.col("_s") / F.col("matches")).alias("mean"),
        F.col("_p")[1].alias("median"),
        F.when(F.col("matches") > 1, F.sqrt(F.try_divide(spread, F.col("matches") - 1))).otherwise(0.0).alias("std"),
        "minimum",
        F.col("_p")[0].alias("p25"),
        F.col("_p")[2].alias("p75"),
        "maximum",
    )


def threshold_rates(hist: DataFrame, lines: Mapping[str, Sequence[float]]) -> DataFrame:
    """Share of rows strictly above each metric's lines, from a histogram."""
    by_metric = F.create_map(
        *[x for m, ls in lines.items() for x in (F.lit(m), F.array(*[F.lit(float(v)) for v in ls]))]
    )
    return (
        hist.filter(F.col("metric").isin(*lines))
        .withColumn("line", F.explode(by_metric[F.col("metric")]))
        .groupBy("season", "side", "scope", "metric", "line")
        .agg(F.sum("n").alias("matches"), F.sum(F.when(F.col("value") > F.col("line"), F.col("n")).otherwise(0)).alias("hits"))
        .withColumn("hit_rate", F.col("hits") / F.col("matches"))
    )


def daily_table(sides: DataFrame) -> DataFrame:
    """Table contributions by season, side and day: the only pass over the facts."""
    return sides.groupBy("season", "side", "event_date").agg(
        F.count("*").alias("played"),
        *[F.count_if(F.col("result") == r).alias(n) for r, n in (("W", "wins"), ("D", "draws"), ("L", "losses"))],
        F.sum(F.coalesce("score_for", F.lit(0))).alias("scored"),
        F.sum(F.coalesce("score_against", F.lit(0))).alias("conceded"),
        F.sum(F.coalesce("points", F.lit(0))).alias("points"),
    )


TABLE_COLUMNS = ("played", "wins", "draws", "losses", "scored", "conceded", "points")


def _season_spine(daily: DataFrame) -> DataFrame:
    """Every side of a season on every day of that season.

    A season has at most a year of days, so the day list of one season is a
    bounded array; each side row is exploded over it (the output's own size).
    """
    days = daily.groupBy("season").agg(F.collect_set("event_date").alias("_days"))
    entrants = daily.select("season", "side").distinct()
    return entrants.join(days, "season").select("season", "side", F.explode("_days").alias("event_date"))


def standings(sides: DataFrame) -> DataFrame:
    """Table after each day; sides without an event so far are absent."""
    run = _running(daily_table(sides), 0).filter("played > 0")
    return run.select(
        "season", F.col("event_date").alias("as_of_date"), "side", *TABLE_COLUMNS[:4],
        F.col("scored"), F.col("conceded"), (F.col("scored") - F.col("conceded")).alias("difference"), "points",
        _position("event_date").alias("position"),
    )


def table_before(sides: DataFrame) -> DataFrame:
    """Table before each day with every side of the season, kept for sides active that day."""
    daily = daily_table(sides)
    run = _running(daily, -1).select(
        "season", "event_date", "side", "_active", "points", (F.col("scored") - F.col("conceded")).alias("difference"),
        "played", _position("event_date").alias("position"),
    )
    return run.filter("_active").select(
        "season", "event_date", "side", F.col("position").alias("position_before"),
        F.col("points").alias("table_points_before"), F.col("difference").alias("table_diff_before"),
        F.col("played").alias("table_played_before"),
    )


def _running(daily: DataFrame, end: int) -> DataFrame:
    w = Window.partitionBy("season", "side").orderBy("event_date").rowsBetween(Window.unboundedPreceding, end)
    spine = _season_spine(daily).join(daily.withColumn("_active", F.lit(True)), ["season", "side", "event_date"], "left")
    return spine.select(
        "season", "side", "event_date", F.coalesce("_active", F.lit(False)).alias("_active"),
        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in TABLE_COLUMNS],
    )


def _position(day: str) -> Column:
    w = Window.partitionBy("season", day).orderBy(
        F.desc("points"), F.desc(F.col("scored") - F.col("conceded")), F.desc("scored"), F.asc("side")
    )
    return F.row_number().over(w)


def latest_standings(table: DataFrame) -> DataFrame:
    """The newest day of each season, in table order."""
    newest = table.groupBy("season").agg(F.max("as_of_date").alias("as_of_date"))
    return table.join(newest, ["season", "as_of_date"])


def side_dashboard(sides: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Newest season: table row, season means and last-five means per side."""
    current = newest_season(sides)
    cols = for_against(metrics)
    table = latest_standings(standings(current)).select("season", "side", "position", "points", "played")
    last = tail_rows(current, ["season", "side"], 5).groupBy("season", "side").agg(
        F.avg("points").alias("last5_points_avg"), *[F.avg(c).alias(f"last5_{c}_avg") for c in cols]
    )
    return (
        profile(current, ["season", "side"], metrics)
        .select("season", "side", "matches", *[f"{c}_avg" for c in cols])
        .join(table.withColumn("ppg", F.try_divide("points", "played")).drop("played"), ["season", "side"], "left")
        .join(last, ["season", "side"])
    )


def newest_season(df: DataFrame) -> DataFrame:
    return df.filter(F.col("season") == df.agg(F.max("season")).scalar())


def official_means(officials: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return officials.groupBy(*keys).agg(F.count("*").alias("matches"), *mean_columns(columns))


def official_dashboard(officials: DataFrame, columns: Sequence[str], recent: Sequence[str]) -> DataFrame:
    current = newest_season(officials)
    last = tail_rows(current, ["season", "official"], 5).groupBy("season", "official").agg(
        *[F.avg(c).alias(f"last5_{c}_avg") for c in recent]
    )
    return official_means(current, ["season", "official"], columns).join(last, ["season", "official"])
