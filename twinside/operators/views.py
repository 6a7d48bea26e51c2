"""Validated observations, rankings, comparisons, streaks and official impact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinside.functions.calendar import clock_minutes, last_seasons, season_key
from twinside.functions.numbers import finite_from_zero, valid_count
from twinside.functions.text import is_blank, person_name, reversed_score
from twinside.operators.aggregates import tail_rows
from twinside.operators.joins import many, without_repeated
from twinside.operators.quality import pair_verdicts

PERSPECTIVES = ("for", "against", "total")


def match_statistics(contests: DataFrame, sides: DataFrame, metrics: Sequence[str], identity: Sequence[str] = ("season", "side_a", "side_b")) -> DataFrame:
    """One row per contest that is beyond doubt, with totals that need both sides.

    Identical copies count once; repeated ids or identities are dropped whole.
    Pairings that meet more than once in a season name their leg in ``identity``.
    """
    unique = without_repeated(contests.distinct(), ["event_id"])
    unique = without_repeated(unique, list(identity))
    rows = sides.distinct()
    good = pair_verdicts(rows).filter("reason IS NULL").select("event_id")
    counted = lambda v, m: F.max(F.when(F.col("venue") == v, valid_count(F.col(f"{m}_for"))))
    pairs = rows.groupBy("event_id").agg(
        F.max(F.when(F.col("venue") == "H", F.struct("side", "opponent", "season"))).alias("_h"),
        *[(counted("H", m) + counted("A", m)).alias(f"total_{m}") for m in metrics],
    )
    scores = [valid_count(F.col(f"{s}_score")) for s in ("a", "b")]
    clock = F.trim("kickoff_time")
    return (
        unique.filter(F.col("event_date").isNotNull() & F.col("season").isNotNull() & scores[0].isNotNull() & scores[1].isNotNull())
        .join(many(good), "event_id", "left_semi")
        .join(many(pairs), "event_id")
        .filter("_h.side = side_a AND _h.opponent = side_b AND _h.season = season")
        .select(
            "event_id", "season", "event_date",
            F.coalesce(F.when(clock_minutes(clock).isNotNull(), clock), F.lit("unknown")).alias("kickoff"),
            clock_minutes(clock).alias("kickoff_minutes"),
            F.concat_ws(":", scores[0].cast("bigint"), scores[1].cast("bigint")).alias("score"),
            "side_a", "side_b",
            F.coalesce(F.trim("official"), F.lit("")).alias("official"),
            *[f"total_{m}" for m in metrics],
        )
    )


def side_observations(matches: DataFrame, sides: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Two rows per accepted contest with own, opponent and total counts of each metric."""
    own = sides.distinct().select(
        "event_id", "side", "opponent", "venue",
        *[valid_count(F.col(f"{m}_{d}")).alias(f"{m}_{d}") for m in metrics for d in ("for", "against")],
    )
    score = F.when(F.col("venue") == "H", F.col("score")).otherwise(reversed_score(F.col("score")))
    totals = {f"{m}_total": F.col(f"{m}_for") + F.col(f"{m}_against") for m in metrics}
    return (
        own.join(many(matches.select("event_id", "season", "event_date", "kickoff_minutes", "score")), "event_id")
        .withColumns({"score": score, **totals})
    )


def actual_context(history: DataFrame) -> DataFrame:
    """Who was at home, and the score as played, for a side's view of its events."""
    home = F.col("venue") == "H"
    return history.withColumns(
        {
            "side_a": F.when(home, F.col("side")).otherwise(F.col("opponent")),
            "side_b": F.when(home, F.col("opponent")).otherwise(F.col("side")),
            "score": F.when(home, F.col("score")).otherwise(reversed_score(F.col("score"))),
        }
    )


def summary_columns(c: str) -> list[Column]:
    x = valid_count(F.col(c))
    return [
        F.count(x).alias("valid_n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("minimum"), F.max(x).alias("maximum"),
    ]


def ranking(rows: DataFrame, entity: str, value: str, keys: Sequence[str] = ("season",)) -> DataFrame:
    """Entities by mean with competition rank; those without a valid value come unranked."""
    table = rows.filter(~is_blank(F.col(entity))).groupBy(*keys, entity).agg(F.count("*").alias("matches"), *summary_columns(value))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("mean")))
    return table.withColumn("place", F.when(F.col("mean").isNotNull(), rank))


def league_reference(rows: DataFrame, metric: str, perspective: str, keys: Sequence[str] = ("season",)) -> DataFrame:
    """Summary over all sides; a total counts each contest once."""
    if perspective not in PERSPECTIVES:
        raise ValueError(f"unknown perspective {perspective}")
    if perspective == "total":
        rows = rows.dropDuplicates(["event_id"])
    return rows.groupBy(*keys).agg(*summary_columns(f"{metric}_{perspective}"))


def compare_with_league(rows: DataFrame, entity: str, values: Sequence[str], once: str | None = None, keys: Sequence[str] = ("season",)) -> DataFrame:
    """Entity and league mean per metric with their difference and both counts.

    ``once`` names the column that identifies a contest when the league side
    must count each contest once.
    """
    pack = lambda: F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), valid_count(F.col(v)).alias("x")) for v in values])).alias("m")
    own = rows.select(*keys, entity, pack()).groupBy(*keys, entity, "m.metric").agg(F.avg("m.x").alias("own_mean"), F.count("m.x").alias("own_n"))
    base = rows.dropDuplicates([once]) if once else rows
    league = base.select(*keys, pack()).groupBy(*keys, "m.metric").agg(F.avg("m.x").alias("league_mean"), F.count("m.x").alias("league_n"))
    return own.join(league, [*keys, "metric"]).withColumn("difference", F.col("own_mean") - F.col("league_mean"))


def classed_history(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Valid observations against the entity's own mean: difference and Over / Under / Equal.

    The mean comes from an aggregate joined back by key, so no entity has to
    fit into one window.
    """
    x = rows.withColumn("value", valid_count(F.col(value))).filter("value IS NOT NULL")
    mean = x.groupBy(*keys).agg(F.avg("value").alias("mean"))
    kind = F.when(F.col("value") > F.col("mean"), "Over").when(F.col("value") < F.col("mean"), "Under").otherwise("Equal")
    return x.join(mean, list(keys)).withColumns({"difference": F.col("value") - F.col("mean"), "category": kind})


def run_lengths(classed: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Longest and mean run of Over and Under, and the current run, per key.

    Rows are dealt into ranges of (key, order), so a key or a day of any size
    is spread over slices. Runs are built inside each (key, slice); runs that
    touch a slice's edge, two at most, meet in the window over a key's slices.
    """
    day, within = "_slice", list(order)
    ranges = [slices] if slices else []
    classed = classed.select(*keys, *order, "category").repartitionByRange(*ranges, *keys, *order).withColumn(day, F.spark_partition_id())
    # Runs inside one slice.
    inside = Window.partitionBy(*keys, day).orderBy(*within)
    by_class = Window.partitionBy(*keys, day, "category").orderBy(*within)
    island = F.row_number().over(inside) - F.row_number().over(by_class)
    parts = (
        classed.withColumns({"_i": island, "_p": F.row_number().over(inside)})
        .groupBy(*keys, day, "category", "_i")
        .agg(F.count("*").alias("n"), F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    )
    ends = Window.partitionBy(*keys, day)
    edged = parts.withColumns({"_head": F.col("_first") == F.min("_first").over(ends), "_tail": F.col("_last") == F.max("_last").over(ends)})
    closed = edged.filter("NOT _head AND NOT _tail")
    # Runs touching a slice's edge may go on across slices.
    edge = edged.filter("_head OR _tail")
    w = Window.partitionBy(*keys).orderBy(day, "_first")
    previous = F.lag(F.struct("category", day, "_tail")).over(w)
    # A neighbour continues the run when it has the same class and nothing lies between them.
    starts = ~F.coalesce(
        (previous["category"] == F.col("category")) & (previous[day] != F.col(day)), F.lit(False)
    )
    joined = (
        edge.withColumn("_new", starts.cast("int"))
        .withColumn("_run", F.sum("_new").over(w))
        .groupBy(*keys, "_run", "category")
        .agg(F.sum("n").alias("n"), F.max(F.struct(day, "_last")).alias("_end"))
    )
    runs = joined.select(*keys, "category", "n", "_end").unionByName(
        closed.select(*keys, "category", "n", F.struct(F.col(day), F.col("_last")).alias("_end"))
    )
    stat = lambda kind, f: f(F.when(F.col("category") == kind, F.col("n")))
    return runs.groupBy(*keys).agg(
        *[stat(k, F.max).alias(f"longest_{k.lower()}") for k in ("Over", "Under")],
        *[stat(k, F.avg).alias(f"mean_{k.lower()}") for k in ("Over", "Under")],
        F.max_by("category", "_end").alias("current_category"),
        F.max_by("n", "_end").alias("current_length"),
    )


def recent_form(classed: DataFrame, keys: Sequence[str], n: int = 5, order: Sequence[str] = ("event_date", "event_id")) -> DataFrame:
    """Mean of the newest ``n`` valid observations against the mean of all."""
    last = tail_rows(classed, keys, n, order)
    return last.groupBy(*keys).agg(
        F.count("*").alias("recent_n"), F.avg("value").alias("recent_mean"), F.any_value("mean").alias("mean")
    ).withColumn("difference", F.col("recent_mean") - F.col("mean"))


def cross_table(sides: DataFrame, standings: DataFrame, columns: Sequence[str], venue: str = "H") -> DataFrame:
    """Per season, selected side and table row: own venue means on its own row, else the single meeting's values.

    A cell is null unless the two sides met exactly once at that venue.
    """
    rows = sides.filter(F.col("venue") == venue)
    own = rows.groupBy("season", "side").agg(*[F.avg(c).alias(c) for c in columns])
    met = rows.groupBy("season", "side", "opponent").agg(
        F.count("*").alias("_n"), *[F.max(c).alias(f"_{c}") for c in columns]
    ).select("season", "side", "opponent", *[F.when(F.col("_n") == 1, F.col(f"_{c}")).alias(c) for c in columns])
    cells = own.withColumn("opponent", F.col("side")).unionByName(met)
    place = standings.select("season", F.col("side").alias("opponent"), "position")
    return cells.join(place, ["season", "opponent"]).select("season", "side", "position", "opponent", *columns)


def venue_table(sides: DataFrame, standings: DataFrame, columns: Sequence[str], venue: str = "H") -> DataFrame:
    """Every side's own venue means in table order (no side selected)."""
    own = sides.filter(F.col("venue") == venue).groupBy("season", "side").agg(*[F.avg(c).alias(c) for c in columns])
    return standings.select("season", "side", "position").join(own, ["season", "side"], "left")


def standings_violations(latest: DataFrame) -> DataFrame:
    """Per season: repeated sides or positions, and positions that are not positive whole numbers."""
    return latest.groupBy("season").agg(
        (F.count("*") - F.countDistinct("side")).alias("repeated_sides"),
        (F.count("*") - F.countDistinct("position")).alias("repeated_positions"),
        F.count_if(F.col("position").isNull() | (F.col("position") <= 0) | (F.col("position") % 1 != 0)).alias("bad_positions"),
    )


def official_observations(officials: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Official rows beyond doubt: identical copies once, conflicting copies not at all."""
    rows = without_repeated(officials.distinct(), ["event_id"]).dropna(subset=["event_id", "event_date", "official", "side_a", "side_b"])
    return rows.filter(~is_blank(F.col("official"))).withColumns({c: finite_from_zero(F.col(c)) for c in columns})


def official_summary(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy("season", "official").agg(F.count("*").alias("matches"), *[F.avg(c).alias(f"{c}_avg") for c in columns])


def official_detail(rows: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """Season and last-``n`` means per official."""
    season = official_summary(rows, columns).withColumn("span", F.lit("season"))
    last = official_summary(tail_rows(rows, ["season", "official"], n), columns).withColumn("span", F.lit("form"))
    return season.unionByName(last)


def sign_against_mean(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per row and column: 1 above, -1 below, 0 on the unrounded key mean; null stays null."""
    mean = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return rows.join(mean, list(keys)).select(
        "event_id", *keys, *[F.signum(F.col(c) - F.col(f"_m_{c}")).cast("int").alias(f"{c}_sign") for c in columns]
    )


IMPACT_WEIGHTS = (0.5, 0.3, 0.2)  # fixed values: newest season first


def official_impact(officials: DataFrame, league: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Official mean over league mean, weighted over the newest three seasons, as extra counts per contest.

    ``league`` holds one row per season with ``<m>_avg``.  Weights are shared
    out again over the seasons in which a coefficient exists.
    """
    newest = league.agg(F.max_by("season", season_key(F.col("season")))).scalar()
    key = person_name(F.col("official"))
    own = officials.groupBy("season", key.alias("official")).agg(
        F.countDistinct("event_id").alias("matches"), *[F.avg(f"total_{m}").alias(f"_own_{m}") for m in metrics]
    )
    base = league.withColumn("_newest", newest)
    back = F.array_position(last_seasons(F.col("_newest"), len(IMPACT_WEIGHTS)), F.col("season")).cast("int")
    weights = F.array(*[F.lit(w) for w in IMPACT_WEIGHTS])
    weighted = base.withColumn("_back", back).filter("_back > 0").withColumn("weight", F.element_at(weights, F.col("_back")))
    now = league.filter(F.col("season") == newest).select(F.struct(*[f"{m}_avg" for m in metrics]).alias("_now"))
    parts = own.join(weighted.select("season", "weight", *[F.col(f"{m}_avg").alias(f"_lg_{m}") for m in metrics]), "season")
    parts = parts.withColumns({f"_c_{m}": F.try_divide(F.col(f"_own_{m}"), F.col(f"_lg_{m}")) for m in metrics})

    def coefficient(m: str) -> Column:
        c = F.col(f"_c_{m}")
        return F.try_divide(F.sum(c * F.col("weight")), F.sum(F.when(c.isNotNull(), F.col("weight"))))

    detail = F.struct(
        "season", "weight", "matches",
        *[x for m in metrics for x in (
            F.col(f"_own_{m}").alias(f"{m}_avg"), F.col(f"_lg_{m}").alias(f"league_{m}_avg"),
            F.col(f"_c_{m}").alias(f"{m}_coeff"), (F.col(f"_own_{m}") - F.col(f"_lg_{m}")).alias(f"{m}_delta"),
        )],
    )
    out = parts.groupBy("official").agg(
        *[coefficient(m).alias(f"{m}_coeff") for m in metrics],
        F.count("*").alias("seasons_used"),
        F.sort_array(F.collect_list(detail), asc=False).alias("season_detail"),  # at most three seasons
    )
    current = now.scalar()
    return out.withColumns({f"{m}_impact": (F.col(f"{m}_coeff") - 1) * current[f"{m}_avg"] for m in metrics})


def official_label(names: DataFrame, impacts: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Official's short name joined with its impacts; the plain name when there is none."""
    keyed = names.withColumn("_key", person_name(F.col("official")))
    found = impacts.select(F.col("official").alias("_key"), *[f"{m}_impact" for m in metrics])
    text = F.concat_ws(" · ", F.col("_key"), *[F.when(F.col(f"{m}_impact").isNotNull(), F.concat(F.lit(f"{m} "), F.format_string("%+.1f", f"{m}_impact"))) for m in metrics])
    return keyed.join(found, "_key", "left").withColumn("label", text).drop("_key", *[f"{m}_impact" for m in metrics])


def current_round(schedule: DataFrame, played: DataFrame) -> DataFrame:
    """Per season the smallest round with an unplayed fixture, else the last round."""
    keys = ["season", "side_a", "side_b"]
    marked = schedule.join(played.select(*keys).distinct().withColumn("_done", F.lit(True)), keys, "left")
    rounds = marked.groupBy("season", "match_round").agg(F.count_if(F.col("_done").isNull()).alias("_open"))
    return rounds.groupBy("season").agg(
        F.coalesce(F.min(F.when(F.col("_open") > 0, F.col("match_round"))), F.max("match_round")).alias("match_round")
    )


def round_overview(schedule: DataFrame, current: DataFrame, appointments: DataFrame, order: str) -> DataFrame:
    """Fixtures of the current round with their newest appointment or a placeholder."""
    from twinside.operators.joins import appointment_lookup

    fixtures = appointment_lookup(schedule.join(current, ["season", "match_round"], "left_semi"), appointments, order)
    return fixtures.withColumn("official", F.coalesce(F.when(~is_blank(F.col("official")), F.trim("official")), F.lit("not appointed")))


def official_choices(history: DataFrame, extra: str | None = None) -> DataFrame:
    """Distinct short names in order; an extra name not in history comes first."""
    names = history.filter(~is_blank(F.col("official"))).select(person_name(F.col("official")).alias("official")).distinct()
    names = names.withColumn("place", F.lit(1))
    if extra:
        head = names.agg(F.lit(extra).alias("official"), F.count_if(F.col("official") == extra).alias("_n")).filter("_n = 0")
        names = names.unionByName(head.select("official", F.lit(0).alias("place")))
    return names.orderBy("place", "official")
