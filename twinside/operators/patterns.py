"""Season-local associations, their stability, and pre-event matching.

Facts are reduced once to (season, entity, venue, weekday, daypart) moments of
whole-number counts; every effect, baseline and variance comes from those few
rows, so a hot entity costs one map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinside.functions.calendar import daypart, iso_date, season_start, season_start_or_null, weekday
from twinside.functions.numbers import sample_class, valid_count
from twinside.functions.text import is_blank
from twinside.operators.joins import many, without_repeated
from twinside.operators.quality import pair_verdicts
from twinside.operators.scan import asof
from twinside.session import settle

KEY = ["pattern_type", "entity", "venue", "weekday", "daypart", "metric"]
PRIOR_STRENGTH = 5.0
LEAST = 5  # rows a category needs in a season to count as evidence
EVIDENCE_ORDER = ("strong_candidate", "supported", "mixed", "weak")


def accepted(contests: DataFrame, sides: DataFrame) -> DataFrame:
    """Contests of a unique id whose two side rows mirror each other and name the contest's own sides and season."""
    home = sides.filter("venue = 'H'").select("event_id", F.col("side").alias("_a"), F.col("opponent").alias("_b"), F.col("season").alias("_s"))
    good = pair_verdicts(sides).filter("reason IS NULL").select("event_id").join(many(home), "event_id")
    unique = without_repeated(contests, ["event_id"])
    same = (F.col("side_a") == F.col("_a")) & (F.col("side_b") == F.col("_b")) & (F.col("season") == F.col("_s"))
    return unique.join(many(good), "event_id").filter(same).select(*contests.columns)


def prepare(contests: DataFrame, sides: DataFrame, metrics: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(side frame, official frame) with weekday, daypart and clean counts ``x_<metric>``.

    Contests that are not ``accepted`` enter neither. An official's value is
    the total of both sides and needs both.
    """
    context = accepted(contests, sides).select(
        "event_id", "season", "event_date", weekday(F.col("event_date")).alias("weekday"), daypart(F.col("kickoff_time")).alias("daypart"), "official"
    )
    counted = [valid_count(F.col(f"{m}_for")).alias(f"x_{m}") for m in metrics]
    rows = sides.select("event_id", "side", "venue", *counted)
    entity = rows.join(many(context.drop("official")), "event_id").withColumnRenamed("side", "entity")
    both = rows.groupBy("event_id").agg(*[F.when(F.count(f"x_{m}") == 2, F.sum(f"x_{m}")).alias(f"x_{m}") for m in metrics])
    named = context.filter(~is_blank(F.col("official"))).join(many(both), "event_id")
    official = named.withColumnRenamed("official", "entity").withColumn("venue", F.lit(""))
    return entity, official.select(*entity.columns)


def preparation_quality(contests: DataFrame, sides: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row of counters: contests, unusable dates, clocks, officials and values, and broken pairs."""
    one = contests.agg(
        F.count("*").alias("contests"),
        F.count_if(F.col("event_date").isNull()).alias("invalid_dates"),
        F.count_if(daypart(F.col("kickoff_time")).isNull()).alias("invalid_clocks"),
        F.count_if(is_blank(F.col("official"))).alias("missing_officials"),
    )
    bad = sides.agg(F.struct(*[F.count_if(valid_count(F.col(f"{m}_for")).isNull()).alias(f"invalid_{m}") for m in metrics])).scalar()
    pairs = pair_verdicts(sides).agg(F.count_if(F.col("reason").isNotNull())).scalar()
    return one.withColumn("_b", bad).withColumn("broken_pairs", pairs).select("*", "_b.*").drop("_b")


def moments(frame: DataFrame, kind: str, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Counts, sums and sums of squares by season, entity, venue, weekday and daypart."""
    x = lambda m: F.col(f"x_{m}")
    return (
        frame.groupBy(*keys, "season", "entity", "venue", "weekday", "daypart")
        .agg(
            F.count("*").alias("rows"),
            *[F.count(x(m)).alias(f"n_{m}") for m in metrics],
            *[F.coalesce(F.sum(x(m)), F.lit(0.0)).alias(f"s_{m}") for m in metrics],
            *[F.coalesce(F.sum(x(m) * x(m)), F.lit(0.0)).alias(f"q_{m}") for m in metrics],
        )
        .withColumn("kind", F.lit(kind))
    )


def season_patterns(mom: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Group against same-season complement for each factor category and metric, with uncertainty.

    Rows whose category is unknown belong to neither side.
    """
    context = [*keys, "kind", "season", "entity", "venue"]
    factors = F.array(
        F.struct(F.lit("weekday").alias("factor"), F.col("weekday").alias("category")),
        F.struct(F.lit("daypart").alias("factor"), F.col("daypart").alias("category")),
    )
    packed = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("n"), F.col(f"s_{m}").alias("s"), F.col(f"q_{m}").alias("q")) for m in metrics]
    )
    wide = mom.withColumn("_rows", F.sum("rows").over(Window.partitionBy(*context)))
    tall = wide.select(*context, "_rows", F.explode(factors).alias("f"), packed.alias("p")).filter("f.category IS NOT NULL")
    cells = (
        tall.select(*context, "_rows", "f.factor", "f.category", F.explode("p").alias("m"))
        .groupBy(*context, "_rows", "factor", "category", "m.metric")
        .agg(F.sum("m.n").alias("ng"), F.sum("m.s").alias("sg"), F.sum("m.q").alias("qg"))
    )
    w = Window.partitionBy(*context, "factor", "metric")
    rest = {f"{c}b": F.sum(f"{c}g").over(w) - F.col(f"{c}g") for c in "nsq"}
    return _effects(cells.withColumns(rest), keys)


def _effects(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    ng, nb, sg, sb, qg, qb = (F.col(c) for c in ("ng", "nb", "sg", "sb", "qg", "qb"))
    group, base = F.try_divide(sg, ng), F.try_divide(sb, nb)
    both = (ng > 0) & (nb > 0)
    is_day = F.col("factor") == "weekday"
    out = cells.select(
        *keys, "season",
        F.concat_ws("_", "kind", "factor").alias("pattern_type"), "entity", "venue",
        F.when(is_day, F.col("category")).otherwise("").alias("weekday"),
        F.when(is_day, "").otherwise(F.col("category")).alias("daypart"), "metric",
        ng.alias("n_group"), nb.alias("n_baseline"), group.alias("group_mean"), base.alias("baseline_mean"),
        F.when(both, group - base).alias("effect"), sample_class(ng).alias("sample_class"), both.alias("evaluable"),
        (F.col("_rows") < 3).alias("sparse_identity"), "sg", "qg", "sb", "qb",
    )
    effect = F.col("effect")
    # n * sum(x^2) = (sum x)^2 exactly when all counts are equal: tested in whole numbers.
    big = lambda c: c.cast("decimal(19,0)")
    flat = lambda n, s, q: big(n) * big(q) == big(s) * big(s)
    variance = lambda n, s, q: F.greatest(F.lit(0.0), (q - s * s / n)) / (n - 1)
    n, b = F.col("n_group"), F.col("n_baseline")
    effective = F.when(both_sides := ((n > 0) & (b > 0)), n * b / (n + b))
    weight = effective / (effective + PRIOR_STRENGTH)
    status = (
        F.when((n < 2) | (b < 2), "insufficient_n")
        .when(flat(n, F.col("sg"), F.col("qg")) | flat(b, F.col("sb"), F.col("qb")), "zero_variance")
        .otherwise("available")
    )
    se = F.when(status == "available", F.sqrt(variance(n, F.col("sg"), F.col("qg")) / n + variance(b, F.col("sb"), F.col("qb")) / b))
    return out.withColumns(
        {
            "relative_effect": F.when(both_sides, F.try_divide(effect, F.col("baseline_mean"))),
            "effect_se": se, "ci_low": effect - 1.96 * se, "ci_high": effect + 1.96 * se, "uncertainty_status": status,
            "effective_n": effective, "reliability_weight": weight, "shrunk_effect": effect * weight,
        }
    ).drop("sg", "qg", "sb", "qb")


def eligible() -> Column:
    return (F.col("n_group") >= LEAST) & (F.col("n_baseline") > 0) & F.col("effect").isNotNull()


def stability(seasonal: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How often eligible seasons agree on the sign of the effect."""
    sign = lambda cond: F.count_if(eligible() & cond)
    e = F.col("effect")
    counted = seasonal.groupBy(*keys, *KEY).agg(
        F.count_if(eligible()).alias("eligible_seasons"), sign(e > 0).alias("positive_seasons"), sign(e < 0).alias("negative_seasons"), sign(e == 0).alias("neutral_seasons")
    )
    n, up, down, neutral = (F.col(f"{c}_seasons") for c in ("eligible", "positive", "negative", "neutral"))
    return counted.withColumns({"direction": _direction(n, up, down, neutral), "direction_consistency": F.try_divide(F.greatest(up, down, neutral), n)})


def _direction(n: Column, up: Column, down: Column, neutral: Column) -> Column:
    return F.when(n == 0, "insufficient").when(up == n, "up").when(down == n, "down").when(neutral == n, "neutral").otherwise("mixed")


def _verdict(n: Column, up: Column, down: Column, ok: Column, effect: Column) -> tuple[Column, Column]:
    """Expected direction from ``n`` earlier eligible seasons, and whether the season's effect met it."""
    expected = F.when(n >= 2, F.when(up == n, "up").when(down == n, "down").otherwise("mixed"))
    result = (
        F.when(n < 2, "not_testable").when(~ok, "pending").when(expected == "mixed", "mixed").when(effect == 0, "neutral")
        .when((effect > 0) == (expected == "up"), "hit").otherwise("miss")
    )
    return expected, result


def walk_forward(seasonal: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """For each season the expectation from strictly earlier eligible seasons, and whether it held."""
    w = Window.partitionBy(*keys, *KEY).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda cond: F.coalesce(F.count_if(eligible() & cond).over(w), F.lit(0))
    e = F.col("effect")
    rows = seasonal.withColumn("_start", season_start(F.col("season"))).withColumns(
        {
            "_n": before(F.lit(True)), "_up": before(e > 0), "_down": before(e < 0),
            "_used": F.collect_list(F.when(eligible(), F.col("season"))).over(w),
        }
    )
    expected, result = _verdict(F.col("_n"), F.col("_up"), F.col("_down"), eligible(), e)
    return rows.select(
        *keys, *KEY, F.col("season").alias("target_season"), F.col("_used").alias("historical_seasons_used"), F.col("_n").alias("historical_eligible_count"),
        expected.alias("expected_direction"), F.col("n_group").alias("target_n_group"), F.col("n_baseline").alias("target_n_baseline"),
        e.alias("target_effect"), F.col("relative_effect").alias("target_relative_effect"), result.alias("validation_result"),
    )


def oos_summary(validation: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Out-of-sample counts; a neutral test stays in the denominator."""
    tested = F.col("expected_direction").isin("up", "down") & F.col("validation_result").isin("hit", "miss", "neutral")
    n = lambda r: F.count_if(F.coalesce(tested & (F.col("validation_result") == r), F.lit(False)))
    tests = F.count_if(F.coalesce(tested, F.lit(False)))
    return validation.groupBy(*keys, *KEY).agg(
        tests.alias("oos_tests"), n("hit").alias("oos_hits"), n("miss").alias("oos_misses"), n("neutral").alias("oos_neutral"),
    ).withColumn("oos_hit_rate", F.try_divide("oos_hits", "oos_tests"))


def analyze(contests: DataFrame, sides: DataFrame, metrics: Sequence[str]) -> dict[str, DataFrame]:
    """All pattern tables of one history."""
    entity, official = prepare(contests, sides, metrics)
    seasonal = season_patterns(moments(entity, "side", metrics).unionByName(moments(official, "official", metrics)), metrics)
    seasonal = settle(seasonal, "season-patterns")
    validation = walk_forward(seasonal)
    return {
        "seasonal": seasonal, "stability": stability(seasonal), "quality": preparation_quality(contests, sides, metrics),
        "walk_forward": validation, "oos": oos_summary(validation),
    }


def evidence(direction: Column, seasons: Column, tests: Column, hits: Column, misses: Column, neutral: Column) -> tuple[Column, Column]:
    """(level, reason) by fixed rules."""
    clear = direction.isin("up", "down") & (tests > 0) & (hits == tests) & (misses == 0) & (neutral == 0)
    strong = clear & (seasons >= 3) & (tests >= 2)
    supported = clear & (seasons >= 2)
    level = F.when(direction == "mixed", "mixed").when(strong, "strong_candidate").when(supported, "supported").otherwise("weak")
    reason = (
        F.when(direction == "mixed", "eligible seasons disagree")
        .when(strong, "one direction, three or more earlier seasons, two or more tests, all hit")
        .when(supported, "one direction, two or more earlier seasons, a test, all hit")
        .otherwise("no evidence that meets the minimums")
    )
    return level, reason


def ranked(patterns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deterministic place of each pattern within its fixture."""
    order = F.array_position(F.array(*[F.lit(x) for x in EVIDENCE_ORDER]), F.col("evidence_level"))
    w = Window.partitionBy(*keys).orderBy(
        order, F.desc_nulls_last("oos_tests"), F.desc_nulls_last("eligible_seasons"), F.desc_nulls_last("direction_consistency"),
        F.desc_nulls_last("ranking_effect"), *KEY,
    )
    return patterns.withColumn("place", F.row_number().over(w))


def fixture_context(fixtures: DataFrame) -> DataFrame:
    """Text fixtures to typed context plus the rules they break.

    Wants text columns side_a, side_b, season, event_date, kickoff_time and official.
    """
    date, start = iso_date(F.col("event_date")), season_start_or_null(F.col("season"))
    part = daypart(F.col("kickoff_time"))
    given = ~is_blank(F.col("kickoff_time"))
    first, after = F.make_date(start, F.lit(7), F.lit(1)), F.make_date(start + 1, F.lit(7), F.lit(1))
    rules = [F.when(is_blank(F.col(c)), F.lit(f"missing {c}")) for c in ("side_a", "side_b", "season", "event_date")]
    rules += [
        F.when(F.col("side_a") == F.col("side_b"), F.lit("sides must differ")),
        F.when(~is_blank(F.col("event_date")) & date.isNull(), F.lit("date must be YYYY-MM-DD")),
        F.when(~is_blank(F.col("season")) & start.isNull(), F.lit("invalid season")),
        F.when((date < first) | (date >= after), F.lit("date outside season")),
        F.when(given & part.isNull(), F.lit("invalid kickoff")),
    ]
    return fixtures.withColumns(
        {
            "violations": F.array_compact(F.array(*rules)), "weekday": weekday(date), "daypart": part,
            "kickoff_time": F.when(given, F.col("kickoff_time")), "official": F.when(~is_blank(F.col("official")), F.col("official")),
            "event_date": date,
        }
    )


def match_patterns(contests: DataFrame, sides: DataFrame, fixtures: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Every pattern that fits a fixture's known context, ranked, for all fixtures in one plan.

    ``fixtures``: fixture_id, season, event_date, side_a, side_b, official,
    weekday, daypart.  Only earlier calendar days of seasons up to the
    fixture's count, without other rows of the fixture's own identity.

    Seasons that ended before the fixture's day are the same for all fixtures:
    their effects are computed once for each pattern and kept as one short
    array.  Only open seasons depend on the day and the pairing: running sums
    are looked up by (subject, day) and by (subject, pairing, day), and the
    difference is the history without the fixture's own pairing.  Fixtures join
    last.
    """
    daily = settle(_pairing_days(contests, sides, metrics), "pairing-days")
    # One row for each season: its label, first year and last day.
    ends = [(r["season"], r["last"]) for r in daily.groupBy("season").agg(F.max("event_date").alias("last")).collect()]
    now = _open_effects(daily, fixtures, ends, metrics)
    past = _past_effects(daily, metrics)
    earlier = F.filter("past", lambda e: (e["year"] < season_start(F.col("f_season"))) & (e["last"] < F.col("f_date")))
    own = F.transform(F.coalesce(earlier, F.array()), lambda e: F.struct(*[e[c] for c in SEASON_EFFECT]))
    joined = now.join(past, KEY, "left").withColumn("seasons", F.sort_array(F.concat(own, F.col("open"))))
    joined = settle(joined.filter(F.size("seasons") > 0).drop("past", "open"), "fixture-patterns")
    return ranked(_summarised(joined), ["fixture_id"])


#: What is kept of a season's effect; arrays of it sort by year.
SEASON_EFFECT = ("year", "season", "n_group", "n_baseline", "effect", "shrunk_effect", "sample_class")


def _pairing_days(contests: DataFrame, sides: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Moments by kind, season, entity, venue, pairing, day and daypart."""
    pairs = contests.select("event_id", F.col("side_a").alias("_a"), F.col("side_b").alias("_b"))
    parts = [moments(f.join(many(pairs), "event_id"), k, metrics, ["event_date", "_a", "_b"]) for f, k in zip(prepare(contests, sides, metrics), ("side", "official"))]
    return parts[0].unionByName(parts[1])


def _measures(metrics: Sequence[str]) -> list[str]:
    return ["rows", *[f"{p}_{m}" for m in metrics for p in "nsq"]]


def _past_effects(daily: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(KEY, past): the effects of a pattern in every season, with the season's last day; one entry a season."""
    mom = daily.groupBy("kind", "season", "entity", "venue", "weekday", "daypart").agg(*[F.sum(c).alias(c) for c in _measures(metrics)])
    last = daily.groupBy("season").agg(F.max("event_date").alias("last"))
    rows = season_patterns(mom, metrics).withColumn("year", season_start(F.col("season"))).join(last, "season")
    return rows.groupBy(*KEY).agg(F.collect_list(F.struct(*SEASON_EFFECT, "last")).alias("past"))


def _wanted(fixtures: DataFrame) -> DataFrame:
    """(fixture, kind, entity, venue, factor, category): the A side at home, the B side away, the official anywhere, on the fixture's weekday and daypart."""
    subject = lambda e, v, k: F.struct(F.col(e).alias("entity"), F.lit(v).alias("venue"), F.lit(k).alias("kind"))
    factor = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("category")) for f in ("weekday", "daypart")])
    rows = fixtures.select(
        "fixture_id", F.col("season").alias("f_season"), F.col("event_date").alias("f_date"), F.col("side_a").alias("_a"), F.col("side_b").alias("_b"),
        F.explode(F.array(subject("side_a", "H", "side"), subject("side_b", "A", "side"), subject("official", "", "official"))).alias("s"), factor.alias("f"),
    ).select("fixture_id", "f_season", "f_date", "_a", "_b", "s.*", F.explode("f").alias("f"))
    return rows.select("*", "f.*").drop("f").filter("entity IS NOT NULL AND category IS NOT NULL")


#: Stands for any category of a factor, and for any pairing.
ANY = "*"


def _open_effects(daily: DataFrame, fixtures: DataFrame, ends: Sequence[tuple], metrics: Sequence[str]) -> DataFrame:
    """(fixture_id, KEY, f_season, f_date, open, known): effects in the seasons that had not ended, and known rows of the fixture's season outside the category."""
    measures = _measures(metrics)
    seasons = F.array(*[F.struct(F.lit(s).alias("season"), season_start(F.lit(s)).alias("year"), F.lit(d).alias("last")) for s, d in ends])
    year = season_start(F.col("f_season"))
    is_open = lambda s: (s["year"] <= year) & ((s["year"] == year) | (s["last"] >= F.col("f_date")))
    wanted = _wanted(fixtures)
    asked = wanted.withColumn("season", F.explode_outer(F.transform(F.filter(seasons, is_open), lambda s: s["season"]) if ends else F.array().cast("array<string>")))
    asked = settle(asked, "asked-seasons")
    # Running sums by category and over all known ones, of the subject and of each of its pairings.
    factors = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("category")) for f in ("weekday", "daypart")])
    tall = daily.join(asked.select("season").distinct(), "season", "left_semi").withColumn("f", F.explode(factors)).filter("f.category IS NOT NULL")
    tall = tall.withColumn("category", F.explode(F.array(F.col("f.category"), F.lit(ANY))))
    tall = tall.withColumn("p", F.explode(F.array(F.struct("_a", "_b"), F.struct(F.lit(ANY).alias("_a"), F.lit(ANY).alias("_b")))))
    cell = ["kind", "entity", "venue", "season", "factor", "category", "_a", "_b"]
    days = tall.select("kind", "entity", "venue", "season", "f.factor", "category", "p._a", "p._b", "event_date", *measures).groupBy(*cell, "event_date").agg(*[F.sum(c).alias(c) for c in measures])
    run = Window.partitionBy(*cell).orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    states = days.select(*cell, "event_date", *[F.sum(c).over(run).alias(c) for c in measures])
    current = F.col("season") == F.col("f_season")
    look = lambda category, a, b, group, sign: F.struct(category.alias("category"), a.alias("_a"), b.alias("_b"), F.lit(group).alias("group"), F.lit(sign).alias("sign"))
    own, every = F.col("category"), F.lit(ANY)
    all_rows = [look(own, every, every, True, 1), look(every, every, every, False, 1)]
    own_rows = [look(own, F.col("_a"), F.col("_b"), True, -1), look(every, F.col("_a"), F.col("_b"), False, -1)]
    probes = asked.withColumn("l", F.explode(F.when(current, F.array(*all_rows, *own_rows)).otherwise(F.array(*all_rows))))
    ident = ["fixture_id", "f_season", "kind", "entity", "venue", "factor"]
    probes = probes.select(*ident, "season", "f_date", F.col("category").alias("own_category"), "l.*")
    found = asof(probes, states, cell, "f_date")
    total = lambda c, g: F.coalesce(F.sum(F.when(F.col("group") == g, F.col(c) * F.col("sign"))), F.lit(0)).alias(f"{'g' if g else 'a'}_{c}")
    wide = found.groupBy(*ident, "f_date", "season", F.col("own_category").alias("category")).agg(*[total(c, g) for c in measures for g in (True, False)])
    packed = F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"g_{c}_{m}").alias(f"{c}g") for c in "nsq"], *[(F.col(f"a_{c}_{m}") - F.col(f"g_{c}_{m}")).alias(f"{c}b") for c in "nsq"]) for m in metrics])
    cells = wide.select(*ident, "f_date", "season", "category", F.col("a_rows").alias("_rows"), F.col("g_rows").alias("seen"), F.explode(packed).alias("m")).select("*", "m.*").drop("m")
    rows = _effects(cells, ["fixture_id", "f_season", "f_date", "seen"]).withColumn("year", F.when(F.col("season").isNotNull(), season_start(F.col("season"))))
    return rows.groupBy("fixture_id", "f_season", "f_date", *KEY).agg(
        F.collect_list(F.when(F.col("seen") > 0, F.struct(*SEASON_EFFECT))).alias("open"), F.max(F.when(current, F.col("n_baseline"))).alias("known")
    )


def _summarised(rows: DataFrame) -> DataFrame:
    """Stability, walk-forward tests and the current season of every pattern of a fixture, from its array of seasons."""
    ok = lambda e: (e["n_group"] >= LEAST) & (e["n_baseline"] > 0) & e["effect"].isNotNull()
    year = season_start(F.col("f_season"))
    count = lambda a, cond: F.size(F.filter(a, cond))
    up, down, even = lambda e: e["effect"] > 0, lambda e: e["effect"] < 0, lambda e: e["effect"] == 0

    def tested(e: Column, i: Column) -> Column:
        before = F.filter(F.slice("seasons", F.lit(1), i), ok)
        expected, result = _verdict(F.size(before), count(before, up), count(before, down), ok(e), e["effect"])
        return F.struct(e["season"].alias("target_season"), expected.alias("expected_direction"), result.alias("validation_result"))

    rows = rows.withColumns(
        {
            "good": F.filter("seasons", ok), "tests": F.transform("seasons", tested),
            "cur": F.get(F.filter("seasons", lambda e: e["season"] == F.col("f_season")), F.lit(0)),
        }
    )
    n, ups, downs, evens = F.size("good"), count("good", up), count("good", down), count("good", even)
    in_test = lambda r: count("tests", lambda t: t["expected_direction"].isin("up", "down") & (t["validation_result"] == r))
    rows = rows.withColumns(
        {
            "eligible_seasons": n, "direction": _direction(n, ups, downs, evens), "direction_consistency": F.try_divide(F.greatest(ups, downs, evens), n),
            "historical_eligible_seasons": count("good", lambda e: e["year"] < year),
            "oos_hits": in_test("hit"), "oos_misses": in_test("miss"), "oos_neutral": in_test("neutral"),
            "latest": F.try_element_at(F.filter("good", lambda e: e["shrunk_effect"].isNotNull()), F.lit(-1)),
        }
    ).withColumn("oos_tests", F.col("oos_hits") + F.col("oos_misses") + F.col("oos_neutral"))
    level, reason = evidence(
        F.col("direction"), F.col("historical_eligible_seasons"), F.col("oos_tests"), F.col("oos_hits"), F.col("oos_misses"), F.col("oos_neutral")
    )
    effect_row = lambda e: F.struct(*[e[c] for c in SEASON_EFFECT[1:]])
    return rows.select(
        "fixture_id", *KEY, F.when(F.col("pattern_type").startswith("official"), "official").when(F.col("venue") == "H", "home").otherwise("away").alias("role"),
        "direction", "direction_consistency", "eligible_seasons", "historical_eligible_seasons", F.sort_array(F.transform("seasons", effect_row)).alias("season_effects"),
        F.col("f_season").alias("current_season"),
        F.when(ok(F.col("cur")), "eligible").otherwise("pending").alias("current_status"),
        F.coalesce(F.col("cur.sample_class"), F.lit("insufficient")).alias("current_sample_class"),
        F.coalesce(F.col("cur.n_group"), F.lit(0)).alias("current_n_group"),
        F.coalesce(F.col("cur.n_baseline"), F.col("known"), F.lit(0)).alias("current_n_baseline"),
        "oos_tests", "oos_hits", "oos_misses", "oos_neutral", F.try_divide("oos_hits", "oos_tests").alias("oos_hit_rate"), F.sort_array("tests").alias("oos_history"),
        level.alias("evidence_level"), reason.alias("evidence_reason"), F.abs("latest.shrunk_effect").alias("ranking_effect"),
    )


def sections(patterns: DataFrame) -> DataFrame:
    """Main for strong or supported evidence, else extra; officials only when they are the fixture's own."""
    return patterns.filter("role <> 'official' OR entity = official").withColumn(
        "section", F.when(F.col("evidence_level").isin("strong_candidate", "supported"), "main").otherwise("extra")
    )


def prior_agreement(patterns: DataFrame) -> DataFrame:
    """Earlier seasons with enough rows, and how many point the pattern's way."""
    earlier = F.filter(
        "season_effects", lambda s: (s["season"] < F.col("current_season")) & (s["n_group"] >= LEAST) & (s["n_baseline"] > 0) & s["effect"].isNotNull()
    )
    same = F.filter(earlier, lambda s: F.when(F.col("direction") == "up", s["effect"] > 0).otherwise(s["effect"] < 0))
    return patterns.withColumns({"prior_seasons": F.size(earlier), "prior_same_direction": F.size(same)})
