"""Scalar rules at their edges."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from twinside.functions import calendar as cal, numbers as num, probability as pr, text as tx


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_dayparts(spark):
    clocks = ["14:59", "15:00", "17:29", "17:30", "00:00", "24:00", "7:30", "15:60", None, "15:00 "]
    assert column(spark, clocks, "string", cal.daypart) == ["early", "afternoon", "afternoon", "late", "early", None, None, None, None, None]


def test_sample_classes(spark):
    assert column(spark, [0, 2, 3, 4, 5, 7, 8], "int", num.sample_class) == ["insufficient"] * 2 + ["very_small"] * 2 + ["small"] * 2 + ["usable"]


def test_seasons(spark):
    assert column(spark, ["1999-00", "1999/2000", "1999-01", "99-00", None], "string", cal.season_start_or_null) == [1999, 1999, None, None, None]
    with pytest.raises(PySparkException, match="malformed season"):
        column(spark, ["1999-05"], "string", cal.season_start)
    assert column(spark, ["22-23", "2022-23", "2223_E0", "none"], "string", cal.season_from_text) == ["2022-23", "2022-23", "2022-23", None]


def test_dates(spark):
    got = column(spark, ["31/08/2001", "01/09/95", "1/2/01", "2001-01-01", "32/01/2001"], "string", cal.day_first_date)
    assert [None if d is None else d.isoformat() for d in got] == ["2001-08-31", "1995-09-01", "2001-02-01", None, None]


def test_wall_time_gaps_and_folds(spark):
    times = ["2026-03-29 01:30:00", "2026-10-25 01:30:00", "2026-07-01 15:00:00"]
    local = lambda c: c.cast("timestamp_ntz")
    assert column(spark, times, "string", lambda c: cal.wall_time_problem(local(c), "Europe/London")) == ["nonexistent", "ambiguous", None]
    assert column(spark, times[2:], "string", lambda c: cal.local_to_utc(local(c), "Europe/London").cast("string")) == ["2026-07-01 14:00:00"]


def test_names(spark):
    people = ["Tom  Bramley (pictured)", "T. Bramley", "t bramley", "Prince", "", None]
    assert column(spark, people, "string", tx.person_name) == ["T Bramley", "T Bramley", "T bramley", "Prince", "", ""]
    assert column(spark, ["T O’Neil", "tbc person", "Single", "A 1", None], "string", tx.is_person) == [True, False, False, False, False]
    assert column(spark, ["To be confirmed", "A Person", "Élodie X"], "string", tx.is_appointable) == [False, True, False]


def test_counts_and_sums(spark):
    assert column(spark, [1.0, 0.0, -1.0, 2.5, float("inf"), float("nan"), None], "double", num.valid_count) == [1.0, 0.0, None, None, None, None, None]
    df = spark.createDataFrame([(None, None), (1, None), (1, 2)], "a int, b int")
    assert [r[0] for r in df.select(num.null_safe_sum(F.col("a"), F.col("b"))).collect()] == [None, 1, 3]


def test_half_lines(spark):
    assert column(spark, [21.8, 21.2, 21.0, 0.2], "double", num.half_line_below) == [21.5, 21.5, 20.5, 0.5]


def test_near_equality_is_a_few_steps(spark):
    base = 0.1
    values = [base, math.nextafter(base, 1), base * (1 + 1e-12), float("nan")]
    assert column(spark, values, "double", lambda c: num.near_equal(F.lit(base), c)) == [True, True, False, False]


def poisson(k, mu):
    return math.exp(k * math.log(mu) - mu - math.lgamma(k + 1))


def negbin(k, mu, a):
    n = 1 / a
    return math.exp(math.lgamma(k + n) - math.lgamma(n) - math.lgamma(k + 1) + n * math.log(n / (n + mu)) + k * math.log(mu / (n + mu)))


@pytest.mark.parametrize("alpha", [None, 0.11, 1.7])
def test_tails_and_ranges_against_closed_forms(spark, alpha):
    pmf = (lambda k, mu: poisson(k, mu)) if alpha is None else (lambda k, mu: negbin(k, mu, alpha))
    data = [(mu, line) for mu in (0.05, 0.9, 3.0, 26.4, 900.0) for line in (-0.5, 0.5, 2.5, 30.5, 905.5)]
    df = spark.createDataFrame(data, "mu double, line double").withColumn("f", pr.family(F.col("mu"), F.lit(alpha).cast("double")))
    for r in df.select("mu", "line", pr.over_probability(F.col("f"), F.col("line")).alias("p")).collect():
        last = 6000 if alpha is None else 60000  # the wide family has a long tail
        want = sum(pmf(k, r["mu"]) for k in range(int(math.floor(r["line"])) + 1, last))
        assert r["p"] == pytest.approx(want, rel=1e-8, abs=1e-290)
    for r in df.filter("line = 0.5").select("mu", pr.best_range(F.col("f"), F.lit(3)).alias("r"), pr.pmf_values(F.col("f")).alias("p")).collect():
        sums = [sum(pmf(k + j, r["mu"]) for j in range(3)) for k in range(1200)]
        assert r["r"]["low"] == sums.index(max(sums)) and r["r"]["probability"] == pytest.approx(max(sums), rel=1e-9)
        assert sum(r["p"]) == pytest.approx(1.0, abs=2e-6) and len(r["p"]) >= 26


def test_likeliest_ranges_of_whole_columns_match_a_plain_search():
    """Batches in place of interpreted loops: every window up to far above the mean, in plain Python."""
    import math

    import numpy as np

    from twinside.functions import tails

    def mass(k, mu, alpha):
        if not alpha:
            return math.exp(k * math.log(mu) - mu - math.lgamma(k + 1))
        r = 1 / alpha
        return math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + mu)) + k * math.log(mu / (r + mu)))

    cases = [(mu, alpha, w) for mu in (0.05, 0.4, 1.7, 2.0, 5.3, 49.9) for alpha in (0.0, 0.11, 1.5) for w in (1, 2, 3, 4) if not (w == 1 and mu == 2.0)]
    got = tails.likeliest_range(*(np.array(x) for x in zip(*[(mu, alpha or math.nan, float(w)) for mu, alpha, w in cases])))
    for (mu, alpha, w), low, high, p in zip(cases, *got):
        sums = [sum(mass(k, mu, alpha) for k in range(s, s + w)) for s in range(120)]
        assert (low, high) == (sums.index(max(sums)), sums.index(max(sums)) + w - 1), (mu, alpha, w)
        assert abs(p - max(sums)) < 1e-12
    missing = tails.likeliest_range(np.array([math.nan, 1.0]), np.array([math.nan, math.nan]), np.array([2.0, math.nan]))
    assert all(np.isnan(x).all() for x in missing)


def test_likeliest_ranges_run_as_batches(spark):
    """As a column expression each row ran loops of its own, 90 microseconds a row."""
    from twinside.functions import probability as pr

    f = pr.family(F.col("mu"), F.lit(None).cast("double"))
    df = spark.createDataFrame([(2.2,), (None,)], "mu double").select(pr.best_range(f, F.lit(2)).alias("r"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    assert [(r["r"]["low"], r["r"]["high"]) for r in df.collect()] == [(1, 2), (None, None)]


def test_probabilities_run_as_batches(spark):
    """As column expressions each row ran a loop that copied its array at every step; values, sums and missing rows stay."""
    cases = [(0.05, None), (3.0, 1.7), (26.4, None), (26.4, 0.11), (None, 0.11), (900.0, None)]
    f = pr.family(F.col("mu"), F.col("alpha"))
    df = spark.createDataFrame(cases, "mu double, alpha double").withColumn("f", f)
    got = df.select("mu", "alpha", pr.pmf_values(F.col("f")).alias("p"), pr.moments(pr.pmf_values(F.col("f"))).alias("m"))
    assert "ArrowEvalPython" in df.select(pr.pmf_values(F.col("f")))._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        if r["mu"] is None:
            assert r["p"] is None and r["m"]["support"] is None and r["m"]["mass"] is None and r["m"]["mean"] is None
            continue
        mass = lambda k: negbin(k, r["mu"], r["alpha"]) if r["alpha"] else poisson(k, r["mu"])
        want, total = [], 0.0
        while len(want) < 26 or total < pr.TAIL:
            want.append(mass(len(want)))
            total = sum(want)
        short = sum(want[:-1]) < pr.TAIL and len(want) > 26  # the last value may be the first past the tail
        assert len(r["p"]) == len(want) and (short or len(want) == 26)
        assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-300)
        assert (r["m"]["support"], r["m"]["mass"], r["m"]["mean"]) == (len(want), pytest.approx(sum(want)), pytest.approx(sum(k * p for k, p in enumerate(want))))
