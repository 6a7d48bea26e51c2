"""Row-prior windows, day states and as-of lookup against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from twinside.operators.features import league_recent, rest_days
from twinside.operators.scan import Prior, asof, day_states, hot_keys, prior_features

DAY = dt.date(2001, 1, 1)
SPECS = [
    Prior("n", "count"), Prior("total", "sum", "x"), Prior("mean_all", "mean", "x"), Prior("mean3", "mean", "x", 3), Prior("mean10", "mean", "x", 10),
]


def rows(seed=1, n=160, days=6):
    r = random.Random(seed)
    # One key holds most rows; several rows share a day; some values are missing.
    return [
        (i * 7 % 1009, "hot" if r.random() < 0.8 else r.choice("abc"), DAY + dt.timedelta(days=r.randrange(days)), None if r.random() < 0.2 else r.randrange(9))
        for i in range(n)
    ]


def frame(spark, data):
    return spark.createDataFrame(data, "event_id bigint, k string, event_date date, x bigint")


def expected(data):
    out = {}
    for key in {d[1] for d in data}:
        seen = []
        for d in sorted((d for d in data if d[1] == key), key=lambda d: (d[2], d[0])):
            mean = lambda xs: sum(v for v in xs if v is not None) / len([v for v in xs if v is not None]) if any(v is not None for v in xs) else None
            out[d[0]] = (len(seen), sum(v for v in seen if v is not None), mean(seen), mean(seen[-3:]), mean(seen[-10:]))
            seen.append(d[3])
    return out


def values(df):
    return {r["event_id"]: tuple(None if r[s.name] is None else round(float(r[s.name]), 9) for s in SPECS) for r in df.collect()}


def rounded(want):
    return {k: tuple(None if v is None else round(float(v), 9) for v in t) for k, t in want.items()}


def test_plain_windows_match_python(spark):
    data = rows()
    assert values(prior_features(frame(spark, data), ["k"], SPECS, hot=None)) == rounded(expected(data))


def test_hot_keys_are_chunked_with_the_same_result(spark):
    data = rows(seed=2)
    df = frame(spark, data)
    assert hot_keys(df, [["k"], ["k", "x"]], 50)[1] is None
    got = prior_features(df, ["k"], SPECS, hot_rows=10)
    assert got.columns == [*df.columns, *[s.name for s in SPECS]]
    assert values(got) == rounded(expected(data))


def test_one_day_is_sliced_when_it_is_hot_itself(spark):
    data = rows(seed=3, days=1)
    assert values(prior_features(frame(spark, data), ["k"], SPECS, hot_rows=7)) == rounded(expected(data))


def test_clustered_ids_on_one_key_are_cut_by_counts(spark):
    """All rows on one key and day, nearly all ids close together and one far away."""
    data = [(i, "hot", DAY, i % 7 if i % 5 else None) for i in range(120)] + [(10**9, "hot", DAY, 3)]
    got = prior_features(frame(spark, data), ["k"], SPECS, hot_rows=10)
    assert values(got) == rounded(expected(data))


def test_ranks_of_a_shared_value_are_spread_over_days(spark):
    from twinside.operators.ordering import rank_rows

    data = [(i, "hot", DAY + dt.timedelta(days=i % 4), None if i % 3 else 5) for i in range(60)]
    got = rank_rows(frame(spark, data), ["k"], "x", ["event_date", "event_id"]).collect()
    want = sorted(data, key=lambda d: (d[3] is None, -(d[3] or 0), d[2], d[0]))
    assert {r["event_id"]: r["place"] for r in got} == {d[0]: k + 1 for k, d in enumerate(want)}


def test_later_rows_never_change_earlier_features(spark):
    data = rows(seed=4)
    cut = DAY + dt.timedelta(days=3)
    before = values(prior_features(frame(spark, data), ["k"], SPECS, hot=None))
    changed = [d if d[2] < cut else (d[0], d[1], d[2], 99) for d in data]
    after = values(prior_features(frame(spark, changed), ["k"], SPECS, hot=None))
    assert all(before[d[0]] == after[d[0]] for d in data if d[2] < cut)


def test_asof_uses_strictly_earlier_days(spark):
    data = rows(seed=5)
    df = frame(spark, data)
    states = day_states(df, ["k"], ["x"], [(3, "x")], "n")
    probe = spark.createDataFrame([(i, k, DAY + dt.timedelta(days=i)) for i in range(8) for k in ("hot", "a", "new")], "p int, k string, d date")
    for r in asof(probe, states, ["k"], "d").collect():
        past = [d for d in sorted(data, key=lambda d: (d[2], d[0])) if d[1] == r["k"] and d[2] < r["d"]]
        known = lambda ds: [d[3] for d in ds if d[3] is not None]
        mean = lambda xs: sum(xs) / len(xs) if xs else None
        assert (r["n"] or 0) == len(past)
        for got, want in ((r["all_x"], mean(known(past))), (r["last3_x"], mean(known(past[-3:])))):
            assert got is None and want is None or abs(got - want) < 1e-9


def test_asof_keeps_probe_rows_with_null_keys(spark):
    states = day_states(frame(spark, rows()), ["k"], ["x"])
    probe = spark.createDataFrame([(1, None, DAY), (2, "hot", None)], "p int, k string, d date")
    assert [r["all_x"] for r in asof(probe, states, ["k"], "d").collect()] == [None, None]


def test_league_window_is_frozen_at_the_first_row_of_a_day(spark):
    data = [(i, DAY + dt.timedelta(days=i // 4), i, 1) for i in range(40)]
    df = spark.createDataFrame(data, "event_id bigint, event_date date, a_x bigint, b_x bigint")
    got = {r["event_date"]: r[1] for r in league_recent(df, ["x"], 20).collect()}
    assert DAY not in got
    for day in sorted({d[1] for d in data})[1:]:
        past = [d[2] + d[3] for d in data if d[1] < day][-20:]
        assert abs(got[day] - sum(past) / len(past)) < 1e-9


def test_rest_days_are_shared_within_a_day(spark):
    data = [("a", DAY), ("a", DAY), ("a", DAY + dt.timedelta(days=9)), ("a", DAY + dt.timedelta(days=9))]
    got = rest_days(spark.createDataFrame(data, "side string, event_date date")).orderBy("event_date").collect()
    assert [r["days_rest"] for r in got] == [None, 9]
