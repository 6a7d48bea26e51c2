"""Gates, stores, medians, streaks and the registered queries."""

import datetime as dt
import itertools
import random
import statistics

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from twinside.operators import joins as jn, models as md, quality as qa, views as vw
from twinside.operators.ordering import rank_rows
from twinside.plans import registry
from twinside.session import shared_dir, work_path
from twinside.sources import feeds, store

ROOT = "/root/testdata/sf0.001"


def test_repeated_keys_fail_the_join(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(PySparkException, match="repeated key 1"):
        jn.many_to_one(left, right, ["k"], label="right").collect()


def test_exact_medians_by_narrowing(spark):
    r = random.Random(1)
    data = [(r.gauss(0, 10), None if i % 3 else float(r.randrange(3)), 5.0, None) for i in range(2001)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = md.exact_medians(df, ["a", "b", "c", "d"], buckets=8, small=10)
    assert got["a"] == pytest.approx(statistics.median(x[0] for x in data))
    assert got["b"] == statistics.median(x[1] for x in data if x[1] is not None)
    assert got["c"] == 5.0 and got["d"] is None


def test_runs_across_days(spark):
    kinds = "OOUUEOUUUO"
    days = [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    names = {"O": "Over", "U": "Under", "E": "Equal"}
    rows = [("k", dt.date(2001, 1, 1 + d), i, names[c]) for i, (c, d) in enumerate(zip(kinds, days))]
    df = spark.createDataFrame(rows, "k string, event_date date, event_id int, category string")
    got = vw.run_lengths(df, ["k"], ["event_date", "event_id"]).first()
    assert (got["longest_over"], got["longest_under"], got["current_category"], got["current_length"]) == (2, 3, "Over", 1)
    assert got["mean_over"] == pytest.approx(4 / 3) and got["mean_under"] == pytest.approx(2.5)


@pytest.mark.parametrize("slices", [None, 1, 7])
def test_runs_of_one_crowded_day(spark, slices):
    """One key and one day spread over slices, another key beside it, against a plain walk."""
    r, rows = random.Random(5), []
    for k, n in (("k", 400), ("other", 9)):
        kind = "Over"
        for i in range(n):
            kind = kind if r.random() < 0.8 else r.choice(("Over", "Under", "Equal"))
            rows.append((k, dt.date(2001, 1, 1), i, kind))
    df = spark.createDataFrame(rows, "k string, event_date date, event_id int, category string").repartition(5)
    got = {x["k"]: x for x in vw.run_lengths(df, ["k"], ["event_date", "event_id"], slices).collect()}
    for k in ("k", "other"):
        runs = [(c, len(list(g))) for c, g in itertools.groupby(x[3] for x in rows if x[0] == k)]
        over, under = ([n for c, n in runs if c == kind] for kind in ("Over", "Under"))
        assert (got[k]["longest_over"], got[k]["longest_under"]) == (max(over, default=None), max(under, default=None))
        assert (got[k]["current_category"], got[k]["current_length"]) == runs[-1]
        assert got[k]["mean_over"] == (pytest.approx(statistics.mean(over)) if over else None)


def test_ranking_without_one_window_per_key(spark):
    r = random.Random(2)
    rows = [(i, "k", r.choice([None, 1, 2, 3])) for i in range(50)]
    got = {x["i"]: x["place"] for x in rank_rows(spark.createDataFrame(rows, "i int, k string, v int"), ["k"], "v", ["i"]).collect()}
    order = sorted(rows, key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))
    assert got == {x[0]: p + 1 for p, x in enumerate(order)}


def test_pair_verdicts(spark):
    day = dt.date(2001, 1, 1)
    row = lambda e, s, o, v, q, g, d=day: (e, "s", d, s, o, v, q, g)
    rows = [
        row(1, "X", "Y", "H", 1.0, 2.0), row(1, "Y", "X", "A", 2.0, 1.0),
        row(2, "X", "Z", "H", 1.0, 2.0), row(2, "Z", "X", "A", 3.0, 1.0),
        row(3, "X", "Q", "H", 1.0, 2.0), row(3, "Q", "W", "A", 2.0, 1.0),
        row(4, "X", "V", "H", 1.0, 2.0),
        row(5, "X", "U", "H", 1.0, None), row(5, "U", "X", "A", 2.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "event_id int, season string, event_date date, side string, opponent string, venue string, qty_for double, qty_against double")
    got = {r["event_id"]: r["reason"] for r in qa.pair_verdicts(df, [("qty_for", "qty_against")]).collect()}
    assert got == {1: None, 2: "shared metrics differ", 3: "identities do not mirror", 4: "not one H and one A row", 5: None}


def test_season_replace_is_idempotent(spark):
    path = work_path(spark, "seasons")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "season string, x int")
    store.replace_seasons(rows, path)
    for _ in range(2):
        store.replace_seasons(rows.filter("season = 'b'").withColumn("x", F.lit(9)), path)
    assert sorted((r["season"], r["x"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 9)]


def test_encoding_is_chosen_from_the_whole_source(spark):
    path = work_path(spark, "latin")
    spark.createDataFrame([("Réferee",)], "Name string").coalesce(1).write.option("encoding", "ISO-8859-1").csv(path, header=True)
    assert feeds.text_encoding(spark, path) == "windows-1252"
    assert feeds.read_feed(spark, path, "windows-1252").first()["Name"] == "Réferee"


def test_files_keep_their_own_header_and_encoding(spark):
    path = work_path(spark, "mixed")
    spark.createDataFrame([("A", "B", "2", "1", "3.5")], "HomeTeam string, AwayTeam string, FTHG string, FTAG string, B365H string").coalesce(1).write.csv(f"{path}/a", header=True)
    later = spark.createDataFrame([("C", "D", "Réf", "0", "4")], "HomeTeam string, AwayTeam string, Referee string, FTHG string, FTAG string").coalesce(1)
    later.write.csv(f"{path}/b", header=True)
    later.select(*reversed(later.columns)).write.csv(f"{path}/c", header=True, encoding="ISO-8859-1")
    rows = feeds.read_feed(spark, f"{path}/*").select("HomeTeam", "AwayTeam", "Referee", "FTHG", "FTAG", "B365H").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [("A", "B", None, "2", "1", "3.5"), ("C", "D", "Réf", "0", "4", None), ("C", "D", "Réf", "0", "4", None)]))


def test_enrichment_never_adds_rows(spark):
    fresh = spark.createDataFrame([(1, None), (2, "R Two")], "event_id int, official string")
    old = spark.createDataFrame([(1, "R A", 5), (1, "R B", 6), (2, "R C", 7)], "event_id int, official string, extra int")
    named = spark.createDataFrame([(1, "R Z"), (1, "R Y")], "event_id int, official string")
    got = feeds.enrich(fresh, old, ["event_id"], "official", named).collect()
    assert sorted(map(tuple, got)) == [(1, "R B", 6), (2, "R Two", 7)]


def test_appointments_of_another_season_do_not_count(spark):
    fixtures = spark.createDataFrame([(s, 1, "X", "Y") for s in ("2000-01", "2001-02")], "season string, match_round int, side_a string, side_b string")
    cache = spark.createDataFrame([("2000-01", 1, "X", "Y", "A Ref", 1), ("2000-01", 1, "X", "Y", "B Ref", 2)], "season string, match_round int, side_a string, side_b string, official string, seq int")
    assert {r["season"]: r["official"] for r in jn.appointment_lookup(fixtures, cache, "seq").collect()} == {"2000-01": "B Ref", "2001-02": None}
    live = cache.filter("seq = 1")
    clash = cache.filter("seq = 2").unionByName(live.withColumns({"season": F.lit("2001-02"), "official": F.lit("A Ref")}))
    got = {r["season"]: (r["conflict"], r["kept"]) for r in qa.merge_appointments(live, clash, live.limit(0)).collect()}
    assert got == {"2000-01": (True, False), "2001-02": (False, True)}


def test_medians_leave_out_what_is_no_number(spark):
    rows = [(float(x), None) for x in range(1, 8)] + [(float("nan"), float("nan")), (float("inf"), None)]
    assert md.exact_medians(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], collected=4) == {"a": 4.0, "b": None}


def test_schedule_is_validated_on_every_read(spark):
    schema = "season string, match_round int, side_a string, side_b string"
    rows = [("s", 1, "a", "b"), ("s", 2, "b", "a")]
    good, bad = work_path(spark, "good"), work_path(spark, "bad")
    spark.createDataFrame(rows, schema).write.parquet(good)
    spark.createDataFrame(rows[:1] * 2, schema).write.parquet(bad)
    assert store.read_schedule(spark, good, schema, rounds=2, per_round=1, sides=2).count() == 2
    with pytest.raises(ValueError, match="repeated pair"):
        store.read_schedule(spark, bad, schema, rounds=2, per_round=1, sides=2)


def test_missing_ledger_is_empty_with_its_schema(spark):
    schema = spark.createDataFrame([], "a bigint, b string").schema
    assert store.read_or_empty(spark, work_path(spark, "none"), schema).schema == schema


def test_work_of_a_run_lies_in_one_folder(spark):
    from twinside.session import run_dir

    assert work_path(spark, "x").startswith(f"{run_dir(spark)}/x-") and run_dir(spark).startswith(shared_dir(spark))


def test_shared_dir_prefers_the_named_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)


QUICK = ["A_06_form_last_n", "A_09_standings", "W_05_rolling_means", "W_12_league_last20", "U_08_reciprocal_pairs", "J_08_completed_fixtures", "P_04_text_id", "Q_04_stability"]


@pytest.mark.parametrize("name", QUICK)
def test_queries_agree_with_duckdb(spark, name):
    duck = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "supplier", "nation", "region", "part"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    cur = duck.execute(registry.oracles[name])
    names = [d[0] for d in cur.description]
    df = registry.queries[name](spark, ROOT)
    key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert sorted(names) == sorted(df.columns)
    assert key(cur.fetchall()) == key(tuple(r) for r in df.select(*names).collect())


def test_every_oracle_belongs_to_a_query():
    assert set(registry.oracles) <= set(registry.queries)
