"""Best of group without sorting all rows."""

from pyspark.sql import functions as F

from twinside.operators import models as md, ordering as od
from twinside.operators.models import MARKETS


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def priced(spark):
    rows = spark.range(30).select(
        F.col("id").alias("event_id"), F.lit("X").alias("side"), F.element_at(F.array(*[F.lit(m.name) for m in MARKETS]), (F.col("id") % 3 + 1).cast("int")).alias("market"),
        F.when(F.col("id") > 2, F.col("id") * 2.7).alias("prediction"), F.lit("text").alias("official"),
    )
    return rows.unionByName(rows.filter("event_id = 7").withColumn("prediction", F.lit(0.3)))


def test_lowest_line_of_numbers_is_hashed_not_sorted(spark):
    rows = md.over_lines(priced(spark), MARKETS).select("event_id", "side", "market", "line", "p_over")
    got = od.lowest_line(rows, ["event_id", "side", "market"])
    assert "SortAggregate" not in planned(got)
    want = rows.groupBy("event_id", "side", "market").agg(F.min("line").alias("line"))
    assert got.drop("p_over").exceptAll(want).count() == 0 and got.count() == 30


def test_a_group_without_any_line_keeps_one_row(spark):
    rows = spark.createDataFrame([("a", None, 1.0), ("b", None, 2.0), ("b", 0.5, 3.0)], "k string, line double, p double")
    assert sorted(od.lowest_line(rows, ["k"]).collect()) == [("a", None, 1.0), ("b", 0.5, 3.0)]


def test_overview_is_hashed_not_sorted(spark):
    rows = spark.createDataFrame([(1, "X", "qty", 1.5, 2.0), (1, "X", "qty", 0.5, 3.0), (2, "X", "qty", None, 4.0), (2, "X", "qty", 0.5, 5.0)], "event_id bigint, side string, market string, line double, prediction double")
    got = md.forecast_overview(rows, ["event_id"], ["line"])
    assert "SortAggregate" not in planned(got)
    assert {r["event_id"]: r["prediction"] for r in got.collect()} == {1: 3.0, 2: 4.0}


def test_likeliest_lines_are_chosen_before_they_become_rows(spark):
    rows, keys = priced(spark), ["event_id", "side", "market"]
    few = md.over_lines(rows, MARKETS, min_fair=2.0)
    assert "Generate" not in planned(few)
    got, want = (od.best_line(x, keys).orderBy(*keys).collect() for x in (few, md.over_lines(rows, MARKETS)))
    assert [r.asDict() for r in got] == [r.asDict() for r in want] and got


def test_rows_of_single_keys_are_not_moved_to_be_chosen_from(spark):
    """Every forecast was moved and sorted to find its best line among one."""
    keys = ["event_id", "side", "market"]
    rows = priced(spark)
    nameless = rows.filter("event_id IN (9, 12)").withColumn("event_id", F.lit(None).cast("bigint"))
    rows = rows.unionByName(rows.filter("event_id = 9").withColumn("prediction", F.lit(0.4))).unionByName(nameless)
    best, seen = (lambda x: od.lowest_line(x.repartition(*keys), keys)), []
    lined = md.over_lines(rows, MARKETS, min_fair=2.0)

    def spy(x):
        seen.append(x.count())
        return best(x)

    contests = rows.select("event_id")
    got = od.where_repeated(lined, contests, ["event_id"], spy)
    want = best(lined)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and 0 < seen[0] < want.count() < lined.count()
    single = lined.filter("event_id NOT IN (7, 9)")
    alone = od.where_repeated(single, contests.filter("event_id NOT IN (7, 9)").distinct(), ["event_id"], spy)
    assert "Exchange" not in planned(alone) and len(seen) == 1 and alone.count() == single.count()


def test_many_repeated_keys_are_chosen_from_at_once(spark, monkeypatch):
    monkeypatch.setattr(od, "FEW", 1)
    rows = spark.createDataFrame([(1, 2.5, 1.0), (1, 0.5, 2.0), (2, 1.5, 3.0), (2, 0.5, 4.0), (3, 0.5, 5.0)], "k bigint, line double, p double")
    got = od.where_repeated(rows, rows.select("k"), ["k"], lambda x: od.lowest_line(x, ["k"]))
    assert sorted(got.collect()) == [(1, 0.5, 2.0), (2, 0.5, 4.0), (3, 0.5, 5.0)] and "LeftAnti" not in planned(got)
