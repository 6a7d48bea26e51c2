"""Pattern effects and the pre-event matcher on hand-made history."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from twinside.operators import patterns as pt

M = ("qty",)
CONTESTS = "event_id bigint, season string, event_date date, kickoff_time string, side_a string, side_b string, official string, a_qty double, b_qty double"


def history(seasons=(1996, 1997, 1998), high=9, low=3, seed=7):
    """Six Saturdays high and six Sundays low per season for side X at home."""
    r, out, event = random.Random(seed), [], 0
    for year in seasons:
        first = dt.date(year, 8, 1)
        saturday = first + dt.timedelta(days=(5 - first.weekday()) % 7)
        for week in range(6):
            for day, mean, clock in ((0, high, "17:30"), (1, low, "15:00")):
                event += 1
                date = saturday + dt.timedelta(days=7 * week + day)
                out.append((event, f"{year}-{(year + 1) % 100:02d}", date, clock, "X", f"Y{event}", "R One", float(mean + r.randrange(2)), float(r.randrange(4))))
    return out


def frames(spark, rows):
    from twinside.operators.sides import side_rows

    contests = spark.createDataFrame(rows, CONTESTS).withColumns({"a_score": F.lit(1), "b_score": F.lit(0)})
    return contests, side_rows(contests, ["score", "qty"])


def test_effect_and_uncertainty_match_statistics(spark):
    rows = history()
    got = pt.analyze(*frames(spark, rows), M)
    r = got["seasonal"].filter("entity = 'X' AND weekday = 'Saturday' AND season = '1997-98'").first()
    group = [x[7] for x in rows if x[1] == "1997-98" and x[2].weekday() == 5]
    base = [x[7] for x in rows if x[1] == "1997-98" and x[2].weekday() == 6]
    assert abs(r["effect"] - (statistics.mean(group) - statistics.mean(base))) < 1e-9
    se = (statistics.variance(group) / 6 + statistics.variance(base) / 6) ** 0.5
    if se:
        assert abs(r["effect_se"] - se) < 1e-9 and r["uncertainty_status"] == "available"
    wf = {x["target_season"]: x["validation_result"] for x in got["walk_forward"].filter("entity = 'X' AND weekday = 'Saturday'").collect()}
    assert wf == {"1996-97": "not_testable", "1997-98": "not_testable", "1998-99": "hit"}


def fixture(spark, date=dt.date(1999, 9, 4)):
    row = [(1, "1999-00", date, "X", "Z", "R One", date.strftime("%A"), "late")]
    return spark.createDataFrame(row, "fixture_id bigint, season string, event_date date, side_a string, side_b string, official string, weekday string, daypart string")


def match(spark, rows):
    got = pt.match_patterns(*frames(spark, rows), fixture(spark), M).orderBy("place").collect()
    return [r.asDict(recursive=True) for r in got]


def test_matcher_ignores_same_day_future_and_own_rows(spark):
    rows = history()
    own = (900, "1999-00", dt.date(1999, 8, 7), "17:30", "X", "Z", "R One", 50.0, 50.0)
    same_day = (901, "1999-00", dt.date(1999, 9, 4), "10:00", "X", "Q", "R One", 50.0, 50.0)
    future = (902, "1999-00", dt.date(1999, 9, 11), "17:30", "X", "Q", "R One", 50.0, 50.0)
    base = match(spark, rows)
    assert base and match(spark, rows + [own, same_day, future]) == base
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    assert match(spark, shuffled) == base
    top = next(r for r in base if r["entity"] == "X" and r["weekday"] == "Saturday")
    assert (top["direction"], top["oos_tests"], top["oos_hits"], top["current_status"]) == ("up", 1, 1, "pending")
    assert top["evidence_level"] == "supported"


def test_current_season_baseline_is_shown_without_a_category_row(spark):
    sunday = (950, "1999-00", dt.date(1999, 8, 8), "15:00", "X", "Q", "R One", 4.0, 1.0)
    got = match(spark, history() + [sunday])
    top = next(r for r in got if r["entity"] == "X" and r["weekday"] == "Saturday")
    assert (top["current_n_group"], top["current_n_baseline"], top["current_status"]) == (0, 1, "pending")


def test_fixture_context_rules(spark):
    rows = [("X", "X", "1999-00", "1999-09-04", "15:00", None), ("X", "Y", "1999-00", "1999-06-30", "25:00", ""), ("", "Y", "1999-05", "04/09/1999", None, "R")]
    df = spark.createDataFrame(rows, "side_a string, side_b string, season string, event_date string, kickoff_time string, official string")
    got = [r["violations"] for r in pt.fixture_context(df).collect()]
    assert got[0] == ["sides must differ"] and got[1] == ["date outside season", "invalid kickoff"]
    assert got[2] == ["missing side_a", "date must be YYYY-MM-DD", "invalid season"]
