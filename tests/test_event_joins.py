"""Joins of rows that grow with the events are shuffled, however small their files look."""

from datetime import date

from twinside.operators import patterns as pt, views as vw
from twinside.session import settle

SIDES = "event_id bigint, season string, event_date date, side string, opponent string, venue string, qty_for double, qty_against double"
CONTESTS = "event_id bigint, season string, event_date date, kickoff_time string, side_a string, side_b string, official string, a_score bigint, b_score bigint"


def history(spark):
    day = date(2000, 9, 1)
    contests = [(i, "2000-01", day, "15:00", "A", "B", "R", 1, i) for i in (1, 2, 3, 3)]
    sides = [(i, "2000-01", day, x, y, v, float(i), 2.0) for i in (1, 2, 3) for x, y, v in (("A", "B", "H"), ("B", "A", "A"))]
    return settle(spark.createDataFrame(contests, CONTESTS), "contests"), settle(spark.createDataFrame(sides, SIDES), "sides")


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_observations_broadcast_no_events(spark):
    contests, sides = history(spark)
    matches = vw.match_statistics(contests, sides, ["qty"], ["season", "side_a", "side_b", "event_id"])
    rows = vw.side_observations(matches, sides, ["qty"])
    assert broadcasts(matches) == broadcasts(rows) == 0
    # Equal copies of an event count once.
    assert sorted((r.event_id, r.side, r.qty_total, r.score) for r in rows.collect()) == [
        (i, s, i + 2.0, f"1:{i}" if s == "A" else f"{i}:1") for i in (1, 2, 3) for s in "AB"
    ]


def test_pattern_history_broadcasts_no_events(spark):
    contests, sides = history(spark)
    entity, official = pt.prepare(contests, sides, ["qty"])
    assert broadcasts(entity) == broadcasts(official) == 0
    # An id that repeats is dropped whole.
    assert sorted((r.event_id, r.entity, r.x_qty) for r in entity.collect()) == [(i, s, float(i)) for i in (1, 2) for s in "AB"]
    assert sorted((r.event_id, r.entity, r.x_qty) for r in official.collect()) == [(1, "R", 2.0), (2, "R", 4.0)]


def test_pairing_days_broadcast_no_events(spark):
    assert broadcasts(pt._pairing_days(*history(spark), ["qty"])) == 0
