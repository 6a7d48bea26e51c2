"""Settlement, merging and dedupe of ledgers on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from twinside.operators import ledger as lg
from twinside.operators.joins import completed_fixtures, season_completeness
from twinside.operators.models import Market

MARKETS = (Market("qty", (1.5,)),)
DAY = dt.date(2001, 9, 1)
SIDES = "event_id bigint, season string, event_date date, side string, opponent string, venue string, qty_for double"


def both(event, home, away, a, b, day=DAY, season="2001-02"):
    return [(event, season, day, home, away, "H", a), (event, season, day, away, home, "A", b)]


def selections(spark, rows):
    base = spark.createDataFrame(rows, "prediction_id string, side_a string, side_b string, side string, market string, line double, odds double, stake double")
    return lg._stamped(base, lg.SELECTIONS, season=F.lit("2001-02"), status=F.lit("pending"), event_date=F.lit(DAY - dt.timedelta(days=3)), venue=F.lit("H"))


def now():
    return F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")


def settle(spark, picks, sides):
    done = lg.settle_selections(selections(spark, picks), completed_fixtures(spark.createDataFrame(sides, SIDES)), MARKETS, now())
    return {r["prediction_id"]: r for r in done.collect()}


def test_both_meetings_of_a_pair_settle_apart(spark):
    sides = both(1, "X", "Y", 5.0, 1.0) + both(2, "Y", "X", 0.0, 3.0, DAY + dt.timedelta(days=90))
    picks = [("first", "X", "Y", "X", "qty", 4.5, 2.0, 2.0), ("return", "Y", "X", "X", "qty", 4.5, 2.0, 2.0), ("total", "X", "Y", "TOTAL", "qty_total", 5.5, 1.0, None)]
    got = settle(spark, picks, list(reversed(sides)))
    assert (got["first"]["result"], got["first"]["profit"], got["first"]["event_date"]) == ("WIN", 2.0, DAY)
    assert (got["return"]["result"], got["return"]["profit"]) == ("LOSS", -2.0)
    assert (got["total"]["actual"], got["total"]["result"], got["total"]["profit"]) == (6.0, "WIN", None)


def test_incomplete_or_repeated_pairs_stay_pending(spark):
    half = both(1, "X", "Y", 5.0, 1.0)[:1]
    twice = both(2, "P", "Q", 5.0, 1.0) + both(3, "P", "Q", 4.0, 1.0)
    missing = both(4, "M", "N", None, 1.0)
    picks = [("half", "X", "Y", "X", "qty", 0.5, 2.0, 1.0), ("twice", "P", "Q", "P", "qty", 0.5, 2.0, 1.0), ("null", "M", "N", "M", "qty", 0.5, 2.0, 1.0)]
    got = settle(spark, picks, half + twice + missing)
    assert {r["status"] for r in got.values()} == {"pending"}


def test_merge_updates_pending_only_and_reports_conflicts(spark):
    ids = [(i, "X", "Y", "X", "qty", 0.5, 2.0, 1.0) for i in ("ok", "moved", "settled")]
    remote = selections(spark, ids).withColumns(
        {"status": F.when(F.col("prediction_id") == "settled", "settled").otherwise("pending"), "result": F.when(F.col("prediction_id") == "settled", "WIN")}
    )
    local = selections(spark, ids + [("extra", "X", "Y", "X", "qty", 0.5, 2.0, 1.0)]).withColumns(
        {"status": F.lit("settled"), "result": F.lit("LOSS"), "line": F.when(F.col("prediction_id") == "moved", 9.5).otherwise(F.col("line"))}
    )
    got = {r["prediction_id"]: (r["status"], r["result"], r["conflict"]) for r in lg.merge_settlements(remote, local).collect()}
    assert got == {
        "ok": ("settled", "LOSS", None), "moved": ("pending", None, "immutable inputs differ"),
        "settled": ("settled", "WIN", "settled differently"), "extra": (None, None, "missing remote id"),
    }


def test_append_keeps_known_ids(spark):
    chosen = spark.createDataFrame([("2001-02", DAY, "X", "Y", "X", "qty", 1.5, 2.0)], "season string, event_date date, side_a string, side_b string, side string, market string, line double, prediction double")
    empty = spark.createDataFrame([], lg.SELECTIONS)
    once = lg.archive_selections(empty, chosen, F.lit(1), now(), "v1", "manual")
    again = lg.archive_selections(once, chosen, F.lit(1), now(), "v2", "manual")
    assert [(r["model_version"], r["stake"]) for r in again.collect()] == [("v1", 1.0)]


def test_season_completeness_by_counts(spark):
    full = [("s", a, b) for a in "abc" for b in "abc" if a != b]
    frame = lambda rows: spark.createDataFrame(rows, "season string, side_a string, side_b string")
    assert season_completeness(frame(full)).first()["complete"]
    assert not season_completeness(frame(full[1:])).first()["complete"]
    assert not season_completeness(frame(full + full[:1])).first()["complete"]


def test_equal_copies_are_not_joined(spark, monkeypatch):
    """Copies in another order are compared by digests alone; of a changed copy only the changed buckets meet."""
    columns = ["result", "p_over", "stake"]
    rows = [(f"id{k}", None if k % 3 else "WIN", k / 7, k) for k in range(500)]
    frame = lambda data: spark.createDataFrame(data, "prediction_id string, result string, p_over double, stake int")
    left, met, real = frame(rows), [], lg._fields_equal

    def spy(a, b, key, names):
        met.append((a.count(), b.count()))
        return real(a, b, key, names)

    monkeypatch.setattr(lg, "_fields_equal", spy)
    same = frame([(i, r or "", p, s) for i, r, p, s in reversed(rows)]).repartition(7)
    got = lg.rows_equal(left, same, "prediction_id", columns).collect()
    assert len(got) == 500 and all(r["same"] for r in got) and not met
    assert lg.unchanged(left, same, ["prediction_id", *columns]).first()["unchanged"]
    changed = [*rows[:10], ("id10", "LOSS", 10 / 7, 10), ("id11", None, 11 / 7 * (1 + 2**-52), 11), *rows[13:], ("new", None, 0.5, 1)]
    got = {r["prediction_id"]: r["same"] for r in lg.rows_equal(left, frame(changed), "prediction_id", columns).collect()}
    assert {k for k, v in got.items() if not v} == {"id10", "id12", "new"} and len(got) == 501
    assert len(met) == 1 and max(met[0]) < 30
    assert lg.unchanged(left, frame(changed), ["prediction_id", *columns]).first()["changed_rows"] == 3
    assert lg.rows_equal(left.limit(0), left.limit(0), "prediction_id", columns).collect() == []


def test_merge_moves_digests_in_place_of_fields_that_are_not_returned(spark):
    """Whole rows of both copies met to be compared, however few columns were read."""
    ids = [(i, "X", "Y", "X", "qty", 0.5, 2.0, 1.0) for i in ("a", "b", "c")]
    remote = selections(spark, ids).withColumn("status", F.when(F.col("prediction_id") == "b", "settled").otherwise("pending"))
    remote = remote.withColumn("official", F.when(F.col("prediction_id") == "b", ""))
    local = selections(spark, ids[:2]).withColumns({"status": F.lit("settled"), "official": F.lit(None).cast("string")})
    merged = lg.merge_settlements(remote, local)
    assert {r["prediction_id"]: (r["status"], r["conflict"]) for r in merged.collect()} == {"a": ("settled", None), "b": ("settled", None), "c": ("pending", None)}
    assert merged.columns == [*remote.columns, "conflict"]
    other = lg.merge_settlements(remote, local.withColumn("official", F.lit("x")))
    assert {r["prediction_id"]: r["conflict"] for r in other.collect()} == {"a": None, "b": "settled differently", "c": None}
    moved = merged.select("prediction_id", "status", "conflict")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(k for k, line in enumerate(moved) if "Join FullOuter" in line)
    assert "model_version" not in moved[join] and not any("r_model_version" in line for line in moved)
