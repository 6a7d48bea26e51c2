"""Queries L-*, A-18 and A-19: archives, settlement, merges and revisions.

Forecasts of every contest form the ledgers; a contest's own number is the leg
of its pairing.  Contests of every eighth number count as not yet played.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from twinside.functions import probability as pr
from twinside.operators import ledger as lg, models as md, ordering as od
from twinside.operators.joins import completed_fixtures
from twinside.operators.sides import side_rows
from twinside.plans.base import query, shared
from twinside.plans.gates import SCHEDULE, schedule
from twinside.plans.models import ALPHA, FORECASTS, LINES, MARKETS, over_sql, pmf_sql
from twinside.session import settle
from twinside.sources.tables import METRICS, contests

NOW, OLD = "2002-01-01 12:00:00", "2001-12-01 12:00:00"
HALF = "1998-99"

BASE = FORECASTS + SCHEDULE + f""", line_list(market, line) AS (VALUES {LINES}),
lf AS (SELECT f.*, z.side_a, z.side_b, z.match_round FROM forecasts f JOIN schedule z USING (event_id) WHERE prediction IS NOT NULL),
ls AS (SELECT *, {over_sql('greatest(prediction, 0.05)', 'line', 'alpha')} AS p_over FROM (SELECT lf.*, line, {ALPHA} AS alpha FROM lf JOIN line_list USING (market))),
sel AS (SELECT * EXCLUDE (rn), substr(sha1(season || '|' || event_date || '|' || side_a || '|' || side_b || '|' || event_id || '|' || side || '|' || market || '|' || line), 1, 20) AS prediction_id,
    CASE event_id % 4 WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS stake, CASE WHEN event_id % 6 = 0 THEN 0.9 ELSE least(1000, 1.05 / p_over) END AS odds FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id, side, market ORDER BY p_over DESC, line) AS rn FROM ls WHERE p_over <= 0.5) WHERE rn = 1),
comp AS (SELECT event_id, event_date AS real_date, {", ".join(f"a_{m.name} AS ra_{m.name}, b_{m.name} AS rb_{m.name}" for m in MARKETS)} FROM contests WHERE event_id % 8 <> 0),
selset AS (SELECT s.*, real_date, CASE market {" ".join(f"WHEN '{m.name}' THEN CASE WHEN s.side = s.side_a THEN ra_{m.name} ELSE rb_{m.name} END" for m in MARKETS)} END::DOUBLE AS actual FROM sel s LEFT JOIN comp USING (event_id)),
settled AS (SELECT *, CASE WHEN actual IS NULL THEN 'pending' ELSE 'settled' END AS status, CASE WHEN actual > line THEN 'WIN' WHEN actual <= line THEN 'LOSS' END AS result,
  CASE WHEN actual <= line THEN -(CASE WHEN stake > 0 THEN stake ELSE 1 END) WHEN actual > line AND odds > 1 THEN (CASE WHEN stake > 0 THEN stake ELSE 1 END) * (odds - 1) END AS profit FROM selset)
"""


def at(moment: str):
    return F.lit(moment).cast("timestamp_ntz")


def scored(spark, root):
    """(contests, forecasts of every contest with their round and leg)"""
    c = shared(spark, root, "contests", lambda: contests(spark, root))
    return c, shared(spark, root, "scored", lambda: forecast_rounds(c))


def forecast_rounds(c):
    train = md.season_train_means(side_rows(c, METRICS), [m.target for m in MARKETS])
    rows = md.baseline_forecasts(md.baseline_features(c, METRICS), train, MARKETS).filter("prediction IS NOT NULL")
    start = F.make_date(F.substring("season", 1, 4).cast("int"), F.lit(7), F.lit(1))
    rows = rows.join(c.select("event_id", "side_a", "side_b"), "event_id")
    return rows.withColumns({"match_round": F.floor(F.datediff("event_date", start) / 10 + 1), "leg": F.col("event_id")})


def completed(c):
    """Fixtures of the contests that count as played."""
    return completed_fixtures(side_rows(c.filter("event_id % 8 <> 0").withColumn("leg", F.col("event_id")), METRICS, keep=("leg",)))


def lines(rows):
    """The best line of each forecast row."""
    return md.over_lines(rows.drop("opponent", "target"), MARKETS, min_fair=2.0).drop("p_under", "fair_under")


def chosen(c, rows):
    """The best line of each forecast."""
    keys = ["event_id", "side", "market"]
    # One row a forecast is left: only a repeated contest can have more, and combining before the shuffle would sort all of them for nothing.
    best = od.where_repeated(lines(rows), c.select("event_id"), ["event_id"], lambda x: od.best_line(x.repartition(*keys), keys))
    return best.withColumns(
        {
            "stake": F.expr("CASE event_id % 4 WHEN 0 THEN -1.0D WHEN 1 THEN 2.5D ELSE 1.0D END"),
            "odds": F.expr("CASE WHEN event_id % 6 = 0 THEN 0.9D ELSE least(1000D, 1.05D / p_over) END"),
        }
    )


def empty(spark, schema):
    # The limit shows the optimizer that nothing is stored, so new rows are not moved to be compared with it.
    return spark.createDataFrame([], schema).limit(0)


def selections(spark, root):
    """(contests, pending selection ledger)"""
    c, rows = scored(spark, root)
    new = lambda: lg.archive_selections(empty(spark, lg.SELECTIONS), chosen(c, rows), F.col("match_round"), at(OLD), "v1", "manual")
    return c, shared(spark, root, "selections", new)


def settled_selections(spark, root):
    c, ledger = selections(spark, root)
    return lg.settle_selections(ledger, completed(c), MARKETS, at(NOW))


@query(
    "L_01_archive_selections",
    BASE + f"SELECT prediction_id, match_round, side, market, line, round(p_over, 6) AS p_over, stake, 'pending' AS status, CASE WHEN season < '{HALF}' THEN 'v0' ELSE 'v1' END AS model_version FROM sel",
)
def archive(spark, root):
    c, rows = scored(spark, root)
    picked = settle(chosen(c, rows), "chosen")
    stored = lg.archive_selections(empty(spark, lg.SELECTIONS), picked.filter(F.col("season") < HALF), F.col("match_round"), at(OLD), "v0", "manual")
    got = lg.archive_selections(stored, picked, F.col("match_round"), at(NOW), "v1", "manual")
    return got.select("prediction_id", "match_round", "side", "market", "line", "p_over", "stake", "status", "model_version")


RANGES = f""", pts AS (SELECT event_id, season, side_a, side_b, event_date, match_round, side, venue, market, prediction, {ALPHA} AS alpha FROM lf
    UNION ALL SELECT event_id, season, side_a, side_b, max(event_date), max(match_round), 'TOTAL', 'T', market || '_total', max(prediction) FILTER (venue = 'H') + max(prediction) FILTER (venue = 'A'),
      CASE WHEN market = 'lines' THEN (sum(greatest(prediction, 0.05)) + 0.11 * sum(greatest(prediction, 0.05) * greatest(prediction, 0.05)) - greatest(sum(prediction), 0.05)) / pow(greatest(sum(prediction), 0.05), 2) END FROM lf GROUP BY event_id, season, side_a, side_b, market),
  audit AS (SELECT *, substr(sha1(season || '|' || side_a || '|' || side_b || '|' || event_id || '|' || side || '|' || market), 1, 20) AS prediction_id, greatest(0.5::DOUBLE, ceil(prediction) - 0.5) AS test_line,
    CASE market WHEN 'qty' THEN 3 WHEN 'qty_total' THEN 4 WHEN 'lines_total' THEN 3 ELSE 2 END AS w, greatest(prediction, 0.05) AS mu FROM pts),
  cand AS (SELECT prediction_id, w, unnest(range(greatest(0, CAST(floor(mu) AS BIGINT) - w - 4), CAST(floor(mu) AS BIGINT) + 4)) AS k, mu, alpha FROM audit),
  sums AS (SELECT prediction_id, k, w, list_sum(list_transform(range(0, w), lambda j: {pmf_sql('(k + j)', 'mu', 'alpha')})) AS s FROM cand),
  ranged AS (SELECT prediction_id, CAST(k AS BIGINT) AS range_low, CAST(k + w - 1 AS BIGINT) AS range_high, s AS range_probability FROM (
    SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY round(s, 12) DESC, k) AS rn FROM sums) WHERE rn = 1),
  alog AS (SELECT * FROM audit JOIN ranged USING (prediction_id))
"""


def points(spark, root):
    """(contests, pending audit log with likeliest ranges)"""
    c, rows = scored(spark, root)
    keys = ["season", "match_round", "event_date", "side_a", "side_b", "leg"]
    totals = md.total_forecasts(rows, keys).withColumns({"side": F.lit("TOTAL"), "venue": F.lit("T")})
    keep = [*keys, "side", "venue", "market", "prediction", "official"]
    both = rows.select(*keep).unionByName(totals.withColumn("official", F.lit(None).cast("string")).select(*keep))
    priced = both.withColumn("line", F.lit(0.5))
    new = lambda: lg.archive_points(empty(spark, lg.AUDITS), priced, F.col("match_round"), at(OLD), "v1", MARKETS, c.select("event_id"))
    return c, shared(spark, root, "points", new)


@query("L_02_archive_points", BASE + RANGES + "SELECT prediction_id, side, market, test_line, range_low, range_high, round(range_probability, 6) AS range_probability FROM alog")
def archive_points(spark, root):
    return points(spark, root)[1].select("prediction_id", "side", "market", "test_line", "range_low", "range_high", "range_probability")


@query("M_21_fill_missing_ranges", BASE + RANGES + "SELECT prediction_id, CASE WHEN match_round % 2 = 0 THEN 1 ELSE range_low END AS range_low, CASE WHEN match_round % 2 = 0 THEN 2 ELSE range_high END AS range_high FROM alog")
def fill_ranges(spark, root):
    _, log = points(spark, root)
    known = F.col("match_round") % 2 == 0
    gaps = log.withColumns(
        {
            "range_low": F.when(known, F.lit(1)).cast("bigint"), "range_high": F.when(known, F.lit(2)).cast("bigint"),
            "range_probability": F.when(known, F.lit(0.5)),
        }
    )
    return md.fill_ranges(gaps, MARKETS, lg.FIXTURE).select("prediction_id", "range_low", "range_high")


@query("L_03_settle_selections", BASE + "SELECT prediction_id, status, coalesce(real_date, event_date) AS event_date, actual, result, round(profit, 6) AS profit FROM settled")
def settle_sel(spark, root):
    return settled_selections(spark, root).select("prediction_id", "status", "event_date", "actual", "result", "profit")


AUDITED = RANGES + f""", au AS (SELECT l.*, real_date, CASE market {" ".join(f"WHEN '{m.name}' THEN CASE WHEN l.side = l.side_a THEN ra_{m.name} ELSE rb_{m.name} END WHEN '{m.total}' THEN ra_{m.name} + rb_{m.name}" for m in MARKETS)} END::DOUBLE AS actual
    FROM alog l LEFT JOIN comp USING (event_id)),
  judged AS (SELECT *, CASE WHEN actual IS NULL THEN 'pending' ELSE 'settled' END AS status, CASE WHEN actual > test_line THEN 'HIT' WHEN actual <= test_line THEN 'MISS' END AS result,
    CASE WHEN actual BETWEEN range_low AND range_high THEN 'HIT' WHEN actual IS NOT NULL THEN 'MISS' END AS range_result, actual - prediction AS error,
    CASE WHEN actual > prediction THEN 'under' WHEN actual < prediction THEN 'over' WHEN actual = prediction THEN 'exact' END AS bias FROM au)
"""


def settled_points(spark, root):
    c, log = points(spark, root)
    return lg.settle_points(log, completed(c), MARKETS, at(NOW))


@query("L_04_settle_points", BASE + AUDITED + "SELECT prediction_id, status, actual, result, range_result, round(error, 6) AS error, round(abs(error), 6) AS abs_error, bias FROM judged")
def settle_pts(spark, root):
    return settled_points(spark, root).select("prediction_id", "status", "actual", "result", "range_result", "error", "abs_error", "bias")


@query(
    "A_18_selection_summary",
    BASE + """, s AS (SELECT *, coalesce(stake, 1) AS st FROM settled WHERE status = 'settled')
    SELECT count(*) AS n, count(*) FILTER (result = 'WIN') AS wins, count(*) FILTER (result = 'LOSS') AS losses, round(count(*) FILTER (result = 'WIN') / count(*), 6) AS hit_rate, round(ln(avg(1 / p_over)), 6) AS avg_fair,
      round(avg(odds), 6) AS avg_odds, round(sum(coalesce(profit, 0)), 6) AS profit, round(sum(st), 6) AS staked, round(sum(coalesce(profit, 0)) / sum(st), 6) AS roi FROM s""",
)
def sel_summary(spark, root):
    # Fair odds of very long shots are huge: their mean is compared by its logarithm.
    return lg.selection_summary(settled_selections(spark, root)).withColumn("avg_fair", F.ln("avg_fair"))


@query(
    "A_19_audit_summary",
    BASE + AUDITED + """SELECT count(*) AS n, round(avg(CASE WHEN range_result = 'HIT' THEN 1.0::DOUBLE ELSE 0 END), 6) AS range_hit_rate, round(avg(range_high - range_low + 1), 6) AS avg_width, round(avg(abs(error)), 6) AS mae,
    round(avg(error), 6) AS bias, round(avg(CASE WHEN error > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS under_rate, round(avg(CASE WHEN error < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS over_rate FROM judged WHERE status = 'settled'""",
)
def pts_summary(spark, root):
    return lg.audit_summary(settled_points(spark, root))


@query(
    "L_05_semantic_dedupe",
    BASE + AUDITED + """SELECT prediction_id, round(prediction, 6) AS prediction, status, actual,
      CASE WHEN status = 'settled' THEN range_low WHEN match_round % 2 = 0 THEN range_low + 1 ELSE range_low END AS range_low FROM judged""",
)
def dedupe(spark, root):
    c, log = points(spark, root)
    log = log.withColumn("seq", F.lit(0))
    later = F.lit("2001-12-05 12:00:00").cast("timestamp_ntz")
    # A later copy with another forecast and a newer range, and a settled copy.
    copy = log.filter("match_round % 2 = 0").withColumns(
        {"created_at": later, "prediction": F.col("prediction") + 1, "range_low": F.col("range_low") + 1, "seq": F.lit(1)}
    )
    done = lg.settle_points(log.drop("seq"), completed(c), MARKETS, at(NOW)).filter("status = 'settled'").withColumn("seq", F.lit(2))
    got = lg.dedupe_log(copy.unionByName(done.select(*log.columns)).unionByName(log), "seq")
    return got.select("prediction_id", "prediction", "status", "actual", "range_low")


MERGE_CASE = """, base AS (SELECT *, row_number() OVER (ORDER BY prediction_id) AS pos, CAST(('0x' || substr(prediction_id, 1, 6)) AS BIGINT) AS h FROM settled)"""


def merge_inputs(spark, root):
    """Remote ledger (a fifth already settled) and a settled candidate with planted faults."""
    c, ledger = selections(spark, root)
    done = settle(lg.settle_selections(ledger, completed(c), MARKETS, at(NOW)), "done")
    h = F.conv(F.substring("prediction_id", 1, 6), 16, 10).cast("bigint")
    # Settling keeps every row and its id, so the rows that are not early are told by their id in the ledger too.
    early = F.coalesce(h % 5 == 0, F.lit(False))
    remote = ledger.filter(~early).unionByName(done.filter(early).select(*ledger.columns))
    candidate = done.withColumns(
        {"result": F.when(h % 10 == 0, F.lit("VOID")).otherwise(F.col("result")), "stake": F.when(h % 7 == 1, F.col("stake") + 1).otherwise(F.col("stake"))}
    )
    extra = done.filter((F.col("status") == "settled") & (h % 50 == 1)).withColumn("prediction_id", F.concat(F.lit("x"), "prediction_id"))
    return remote, candidate, extra


@query(
    "L_06_merge_settlements",
    BASE + """, b AS (SELECT *, CAST('0x' || substr(prediction_id, 1, 6) AS BIGINT) AS h FROM settled),
    j AS (SELECT prediction_id, result, actual, CASE WHEN status <> 'settled' THEN NULL WHEN h % 5 = 0 THEN CASE WHEN h % 10 = 0 OR h % 7 = 1 THEN 'settled differently' END
        WHEN h % 7 = 1 THEN 'immutable inputs differ' END AS conflict, status, h FROM b)
    SELECT prediction_id, CASE WHEN status = 'settled' AND (h % 5 = 0 OR conflict IS NULL) THEN 'settled' ELSE 'pending' END AS status,
      CASE WHEN status = 'settled' AND (h % 5 = 0 OR conflict IS NULL) THEN result END AS result, CASE WHEN status = 'settled' AND (h % 5 = 0 OR conflict IS NULL) THEN actual END AS actual, conflict FROM j
    UNION ALL SELECT 'x' || prediction_id, NULL, NULL, NULL, 'missing remote id' FROM b WHERE status = 'settled' AND h % 50 = 1""",
)
def merge(spark, root):
    remote, candidate, extra = merge_inputs(spark, root)
    got = lg.merge_settlements(remote, candidate.unionByName(extra))
    return got.select("prediction_id", "status", "result", "actual", "conflict")


@query(
    "L_07_id_violations",
    BASE + """, b AS (SELECT prediction_id, CAST('0x' || substr(prediction_id, 1, 6) AS BIGINT) AS h FROM sel)
    SELECT prediction_id, 'repeated remote id' AS violation FROM b WHERE h % 11 = 0 AND h % 13 <> 0 UNION ALL SELECT prediction_id, 'missing remotely' FROM b WHERE h % 13 = 0""",
)
def ids(spark, root):
    _, ledger = selections(spark, root)
    rows = ledger
    h = F.conv(F.substring("prediction_id", 1, 6), 16, 10).cast("bigint")
    kept = rows.filter(h % 13 != 0)
    return lg.id_violations(kept.unionByName(kept.filter(h % 11 == 0)), rows)


@query(
    "L_07_lost_settlements",
    BASE + """, b AS (SELECT *, CAST('0x' || substr(prediction_id, 1, 6) AS BIGINT) AS h FROM settled WHERE status = 'settled')
    SELECT prediction_id, CASE WHEN h % 3 = 0 THEN 'settled state lost' ELSE 'differs: actual' END AS violation FROM b WHERE h % 3 = 0 OR h % 4 = 1""",
)
def lost(spark, root):
    done = settle(settled_selections(spark, root), "done")
    h = F.conv(F.substring("prediction_id", 1, 6), 16, 10).cast("bigint")
    merged = done.withColumns({"status": F.when(h % 3 == 0, "pending").otherwise(F.col("status")), "actual": F.when(h % 4 == 1, F.col("actual") + 1).otherwise(F.col("actual"))})
    return lg.settlement_violations(merged, done)


SHA = "a" * 64


def revision_of(spark, root):
    """(base log, revision of one third of its rounds) with a changed forecast."""
    c, log = points(spark, root)
    base = log
    official = F.lit("R Official")
    rescored = base.filter("match_round % 3 = 0").withColumns(
        {"prediction": F.col("prediction") + 0.25, "official": official, "created_at": F.lit("2001-12-02 12:00:00").cast("timestamp_ntz")}
    )
    moment = lambda t: F.lit(t).cast("timestamp_ntz")
    provenance = {
        "revision": F.lit(2), "revision_reason": F.lit("officials_available_before_kickoff"), "model_sha256": F.lit(SHA), "training_data_sha256": F.lit(SHA),
        "original_archive_sha256": F.when(F.col("match_round") % 6 == 0, F.lit(SHA)).otherwise("short"),
        "first_kickoff": moment("2001-12-03 15:00:00"), "verified_at": moment("2001-12-02 11:00:00"),
    }
    return c, base, lg.build_revision(rescored, base, provenance)


@query("L_08_active_ledger", BASE + RANGES + "SELECT prediction_id, round(CASE WHEN match_round % 3 = 0 THEN prediction + 0.25 ELSE prediction END, 6) AS prediction FROM alog")
def active(spark, root):
    _, base, revisions = revision_of(spark, root)
    return lg.active(base, revisions).select("prediction_id", "prediction")


@query(
    "L_09_revision_rules",
    BASE + RANGES + """, g AS (SELECT season, match_round, side_a, side_b, event_id, count(*) AS n FROM alog WHERE match_round % 3 = 0 GROUP BY ALL),
    r AS (SELECT season, match_round, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS fixtures, count(*) FILTER (n <> 9) AS uncovered FROM g GROUP BY season, match_round)
    SELECT season, match_round, row_count, array_to_string(list_filter([CASE WHEN row_count <> 90 THEN 'wrong size or revision' END, CASE WHEN match_round % 6 <> 0 THEN 'bad provenance hash' END,
      CASE WHEN uncovered > 0 OR fixtures <> 10 THEN 'incomplete coverage' END], lambda z: z IS NOT NULL), ',') AS violations FROM r""",
)
def revision_rules(spark, root):
    _, base, revisions = revision_of(spark, root)
    return lg.revision_violations(base, revisions).withColumn("violations", F.array_join("violations", ","))


@query(
    "L_10_split_save",
    BASE + AUDITED + """SELECT prediction_id, 'base' AS ledger, CASE WHEN match_round % 3 = 0 THEN 'pending' ELSE status END AS status, NULL::VARCHAR AS conflict FROM judged
    UNION ALL SELECT prediction_id, 'revisions', status, NULL FROM judged WHERE match_round % 3 = 0""",
)
def split(spark, root):
    c, base, revisions = revision_of(spark, root)
    revisions = settle(revisions, "revisions")
    done = lg.settle_points(lg.active(base, revisions), completed(c), MARKETS, at(NOW))
    restored, merged = lg.split_save(base, revisions, settle(done, "active"), base.columns)
    first = restored.select("prediction_id", F.lit("base").alias("ledger"), "status", F.lit(None).cast("string").alias("conflict"))
    return first.unionByName(merged.select("prediction_id", F.lit("revisions").alias("ledger"), "status", "conflict"))


@query("L_11_revision_build", BASE + RANGES + "SELECT prediction_id, prediction_id AS supersedes, 2::BIGINT AS revision, round(prediction + 0.25, 6) AS prediction FROM alog WHERE match_round % 3 = 0")
def build(spark, root):
    return revision_of(spark, root)[2].select("prediction_id", "supersedes", "revision", "prediction")


@query(
    "L_12_delete_batch",
    BASE + """, b AS (SELECT season, match_round FROM sel WHERE NOT (season = '1997-98' AND match_round = 4)) SELECT season, match_round, count(*) AS row_count FROM b GROUP BY ALL""",
)
def delete(spark, root):
    _, ledger = selections(spark, root)
    rows = ledger
    size = rows.filter("season = '1997-98' AND match_round = 4").count()
    kept = lg.delete_batch(lg.delete_batch(rows, "1997-98", 4, size), "1998-99", 4, -1)
    return kept.groupBy("season", "match_round").agg(F.count("*").alias("row_count"))


@query(
    "L_13_annotations",
    BASE + "SELECT prediction_id, 'round ' || match_round AS note FROM sel WHERE season = '1997-98'",
)
def annotations(spark, root):
    from twinside.session import work_path

    _, ledger = selections(spark, root)
    rows = ledger
    path = work_path(spark, "audits")
    notes = rows.filter("season = '1997-98'").select(F.concat(F.lit("round "), "match_round").alias("note"), F.array("prediction_id").alias("prediction_ids"))
    notes.write.json(path)
    audits = spark.read.schema("note string, prediction_ids array<string>").json(path)
    return lg.annotate(rows.select("prediction_id"), audits).select("prediction_id", "note")


@query("L_14_copy_counts", BASE + "SELECT count(*) AS left_rows, count(*) FILTER (season <> '1997-98') AS right_rows, count(*) = count(*) FILTER (season <> '1997-98') AS equal FROM sel")
def copies(spark, root):
    _, ledger = selections(spark, root)
    rows = ledger
    return lg.count_copies(rows, rows.filter("season <> '1997-98'"))


@query("L_15_field_equality", BASE + "SELECT prediction_id, match_round % 5 <> 0 AS same FROM sel")
def field_equality(spark, root):
    _, ledger = selections(spark, root)
    rows = ledger
    # Empty text for null and one representable step are equal; a rounded value is not.
    other = rows.withColumns(
        {
            "result": F.coalesce("result", F.lit("")), "p_over": F.col("p_over") * F.lit(1.0 + 2.0**-52),
            "prediction": F.when(F.col("match_round") % 5 == 0, F.col("prediction") + 0.001).otherwise(F.col("prediction")),
        }
    )
    return lg.rows_equal(rows, other, "prediction_id", ["result", "p_over", "prediction", "stake", "market"])


@query("L_16_revision_second_copy", BASE + RANGES + "SELECT prediction_id, 'identity or provenance differs' AS violation FROM alog WHERE match_round % 3 = 0 AND match_round % 4 = 0")
def second_copy(spark, root):
    _, _, revisions = revision_of(spark, root)
    rows = settle(revisions, "revisions")
    remote = rows.withColumn("model_sha256", F.when(F.col("match_round") % 4 == 0, F.lit("b" * 64)).otherwise(F.col("model_sha256")))
    return lg.revision_second_copy(rows, remote)


@query("L_17_unchanged_save", BASE + RANGES + "SELECT count(*) FILTER (match_round = 7) AS changed_rows, count(*) FILTER (match_round = 7) = 0 AS unchanged FROM alog")
def unchanged(spark, root):
    _, log = points(spark, root)
    rows = log
    touched = rows.withColumn("status", F.when(F.col("match_round") == 7, "settled").otherwise(F.col("status")))
    return lg.unchanged(rows, touched, lg.AUDITS.names)
