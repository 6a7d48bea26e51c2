"""Append-only prediction ledgers: archive, settlement, merge and revisions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from twinside.functions.numbers import half_line_below, near_equal, same_field, to_number
from twinside.functions.text import is_blank, is_person, text_id
from twinside.operators.joins import append_only, with_leg
from twinside.operators.models import Market, fill_ranges
from twinside.operators.ordering import lowest_line, where_repeated
from twinside.session import settle


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType()}


def _schema(fields: str) -> T.StructType:
    """A struct from ``name type, ...`` text; needs no running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


SELECTIONS = _schema(
    "prediction_id string, created_at timestamp_ntz, season string, match_round bigint, event_date date, side_a string, side_b string, leg bigint, "
    "official string, side string, venue string, market string, line double, prediction double, p_over double, fair_over double, "
    "odds double, stake double, model_version string, source string, status string, actual double, result string, profit double, "
    "settled_at timestamp_ntz"
)
AUDITS = _schema(
    "prediction_id string, created_at timestamp_ntz, season string, match_round bigint, event_date date, side_a string, side_b string, leg bigint, "
    "official string, side string, venue string, market string, prediction double, test_line double, range_low bigint, range_high bigint, "
    "range_probability double, range_result string, status string, actual double, result string, error double, abs_error double, "
    "bias string, model_version string, settled_at timestamp_ntz"
)
FIXTURE = ["season", "side_a", "side_b", "leg"]
RANGE = ["range_low", "range_high", "range_probability", "range_result"]
SETTLED_POINT = ["status", "actual", "result", *RANGE, "error", "abs_error", "bias", "settled_at", "event_date", "match_round"]
SETTLEMENT = ["status", "actual", "result", "error", "abs_error", "bias", "range_result", "settled_at", "event_date"]
REVISION = [
    "revision", "revision_reason", "original_created_at", "model_sha256", "training_data_sha256", "original_archive_sha256",
    "first_kickoff", "verified_at", "supersedes",
]


def _stamped(df: DataFrame, schema: T.StructType, **values: Column) -> DataFrame:
    """Contract columns in order: given values first, then the frame's own, else null."""
    df = with_leg(df)
    pick = lambda n: values[n] if n in values else (F.col(n) if n in df.columns else F.lit(None))
    return df.select(*[pick(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def selection_id() -> Column:
    """Id of a chosen line; the date is part of it."""
    return text_id([F.col(c) for c in ("season", "event_date", "side_a", "side_b", "leg", "side", "market", "line")])


def audit_id() -> Column:
    """Id of a point forecast; dates can move, so they are not part of it."""
    return text_id([F.col(c) for c in (*FIXTURE, "side", "market")])


def archive_selections(ledger: DataFrame, chosen: DataFrame, match_round: Column, now: Column, version: str, source: str) -> DataFrame:
    """Append chosen lines as pending; known ids stay untouched."""
    new = _stamped(
        chosen, SELECTIONS, prediction_id=selection_id(), created_at=now, match_round=match_round, model_version=F.lit(version),
        source=F.lit(source), status=F.lit("pending"), stake=F.coalesce(F.col("stake"), F.lit(1.0)) if "stake" in chosen.columns else F.lit(1.0),
    )
    return append_only(ledger, new, "prediction_id")


def archive_points(
    log: DataFrame, scored: DataFrame, match_round: Column, now: Column, version: str, markets: Sequence[Market], legs: DataFrame | None = None
) -> DataFrame:
    """Append one pending row per fixture, side and market, then fill likeliest ranges.

    ``legs`` may list the leg of every meeting: a side and market of a leg that occurs once there has one row.
    """
    # Rows lie by fixtures from here on. Nearly all are kept: combining before the shuffle would sort them for nothing.
    lowest = lambda rows: lowest_line(rows.repartition(*FIXTURE), [*FIXTURE, "side", "market"])
    points = lowest(with_leg(scored)) if legs is None else where_repeated(with_leg(scored), legs, ["leg"], lowest)
    new = _stamped(
        points, AUDITS, prediction_id=audit_id(), created_at=now, match_round=match_round, test_line=half_line_below(F.col("prediction")),
        status=F.lit("pending"), model_version=F.lit(version),
    )
    return fill_ranges(append_only(log, new, "prediction_id"), markets, FIXTURE)


def _actual(markets: Sequence[Market]) -> Column:
    """Realised value of a ledger row from its resolved fixture (structs ``h`` and ``a``)."""
    total = F.col("market").endswith("_total")
    base = F.regexp_replace("market", "_total$", "")
    value = F.lit(None).cast("double")
    for m in markets:
        h, a = F.col(f"h.{m.target}").cast("double"), F.col(f"a.{m.target}").cast("double")
        own = F.when(F.col("side") == F.col("h.side"), h).when(F.col("side") == F.col("a.side"), a)
        value = F.when(base == m.name, F.when(total, h + a).otherwise(own)).otherwise(value)
    return value


def settle_selections(ledger: DataFrame, completed: DataFrame, markets: Sequence[Market], now: Column) -> DataFrame:
    """The ledger with every resolvable pending row settled; other rows unchanged."""
    rows = ledger.join(completed.select(*FIXTURE, "h", "a"), FIXTURE, "left").withColumn("_actual", _actual(markets))
    done = (F.col("status") == "pending") & F.col("_actual").isNotNull()
    won = F.col("_actual") > F.col("line")
    stake = F.when(to_number(F.col("stake")) > 0, F.col("stake")).otherwise(1.0)
    profit = F.when(~won, -stake).when(F.col("odds") > 1, stake * (F.col("odds") - 1.0))
    new = {
        "event_date": F.col("h.event_date"), "actual": F.col("_actual"), "result": F.when(won, "WIN").otherwise("LOSS"),
        "profit": profit, "status": F.lit("settled"), "settled_at": now,
    }
    return rows.select(*[F.when(done, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in ledger.columns])


def settle_points(log: DataFrame, completed: DataFrame, markets: Sequence[Market], now: Column) -> DataFrame:
    """The audit log with resolvable pending rows settled: line and range hits, errors and their direction."""
    rows = log.join(completed.select(*FIXTURE, "h", "a"), FIXTURE, "left").withColumn("_actual", _actual(markets))
    done = (F.col("status") == "pending") & F.col("_actual").isNotNull()
    error = F.col("_actual") - F.col("prediction")
    inside = F.coalesce(F.col("_actual").between(F.col("range_low"), F.col("range_high")), F.lit(False))
    new = {
        "event_date": F.col("h.event_date"), "actual": F.col("_actual"),
        "result": F.when(F.col("_actual") > F.col("test_line"), "HIT").otherwise("MISS"),
        "range_result": F.when(inside, "HIT").otherwise("MISS"), "error": error, "abs_error": F.abs(error),
        "bias": F.when(error > 0, "under").when(error < 0, "over").otherwise("exact"), "status": F.lit("settled"), "settled_at": now,
    }
    return rows.select(*[F.when(done, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in log.columns])


def selection_summary(ledger: DataFrame) -> DataFrame:
    s = ledger.filter("status = 'settled'")
    stake, profit = F.sum(F.coalesce("stake", F.lit(1.0))), F.sum(F.coalesce("profit", F.lit(0.0)))
    wins = F.count_if(F.col("result") == "WIN")
    return s.agg(
        F.count("*").alias("n"), wins.alias("wins"), F.count_if(F.col("result") == "LOSS").alias("losses"),
        F.try_divide(wins, F.count("*")).alias("hit_rate"), F.avg("fair_over").alias("avg_fair"), F.avg("odds").alias("avg_odds"),
        F.coalesce(profit, F.lit(0.0)).alias("profit"), F.coalesce(stake, F.lit(0.0)).alias("staked"),
        F.when(stake > 0, profit / stake).alias("roi"),
    )


def audit_summary(log: DataFrame) -> DataFrame:
    """A row without an error counts as neither under nor over."""
    s = log.filter("status = 'settled'")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    judged = F.when(F.col("range_result").isin("HIT", "MISS"), (F.col("range_result") == "HIT").cast("double"))
    return s.agg(
        F.count("*").alias("n"), F.avg(judged).alias("range_hit_rate"), F.avg(F.col("range_high") - F.col("range_low") + 1).alias("avg_width"),
        F.avg("abs_error").alias("mae"), F.avg("error").alias("bias"),
        share(F.col("error") > 0).alias("under_rate"), share(F.col("error") < 0).alias("over_rate"),
    )


def dedupe_log(log: DataFrame, seq: str) -> DataFrame:
    """One row per semantic key: the earliest forecast, the newest known range, the newest settlement on top.

    ``seq`` breaks ties of ``created_at``; every part is a maximum that
    combines on the map side.
    """
    keys = [*FIXTURE, "side", "market"]
    rest = [c for c in log.columns if c not in (*keys, seq)]
    created = F.coalesce("created_at", F.lit("9999-12-31").cast("timestamp_ntz"))
    order = F.struct(created, seq)
    known = lambda c: ~is_blank(F.col(c)) if c == "range_result" else F.col(c).isNotNull()
    settled = F.col("status") == "settled"
    packed = log.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), order).alias("_first"),
        *[F.max_by(F.when(known(c), F.col(c)), F.when(known(c), order)).alias(f"_{c}") for c in RANGE],
        F.max_by(F.when(settled, F.struct(*SETTLED_POINT)), F.when(settled, order)).alias("_settled"),
    )

    def value(c: str) -> Column:
        base = F.coalesce(F.col(f"_{c}"), F.col(f"_first.{c}")) if c in RANGE else F.col(f"_first.{c}")
        return F.when(F.col("_settled").isNotNull(), F.col(f"_settled.{c}")).otherwise(base) if c in SETTLED_POINT else base

    return packed.select(*keys, *[value(c).alias(c) for c in rest]).withColumn("prediction_id", audit_id()).select(
        *[c for c in log.columns if c != seq]
    )


def _prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(F.col(key), F.struct(*[c for c in df.columns]).alias(prefix))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions, F.lit(False))


IDENTITY = ["season", "side_a", "side_b", "leg", "side", "venue", "market"]
TIP_NUMBERS = ["line", "odds", "stake"]
TIP_SETTLEMENT = ["status", "actual", "result", "profit", "settled_at", "event_date"]


def merge_settlements(remote: DataFrame, candidate: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Remote rows updated from settled candidates, with a ``conflict`` reason per id.

    Only pending rows change; a different second settlement, changed inputs or
    an id the remote lacks is a conflict and leaves the remote row as it was.
    Rows that exist only in the candidate appear solely as conflicts.
    """
    columns = remote.columns

    def side(df: DataFrame, name: str) -> DataFrame:
        # Fields are compared by digests made before the join, and travel only if they are returned or compared as numbers.
        own = [F.col(n).alias(f"{name}_{n}") for n in columns if n != key]
        return df.select(key, *own, *text_digest([n for n in columns if n != key], f"_{name}"), *text_digest(IDENTITY, f"_{name}i"))

    both = side(remote, "r").join(side(candidate.filter("status = 'settled'"), "c"), key, "full")
    r, c = (lambda n: F.col(f"r_{n}")), (lambda n: F.col(f"c_{n}"))
    differ = lambda suffix: _any([F.col(f"_r{suffix}{h}") != F.col(f"_c{suffix}{h}") for h in "xy"])
    moved = _any([differ("i"), *[~near_equal(r(n), c(n)) for n in TIP_NUMBERS]])
    conflict = (
        F.when(F.col("_cx").isNull(), F.lit(None))
        .when(F.col("_rx").isNull(), "missing remote id")
        .when(r("status") == "settled", F.when(differ(""), "settled differently"))
        .when(r("status") == "pending", F.when(moved, "immutable inputs differ"))
        .otherwise("invalid remote status")
    )
    judged = both.withColumn("conflict", conflict)
    take = F.col("_cx").isNotNull() & F.col("conflict").isNull() & (r("status") == "pending")
    return judged.select(
        *[(F.when(take, c(n)).otherwise(r(n)) if n in TIP_SETTLEMENT else F.col(key) if n == key else r(n)).alias(n) for n in columns], "conflict"
    )


def id_violations(remote: DataFrame, local: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Blank and repeated ids on either side, and local ids the remote lacks."""

    def own(df: DataFrame, name: str) -> DataFrame:
        ids = df.groupBy(key).agg(F.count("*").alias("_n"))
        rule = F.when(is_blank(F.col(key)), f"blank {name} id").when(F.col("_n") > 1, f"repeated {name} id")
        return ids.select(key, rule.alias("violation")).filter("violation IS NOT NULL")

    missing = local.select(key).distinct().join(remote.select(key), key, "left_anti").withColumn("violation", F.lit("missing remotely"))
    return own(remote, "remote").unionByName(own(local, "local")).unionByName(missing.filter(~is_blank(F.col(key))))


def settlement_violations(merged: DataFrame, local: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Local settlements that a merge would lose or change."""
    saved = local.filter("status = 'settled'")
    both = _prefixed(saved, "l", key).join(_prefixed(merged, "m", key), key)
    differs = [
        F.when(~_equal_or_near(F.col(f"l.{n}"), F.col(f"m.{n}"), n in ("actual", "profit")), F.lit(n))
        for n in ("actual", "profit", "result", "settled_at", "event_date")
    ]
    fields = F.array_join(F.array_compact(F.array(*differs)), ",")
    lost = F.when(~F.equal_null(F.col("m.status"), F.lit("settled")), "settled state lost").when(fields != "", F.concat(F.lit("differs: "), fields))
    return both.select(key, lost.alias("violation")).filter("violation IS NOT NULL")


def _equal_or_near(a: Column, b: Column, numeric: bool) -> Column:
    return same_field(a, b, numeric)


#: Buckets of keys by which two copies of a ledger are compared.
BUCKETS = 4_096


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket")


def _texts(columns: Sequence[str]) -> list[Column]:
    """Fields as texts; null and empty text are one value."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]


def text_digest(columns: Sequence[str], name: str) -> list[Column]:
    """Two hashes, ``<name>x`` and ``<name>y``, of fields as texts."""
    fields = _texts(columns)
    return [F.xxhash64(*fields).alias(f"{name}x"), F.xxhash64(F.lit("again"), *fields).alias(f"{name}y")]


def bucket_digests(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows and two sums of row hashes for each bucket of keys, whatever the order; null and empty text are one value."""
    fields = _texts([key, *columns])
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    return df.groupBy(bucket_of(key)).agg(F.count("*").alias("rows"), wide(F.xxhash64(*fields)).alias("x"), wide(F.xxhash64(F.lit("again"), *fields)).alias("y"))


def differing_buckets(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Buckets whose digests differ; only digests meet, at most one row for each bucket of either copy."""
    both = bucket_digests(left, key, columns).alias("l").join(bucket_digests(right, key, columns).alias("r"), "_bucket", "full")
    same = reduce(lambda a, b: a & b, [F.equal_null(F.col(f"l.{c}"), F.col(f"r.{c}")) for c in ("rows", "x", "y")])
    return both.filter(~same).select("_bucket")


def rows_equal(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per key whether two ledgers agree: null equals empty text, numbers allow round-trip noise.

    Rows meet only in buckets of keys whose digests differ; two equal copies are not joined at all.
    """
    left, right = left.select(key, *columns), right.select(key, *columns)
    differ = settle(differing_buckets(left, right, key, columns), "differing-buckets")
    if differ.isEmpty():
        return left.select(key, F.lit(True).alias("same"))
    within = lambda df, how: df.withColumn("_bucket", bucket_of(key)).join(differ, "_bucket", how).drop("_bucket")
    return within(left, "left_anti").select(key, F.lit(True).alias("same")).unionByName(_fields_equal(within(left, "left_semi"), within(right, "left_semi"), key, columns))


def _fields_equal(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    numeric = {f.name for f in left.schema.fields if isinstance(f.dataType, T.NumericType)}
    both = _prefixed(left, "l", key).join(_prefixed(right, "r", key), key, "full")
    same = reduce(lambda x, y: x & y, [same_field(F.col(f"l.{c}"), F.col(f"r.{c}"), c in numeric) for c in columns])
    return both.select(key, (F.col("l").isNotNull() & F.col("r").isNotNull() & same).alias("same"))


def active(base: DataFrame, revisions: DataFrame) -> DataFrame:
    """Originals that no revision supersedes, and the revisions."""
    kept = base.join(revisions.select(F.col("supersedes").alias("prediction_id")), "prediction_id", "left_anti")
    return kept.unionByName(revisions.select(*base.columns))


def build_revision(rescored: DataFrame, base: DataFrame, provenance: dict[str, Column]) -> DataFrame:
    """Rescored rows joined to the originals they replace, with provenance columns."""
    old = base.select("prediction_id", F.col("created_at").alias("original_created_at"))
    return rescored.join(old, "prediction_id").withColumns({"supersedes": F.col("prediction_id"), **provenance})


def revision_violations(base: DataFrame, revisions: DataFrame, fixtures: int = 10, per_fixture: int = 9, reason: str = "officials_available_before_kickoff") -> DataFrame:
    """Broken rules per (season, match_round): size, provenance, time order, coverage and originals."""
    originals = base.select(
        F.col("prediction_id").alias("supersedes"), F.col("created_at").alias("_old_created"), F.col("status").alias("_old_status"),
        F.lit(True).alias("_known"),
    )
    sha = [F.col(c).rlike("^[0-9a-f]{64}$") for c in ("model_sha256", "training_data_sha256", "original_archive_sha256")]
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    row = revisions.join(originals, "supersedes", "left").withColumns(
        {
            "_bad_original": ~(
                F.coalesce("_known", F.lit(False)) & (F.col("prediction_id") == F.col("supersedes")) & (F.col("prediction_id") == audit_id())
                & F.equal_null("original_created_at", "_old_created") & F.equal_null(F.col("_old_status"), F.lit("pending"))
                & F.equal_null(F.col("revision_reason"), F.lit(reason)) & is_person(F.col("official"))
            ),
            "_bad_hash": ~F.coalesce(reduce(lambda x, y: x & y, sha), F.lit(False)),
            "_bad_time": ~F.coalesce(
                (F.col("created_at") < F.col("first_kickoff")) & (F.col("verified_at") < F.col("first_kickoff")) & (F.col("verified_at") <= F.col("created_at")),
                F.lit(False),
            ),
            "_bad_number": ~reduce(lambda x, y: x & y, [finite(c) for c in ("prediction", "test_line", "range_low", "range_high", "range_probability")]),
        }
    )
    # Coverage by counts: every fixture must hold each expected side and market once.
    by_fixture = row.groupBy("season", "match_round", "side_a", "side_b", "leg").agg(
        F.count("*").alias("n"), F.countDistinct("side", "market").alias("keys"), F.countDistinct("official").alias("officials"),
        F.count_if(
            (F.col("market").endswith("_total") & F.col("side").isin("TOTAL")) | (~F.col("market").endswith("_total") & ((F.col("side") == F.col("side_a")) | (F.col("side") == F.col("side_b"))))
        ).alias("expected_keys"),
        *[F.count_if(F.col(c)).alias(c) for c in ("_bad_original", "_bad_hash", "_bad_time", "_bad_number")],
        F.count_if(~F.equal_null(F.col("revision"), F.lit(2))).alias("_bad_revision"),
        F.countDistinct("created_at", "first_kickoff").alias("_times"), F.min(F.struct("created_at", "first_kickoff")).alias("_t"),
        (F.count("*") - F.countDistinct("prediction_id")).alias("_copies"),
    )
    rounds = by_fixture.groupBy("season", "match_round").agg(
        F.sum("n").alias("row_count"), F.count("*").alias("fixtures"),
        F.count_if((F.col("n") != per_fixture) | (F.col("keys") != per_fixture) | (F.col("expected_keys") != per_fixture)).alias("uncovered"),
        F.count_if(F.col("officials") != 1).alias("ambiguous"), F.max("_times").alias("_times"), F.countDistinct("_t").alias("_round_times"),
        *[F.sum(c).alias(c) for c in ("_bad_original", "_bad_hash", "_bad_time", "_bad_number", "_bad_revision", "_copies")],
    )
    rules = {
        "wrong size or revision": (F.col("row_count") != fixtures * per_fixture) | (F.col("_bad_revision") > 0),
        "repeated id": F.col("_copies") > 0,
        "not a pre-kickoff snapshot": (F.col("_bad_time") > 0) | (F.col("_times") != 1) | (F.col("_round_times") != 1),
        "bad provenance hash": F.col("_bad_hash") > 0,
        "original mismatch": F.col("_bad_original") > 0,
        "incomplete coverage": (F.col("uncovered") > 0) | (F.col("fixtures") != fixtures),
        "ambiguous official": F.col("ambiguous") > 0,
        "bad numbers": F.col("_bad_number") > 0,
    }
    return rounds.select(
        "season", "match_round", "row_count", F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()])).alias("violations")
    )


def merge_revision_settlement(existing: DataFrame, candidate: DataFrame, columns: Sequence[str], key: str = "prediction_id") -> DataFrame:
    """Revisions with new settlements; ``conflict`` names what may not happen."""
    numeric = {f.name for f in existing.schema.fields if isinstance(f.dataType, T.NumericType)}
    both = _prefixed(existing, "o", key).join(_prefixed(candidate, "n", key), key, "full")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    differ = lambda cs: _any([~same_field(o(c), n(c), c in numeric) for c in cs])
    conflict = (
        F.when(F.col("o").isNull() | F.col("n").isNull(), "identity lost")
        .when(differ([c for c in columns if c not in SETTLEMENT and c != key]), "immutable columns differ")
        .when((o("status") == "settled") & (n("status") == "settled"), F.when(differ(SETTLEMENT), "settled differently"))
        .when(~n("status").isin("pending", "settled"), "invalid status")
    )
    judged = both.withColumn("conflict", conflict)
    take = F.col("conflict").isNull() & (o("status") == "pending") & (n("status") == "settled")
    return judged.select(
        *[(F.when(take, n(c)).otherwise(o(c)) if c in SETTLEMENT else F.col(key) if c == key else o(c)).alias(c) for c in existing.columns], "conflict"
    )


def revision_second_copy(existing: DataFrame, remote: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Ids missing in either copy, and shared ids whose provenance differs."""
    verdict = rows_equal(existing, remote, key, REVISION)
    return verdict.filter("NOT same").select(key, F.lit("identity or provenance differs").alias("violation"))


def split_save(base: DataFrame, revisions: DataFrame, candidate: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(base ledger to save, revision ledger to save) from one active log.

    Revised rows settle in their own ledger; the base gets its original rows
    back unchanged.
    """
    superseded = revisions.select(F.col("supersedes").alias("prediction_id"))
    revised = candidate.join(superseded, "prediction_id", "left_semi")
    others = candidate.join(superseded, "prediction_id", "left_anti").select(*columns)
    restored = others.unionByName(base.join(superseded, "prediction_id", "left_semi").select(*columns))
    return restored, merge_revision_settlement(revisions, revised, columns)


def unchanged(base: DataFrame, restored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: would saving change nothing?"""
    verdict = rows_equal(base, restored, "prediction_id", [c for c in columns if c != "prediction_id"])
    return verdict.agg(F.count_if(~F.col("same")).alias("changed_rows")).withColumn("unchanged", F.col("changed_rows") == 0)


def delete_batch(ledger: DataFrame, season: str, match_round: int, expected: int) -> DataFrame:
    """Drop one (season, round) batch only when it has exactly the expected size; otherwise keep all rows."""
    batch = (F.col("season") == season) & (F.col("match_round") == match_round)
    size = ledger.filter(batch).agg(F.count("*")).scalar()
    return ledger.filter(~(F.coalesce(batch, F.lit(False)) & (size == expected)))


def annotate(ledger: DataFrame, audits: DataFrame, ids: str = "prediction_ids") -> DataFrame:
    """Ledger rows joined with the quality notes that list their id."""
    notes = audits.withColumn("prediction_id", F.explode(ids)).drop(ids)
    return ledger.join(notes, "prediction_id")


def count_copies(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of two copies of a ledger."""
    return left.agg(F.count("*").alias("left_rows")).withColumn("right_rows", right.agg(F.count("*")).scalar()).withColumn(
        "equal", F.col("left_rows") == F.col("right_rows")
    )
