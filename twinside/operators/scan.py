"""Row-prior windows, day-prior states and as-of lookup that stand hot keys.

Row-prior: rows before the current one in (day, tie) order.
Day-prior: everything before the current calendar day.

A plain window puts all rows of a key into one task.  ``prior_features`` does
so only while no key exceeds ``hot_rows`` (by default so many rows as hold
``HOT_CELLS`` values); larger keys are cut into chunks of (day, slice of the
tie), each scanned alone.  What a chunk needs from earlier
chunks is small: running totals, and the last few rows.
Day-prior states hold at most one row per key and day, so a key's size is
bounded by the calendar, not by its events.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinside.session import settle

HOT_CELLS = 32_000_000
BEFORE = (Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Prior:
    """One row-prior feature: ``count``, ``sum`` (0 on the first row) or ``mean`` (of the last ``rows`` rows)."""

    name: str
    kind: str
    column: str | None = None
    rows: int | None = None


def means(prefix: str, columns: Sequence[str], rows: int | None = None, suffix: str = "avg") -> list[Prior]:
    return [Prior(f"{prefix}_{c}_{suffix}", "mean", c, rows) for c in columns]


def row_limit(df: DataFrame) -> int:
    """Rows of this width that one task may hold."""
    return max(1, HOT_CELLS // len(df.columns))


def hot_keys(df: DataFrame, key_sets: Sequence[Sequence[str]], hot_rows: int | None = None) -> list[DataFrame | None]:
    """Per key set the keys above ``hot_rows``, or None when there is none.

    One scan for all key sets, by grouping sets.  At most ``rows / hot_rows``
    keys of a set can be hot, so the list stays small; it is written to give
    the optimizer its real size.
    """
    hot_rows = hot_rows or row_limit(df)
    names = sorted({c for k in key_sets for c in k})
    number = [sum(1 << (len(names) - 1 - j) for j, c in enumerate(names) if c not in k) for k in key_sets]
    counted = df.select(*names).groupingSets([list(k) for k in key_sets], *names).agg(F.count("*").alias("_rows"), F.grouping_id().alias("_set"))
    heavy = settle(counted.filter(F.col("_rows") > hot_rows), "hot-keys")
    found = {r["_set"] for r in heavy.select("_set").distinct().collect()}
    return [heavy.filter(F.col("_set") == i).select(*k) if i in found else None for i, k in zip(number, key_sets)]


def _plain(specs: Sequence[Prior], keys: Sequence[str], day: str, tie: str) -> list[str]:
    """SQL text of row-prior windows over whole keys; texts keep plan building quick for wide lists."""
    part = f"PARTITION BY {', '.join(keys)} ORDER BY {day}, {tie}"

    def one(s: Prior) -> str:
        if s.kind == "count":
            return f"CAST(row_number() OVER ({part}) AS BIGINT) - 1 AS {s.name}"
        reach = "UNBOUNDED" if s.rows is None else s.rows
        over = f"OVER ({part} ROWS BETWEEN {reach} PRECEDING AND 1 PRECEDING)"
        return f"coalesce(sum({s.column}) {over}, 0) AS {s.name}" if s.kind == "sum" else f"avg({s.column}) {over} AS {s.name}"

    return [one(s) for s in specs]


def prior_features(
    df: DataFrame,
    keys: Sequence[str],
    specs: Sequence[Prior],
    day: str = "event_date",
    tie: str = "event_id",
    hot_rows: int | None = None,
    hot: DataFrame | None | str = "measure",
) -> DataFrame:
    """``df`` plus one column per spec.  Keys must not be null and ``tie`` must be a whole number.

    ``hot`` takes a frame of hot keys, None for "no key is hot", or measures.
    """
    hot_rows = hot_rows or row_limit(df)
    if isinstance(hot, str):
        hot = hot_keys(df, [keys], hot_rows)[0]
    plain = lambda rows: rows.selectExpr("*", *_plain(specs, keys, day, tie))
    if hot is None:
        return plain(df)
    cold = plain(df.join(hot, list(keys), "left_anti")).select(*df.columns, *[s.name for s in specs])
    return cold.unionByName(_chunked(df.join(hot, list(keys), "left_semi"), keys, specs, day, tie, hot_rows))


def _chunked(df: DataFrame, keys, specs: Sequence[Prior], day: str, tie: str, hot_rows: int) -> DataFrame:
    columns = sorted({s.column for s in specs if s.column})
    depth = max([s.rows or 0 for s in specs], default=0)
    # Cut by counts, so ids that lie close together are spread too; written, so a recomputed task cuts the same slices.
    sizes = settle(df.groupBy(*keys, day).count(), "day-sizes")
    slices = min(10_000, -(-(sizes.agg(F.max("count")).first()[0] or 1) // hot_rows))
    bounds = F.percentile_approx(tie, [k / slices for k in range(1, slices)], 10 * slices) if slices > 1 else F.array().cast("array<bigint>")
    cut = settle(df.groupBy(*keys, day).agg(bounds.alias("_bounds")), "slices")
    position = F.size(F.filter("_bounds", lambda b: b < F.col(tie)))
    rows = df.join(cut, [*keys, day]).withColumn("_slice", position.cast("bigint")).drop("_bounds")
    chunk = [*keys, day, "_slice"]

    totals = rows.groupBy(*chunk).agg(
        F.count("*").alias("_n"),
        *[F.count(c).alias(f"_n_{c}") for c in columns],
        *[F.sum(c).alias(f"_s_{c}") for c in columns],
    )
    # row_number <= depth is pushed below the shuffle: each task sends `depth` rows per chunk.
    tails = (
        rows.withColumn("_back", F.row_number().over(Window.partitionBy(*chunk).orderBy(F.desc(tie))))
        .filter(F.col("_back") <= max(depth, 1))
        .groupBy(*chunk)
        .agg(F.sort_array(F.collect_list(F.struct(tie, *[c for c in columns if c != tie]))).alias("_tail"))
    )
    w = Window.partitionBy(*keys).orderBy(day, "_slice")
    earlier = F.flatten(F.collect_list("_tail").over(w.rowsBetween(-max(depth, 1), -1)))
    chunks = (
        totals.join(tails, chunk)
        .select(
            *chunk,
            *[
                F.coalesce(F.sum(c).over(w.rowsBetween(*BEFORE)), F.lit(0)).alias(c)
                for c in ["_n", *[f"_{p}_{c}" for c in columns for p in "ns"]]
            ],
            earlier.alias("_carry"),
        )
        .withColumn("_carry", F.slice("_carry", F.greatest(F.size("_carry") - depth + 1, F.lit(1)), max(depth, 1)))
    )
    chunks = settle(chunks, "chunks")
    opening = chunks.drop("_carry").withColumn("_kind", F.lit(0)).withColumn("_ord", F.lit(0).cast("bigint"))
    carried = chunks.select(*chunk, F.posexplode("_carry").alias("_p", "_r")).select(
        *chunk,
        *[F.col(f"_r.{c}").alias(c) for c in columns],
        F.lit(1).alias("_kind"),
        F.col("_p").cast("bigint").alias("_ord"),
    )
    own = rows.withColumns(
        {
            "_kind": F.lit(2),
            "_ord": F.col(tie).cast("bigint"),
            "_n": F.lit(1).cast("bigint"),
            **{f"_n_{c}": F.col(c).isNotNull().cast("bigint") for c in columns},
            **{f"_s_{c}": F.col(c) for c in columns},
        }
    )
    scan = Window.partitionBy(*chunk).orderBy("_kind", "_ord")
    before = scan.rowsBetween(*BEFORE)

    def one(s: Prior) -> Column:
        if s.kind == "count":
            return F.sum("_n").over(before)
        if s.kind == "sum":
            return F.coalesce(F.sum(f"_s_{s.column}").over(before), F.lit(0))
        if s.rows is not None:
            return F.avg(s.column).over(scan.rowsBetween(-s.rows, -1))
        return F.try_divide(F.sum(f"_s_{s.column}").over(before), F.sum(f"_n_{s.column}").over(before))

    merged = own.unionByName(opening, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    return merged.select("*", *[one(s).alias(s.name) for s in specs]).filter("_kind = 2").select(
        *df.columns, *[s.name for s in specs]
    )


def day_states(
    df: DataFrame,
    keys: Sequence[str],
    means_of: Sequence[str] = (),
    last: Sequence[tuple[int, str]] = (),
    count: str | None = None,
    day: str = "event_date",
    tie: str = "event_id",
) -> DataFrame:
    """State after each (key, day): running means ``all_<c>`` and ``last<n>_<c>`` of the latest rows.

    Running totals come from one row per key and day; rolling means need only
    the last few rows of each day, which a limited ranking picks before the
    shuffle.
    """
    by, n = ", ".join(keys), "ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
    sums = "".join(f", sum({c}) AS _s_{c}, count({c}) AS _n_{c}" for c in means_of)
    running = [f"sum(_n) OVER run AS {count}"] if count else []
    running += [f"try_divide(sum(_s_{c}) OVER run, sum(_n_{c}) OVER run) AS all_{c}" for c in means_of]
    states = df.sparkSession.sql(
        f"""SELECT {", ".join([by, day, *running])} FROM (SELECT {by}, {day}, count(*) AS _n{sums} FROM {{df}} GROUP BY {by}, {day}) WINDOW run AS (PARTITION BY {by} ORDER BY {day} {n.format("UNBOUNDED")})""",
        df=df,
    )
    if not last:
        return states
    depth = max(k for k, _ in last)
    read = ", ".join(dict.fromkeys([*keys, day, tie, *[c for _, c in last]]))
    frames = ", ".join(f"w{k} AS (PARTITION BY {by} ORDER BY {day}, {tie} {n.format(k - 1)})" for k in sorted({k for k, _ in last}))
    rolled = ", ".join(f"avg({c}) OVER w{k} AS last{k}_{c}" for k, c in last)
    rolling = df.sparkSession.sql(
        f"""SELECT * EXCEPT (_back) FROM (
          SELECT {by}, {day}, _back, {rolled} FROM (
            SELECT * FROM (SELECT {read}, row_number() OVER (PARTITION BY {by}, {day} ORDER BY {tie} DESC) AS _back FROM {{df}}) WHERE _back <= {depth})
          WINDOW {frames}) WHERE _back = 1""",
        df=df,
    )
    if not running:
        return rolling
    return states.join(rolling, [*keys, day])


def asof(probe: DataFrame, states: DataFrame, keys: Sequence[str], probe_day: str, day: str = "event_date") -> DataFrame:
    """Left join each probe row to the latest state strictly before its day.

    Probe rows are reduced to distinct (key, day) first, so a key asked for by
    very many rows costs no more than its calendar; the rows come back by an
    equi join, which adaptive execution can split.  Probe keys may be null:
    those rows get null states.
    """
    values = [c for c in states.columns if c not in (*keys, day)]
    by, known = ", ".join(keys), " AND ".join(f"{k} IS NOT NULL" for k in (*keys, probe_day))
    # Asked days carry no state, and states of the same day are outside the frame.
    found = probe.sparkSession.sql(
        f"""SELECT {by}, _day AS {probe_day}, {", ".join(f"_found.{v} AS {v}" for v in values)} FROM (
          SELECT {by}, _day, _asked, last_value(_state) IGNORE NULLS OVER (
            PARTITION BY {by} ORDER BY unix_date(_day) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _found FROM (
              SELECT {by}, {day} AS _day, struct({", ".join(values)}) AS _state, false AS _asked FROM {{states}}
              UNION ALL SELECT DISTINCT {by}, {probe_day}, NULL, true FROM {{probe}} WHERE {known}))
        WHERE _asked""",
        states=states,
        probe=probe,
    )
    return probe.join(found, [*keys, probe_day], "left")
