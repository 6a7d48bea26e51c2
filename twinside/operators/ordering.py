"""Order, rank and best-of-group operators that never gather a whole key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from twinside.session import settle

#: Repeated values that go to every task.
FEW = 65_536


def rank_rows(df: DataFrame, keys: Sequence[str], lead: str, order: Sequence[str], place: str = "place") -> DataFrame:
    """Place of every row within its key by ``lead`` descending (nulls last), then ``order``.

    ``lead`` is a count with few distinct values, and the first of ``order`` a
    day: the histogram of both gives the place where each block of equal values
    starts, and only a block is ranked in one window.  A value that most rows
    share, or null, is thus spread over its days.
    """
    first, *rest = order
    blocks = df.groupBy(*keys, F.col(lead).alias("_block"), F.col(first).alias("_first")).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_block"), "_first").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        *[F.col(k).alias(f"_{k}") for k in keys], "_block", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, lead, first).orderBy(*(rest or [first])))
    on = F.equal_null(F.col(lead), F.col("_block")) & F.equal_null(F.col(first), F.col("_first"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return df.withColumn("_in", inside).join(starts, on).withColumn(place, F.col("_start") + F.col("_in")).select(*df.columns, place)


def _plain(df: DataFrame, value: Column | str) -> bool:
    """Whether an aggregate buffer can hold the value in place: Spark sorts all rows to aggregate texts and structs."""
    kind = df.select(value).schema.fields[0].dataType
    return isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def ordered_by(df: DataFrame, by: Sequence[Column]) -> Column:
    """One value that orders rows as ``by`` does, null first; a single double stays plain, so that hashing can aggregate it."""
    if len(by) == 1 and isinstance(df.select(by[0]).schema.fields[0].dataType, T.DoubleType):
        return F.coalesce(by[0], F.lit(float("-inf")))
    return F.struct(*by)


def best_per_group(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``by`` of each group, as a maximum that combines on the map side."""
    rest, order = [c for c in df.columns if c not in keys], ordered_by(df, by)
    if _plain(df, order) and all(_plain(df, c) for c in rest):
        # Each maximum sees the same rows in the same order, so all of them take one row.
        return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(*df.columns)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def where_repeated(df: DataFrame, counted: DataFrame, on: Sequence[str], best: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``best`` of the rows whose values of ``on`` occur more than once in ``counted``, and all other rows as they are.

    For rows of which only those can share a group: hashes of the few columns of ``counted`` are moved to be counted, and the rows
    themselves only if they may have to be chosen from. Rows of equal hashes are looked at for nothing.
    """
    marks = counted.groupBy(F.xxhash64(*counted.columns).alias("_mark")).agg(F.count("*").alias("_n"))
    twice = settle(marks.filter("_n > 1").select("_mark"), "repeated")
    n = twice.count()
    if n == 0:
        return df
    if n > FEW:
        return best(df)
    marked, some = df.withColumn("_mark", F.xxhash64(*on)), F.broadcast(twice)
    return marked.join(some, "_mark", "left_anti").drop("_mark").unionByName(best(marked.join(some, "_mark", "left_semi").drop("_mark")))


def best_line(scored: DataFrame, keys: Sequence[str], min_fair: float = 2.0) -> DataFrame:
    """Per side and market the likeliest line whose fair odds reach ``min_fair``; the lower line wins a tie."""
    return best_per_group(scored.filter(F.col("fair_over") >= min_fair), keys, [F.col("p_over"), -F.col("line")])


def lowest_line(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return best_per_group(scored, keys, [-F.col("line")])


def first_window_maximum(values: Column, width: int) -> Column:
    """Zero-based start of the first largest sum of ``width`` neighbours."""
    sums = F.transform(
        F.sequence(F.lit(0), F.size(values) - width),
        lambda i: F.struct(F.aggregate(F.slice(values, i + 1, width), F.lit(0.0), lambda a, x: a + x).alias("s"), (-i).alias("n")),
    )
    return F.when(F.size(values) >= width, -F.array_max(sums)["n"])
