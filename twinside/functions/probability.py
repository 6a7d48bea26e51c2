"""Count distributions as pure column expressions.

``alpha`` is the extra dispersion of a negative binomial with variance
``mu + alpha * mu**2``; a null or zero ``alpha`` means Poisson.  Lambdas over
arrays evaluate their expressions at every step, so the constants of a
distribution are bound once as a ``family`` struct.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, functions as F, types as T

from twinside.functions import tails

FLOOR = 0.05
TAIL = 0.999999


def log_gamma(x: Column) -> Column:
    """Log gamma for positive ``x``: shift by eight, then the Stirling series."""
    y = x + 8.0
    shift = x
    for i in range(1, 8):
        shift = shift * (x + float(i))
    inv = 1.0 / y
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(shift)


def mean_of(mu: Column, floor: float = FLOOR) -> Column:
    return F.when(mu.isNotNull(), F.greatest(mu.cast("double"), F.lit(floor)))


def total_alpha(mu_a: Column, mu_b: Column, alpha: Column) -> Column:
    """Dispersion of the sum of two independent counts by matching mean and variance."""
    mu = mu_a + mu_b
    var = mu_a + alpha * mu_a * mu_a + mu_b + alpha * mu_b * mu_b
    return F.when((alpha > 0) & (var > mu), (var - mu) / (mu * mu))


def family(mu: Column, alpha: Column, floor: float = FLOOR) -> Column:
    """Struct of all constants of one distribution, to be stored as a column and used many times.

    Both families obey ``pmf(k) / pmf(k - 1) = a + b / k``.
    """
    return bind(F.struct(mean_of(mu, floor).alias("mu"), F.when(alpha > 0, alpha).alias("alpha")), _constants)


def _constants(z: Column) -> Column:
    m, alpha = z["mu"], z["alpha"]
    nb = alpha.isNotNull()
    size = 1.0 / alpha
    q = alpha * m / (1.0 + alpha * m)
    return F.struct(
        m.alias("mu"),
        alpha.alias("alpha"),
        F.when(nb, q).otherwise(0.0).alias("a"),
        F.when(nb, (size - 1.0) * q).otherwise(m).alias("b"),
        size.alias("size"),
        F.when(nb, F.ln(q)).otherwise(F.ln(m)).alias("log_ratio"),
        F.when(nb, -size * F.log1p(alpha * m) - log_gamma(size)).otherwise(-m).alias("log_start"),
        # How far above the mean terms still count in double precision.
        F.ceil(9.0 * F.sqrt(m + F.coalesce(alpha, F.lit(0.0)) * m * m) + 40.0 * (F.coalesce(alpha * m, F.lit(0.0)) + 1.0)).cast("int").alias("reach"),
    )


def log_pmf(k: Column, f: Column) -> Column:
    k = k.cast("double")
    shape = F.when(f["size"].isNotNull(), log_gamma(k + f["size"])).otherwise(0.0)
    return f["log_start"] + k * f["log_ratio"] + shape - log_gamma(k + 1.0)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A one-element array names it: the optimizer would otherwise paste the whole
    expression into every use.
    """
    return F.transform(F.array(value), body)[0]


@F.pandas_udf(T.DoubleType())
def _over(mu: pd.Series, alpha: pd.Series, line: pd.Series) -> pd.Series:
    return pd.Series(tails.over(*(c.to_numpy(dtype="float64", na_value=float("nan")) for c in (mu, alpha, line))))


def over_of(mu: Column, alpha: Column, line: Column) -> Column:
    """P(X > floor(line)) of a count with mean ``mu`` and extra dispersion ``alpha``.

    Incomplete gamma and beta functions over Arrow batches: the work for a line
    does not grow with the mean, and a small probability keeps its digits. As
    column expressions they would be loops that run interpreted, row by row.
    """
    return _over(mean_of(mu), alpha.cast("double"), line.cast("double"))


def over_probability(f: Column, line: Column) -> Column:
    """P(X > floor(line)) of a ``family``."""
    return _over(f["mu"], f["alpha"], line.cast("double"))


def fair_odds(p: Column) -> Column:
    return F.when(p > 0, 1.0 / p).otherwise(F.when(p.isNotNull(), F.lit(float("inf"))))


def total_lines(mu: Column, reach: int = 8) -> Column:
    """Half-lines around an expected total: ``reach`` below and above its whole part."""
    center = F.floor(mu).cast("int")
    low = F.greatest(F.lit(0), center - reach)
    return F.transform(F.sequence(low, center + reach), lambda x: x.cast("double") + 0.5)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _terms(first: pa.Array, a: pa.Array, b: pa.Array, last: pa.Array) -> pa.Array:
    constants = [c.to_numpy(zero_copy_only=False).astype("float64") for c in (first, a, b, last)]
    values, ends = tails.terms(*constants, least=25, tail=TAIL)
    mask = pa.array(np.isnan(constants[0]) | np.isnan(constants[3]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=mask)


def pmf_values(f: Column) -> Column:
    """Probabilities of 0..hi with ``hi`` the larger of 25 and the 0.999999 quantile.

    For Arrow batches at a time: as a column expression every row would run an
    interpreted loop that copies what it has at each step.
    """
    return _terms(log_pmf(F.lit(0), f), f["a"], f["b"], F.ceil(f["mu"]).cast("int") + f["reach"])


_MOMENTS = T.StructType([T.StructField("support", T.IntegerType()), T.StructField("mass", T.DoubleType()), T.StructField("mean", T.DoubleType())])


@F.arrow_udf(_MOMENTS)
def moments(p: pa.Array) -> pa.Array:
    """Struct(support, mass, mean) of the probabilities of 0, 1 and so on; nulls where there are none."""
    size = pa.compute.fill_null(pa.compute.list_value_length(p), 0).to_numpy(zero_copy_only=False).astype("int64")
    x, ends = p.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
    k = np.arange(len(x)) - np.repeat(ends[:-1], size)
    none, rows = p.is_null().to_numpy(zero_copy_only=False), np.flatnonzero(size)
    sums = np.zeros((2, len(size)))
    if len(rows):
        sums[:, rows] = np.add.reduceat(np.stack([x, x * k]), ends[rows], axis=1)
    return pa.StructArray.from_arrays(
        [pa.array(size, pa.int32(), mask=none), *[pa.array(s, mask=none) for s in sums]], fields=[pa.field("support", pa.int32()), pa.field("mass", pa.float64()), pa.field("mean", pa.float64())]
    )


_RANGE = T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()), T.StructField("probability", T.DoubleType())])


@F.pandas_udf(_RANGE)
def _likeliest(mu: pd.Series, alpha: pd.Series, width: pd.Series) -> pd.DataFrame:
    found = tails.likeliest_range(*(c.to_numpy(dtype="float64", na_value=float("nan")) for c in (mu, alpha, width)))
    whole = lambda x: pd.Series(x).round().astype("Int64")
    return pd.DataFrame({"low": whole(found[0]), "high": whole(found[1]), "probability": found[2]})


def best_range(f: Column, width: Column) -> Column:
    """Struct(low, high, probability) of the likeliest window of ``width`` whole numbers, the first of the heaviest; nulls without a mean or width.

    Both families have one peak, so the best window holds the mode: only the
    windows around it are evaluated, whatever the mean, for Arrow batches at a
    time. As column expressions they would be loops that run interpreted.
    """
    return _likeliest(f["mu"], f["alpha"], width.cast("double"))
