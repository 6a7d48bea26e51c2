"""Upper tails of counts by the regularised incomplete gamma and beta functions.

P(X > k) of a Poisson count with mean m is the lower incomplete gamma function
P(k + 1, m), that of a negative binomial of size r and success share q is the
incomplete beta function I_q(k + 1, r). Power series on one side of the mean and
continued fractions on the other take a number of steps that grows with the
square root of the mean at most, for whole columns at a time.
"""

from __future__ import annotations

import math

import numpy as np

#: Steps after which a sum or fraction is taken as it is; a mean of a million needs some 5,000.
STEPS = 20_000
TINY, CLOSE = 1e-300, 1e-16


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for positive values: shift by ten, then the Stirling series."""
    shift = np.log(x)
    for i in range(1, 10):
        shift = shift + np.log(x + i)
    y = x + 10.0
    inv = 1.0 / y
    square = inv * inv
    series = inv * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square * (1 / 1188 - square * 691 / 360360)))))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _until_still(step, *state: np.ndarray) -> None:
    """Run ``step(rows, n)`` on the rows that still move; it returns which of them do."""
    rows = np.arange(len(state[0]))
    for n in range(1, STEPS + 1):
        if not len(rows):
            return
        rows = rows[step(rows, n)]


def _gamma_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x) for x below a + 1."""
    term, total = np.ones_like(a), np.ones_like(a)

    def step(rows, n):
        term[rows] *= x[rows] / (a[rows] + n)
        total[rows] += term[rows]
        return term[rows] > total[rows] * CLOSE

    _until_still(step, a)
    return np.exp(a * np.log(x) - x - log_gamma(a + 1.0)) * total


def _fraction(first: np.ndarray, numerator, denominator) -> np.ndarray:
    """first + n1 / (d1 + n2 / (d2 + ...)) by the method of Lentz."""
    f = np.where(np.abs(first) < TINY, TINY, first)
    c, d = f.copy(), np.zeros_like(f)

    def step(rows, n):
        above, below = numerator(rows, n), denominator(rows, n)
        d[rows] = below + above * d[rows]
        d[rows] = 1.0 / np.where(np.abs(d[rows]) < TINY, TINY, d[rows])
        c[rows] = below + above / c[rows]
        c[rows] = np.where(np.abs(c[rows]) < TINY, TINY, c[rows])
        change = c[rows] * d[rows]
        f[rows] *= change
        return np.abs(change - 1.0) > CLOSE

    _until_still(step, f)
    return f


def _gamma_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 - P(a, x) for x from a + 1 on."""
    f = _fraction(x + 1.0 - a, lambda r, n: -n * (n - a[r]), lambda r, n: x[r] + 2.0 * n + 1.0 - a[r])
    return np.exp(a * np.log(x) - x - log_gamma(a)) / f


def lower_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function of positive values."""
    out, low = np.empty_like(x), x < a + 1.0
    out[low] = _gamma_series(a[low], x[low])
    out[~low] = 1.0 - _gamma_fraction(a[~low], x[~low])
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, log_x: np.ndarray, log_rest: np.ndarray) -> np.ndarray:
    """I_x(a, b) for x up to (a + 1) / (a + b + 2)."""

    def numerator(r, n):
        m = n // 2
        if n % 2:
            return -(a[r] + m) * (a[r] + b[r] + m) * x[r] / ((a[r] + 2 * m) * (a[r] + 2 * m + 1))
        return m * (b[r] - m) * x[r] / ((a[r] + 2 * m - 1) * (a[r] + 2 * m))

    f = _fraction(np.ones_like(x), numerator, lambda r, n: 1.0)
    front = log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * log_x + b * log_rest
    return np.exp(front) / (a * f)


def lower_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b); ``rest`` is 1 - x, given apart to keep its digits."""
    out, low = np.empty_like(x), x <= (a + 1.0) / (a + b + 2.0)
    out[low] = _beta_fraction(a[low], b[low], x[low], np.log(x[low]), np.log(rest[low]))
    high = ~low
    out[high] = 1.0 - _beta_fraction(b[high], a[high], rest[high], np.log(rest[high]), np.log(x[high]))
    return out


def over(mu: np.ndarray, alpha: np.ndarray, line: np.ndarray) -> np.ndarray:
    """P(X > floor(line)); NaN where the mean or the line is, 1 below zero. ``alpha`` NaN or 0 is a Poisson count."""
    out = np.full(len(mu), np.nan)
    k = np.floor(line)
    known = ~(np.isnan(mu) | np.isnan(k))
    out[known & (k < 0)] = 1.0
    plain = known & (k >= 0) & ~(alpha > 0)
    out[plain] = lower_gamma(k[plain] + 1.0, mu[plain])
    wide = known & (k >= 0) & (alpha > 0)
    spread = 1.0 + alpha[wide] * mu[wide]
    out[wide] = lower_beta(k[wide] + 1.0, 1.0 / alpha[wide], alpha[wide] * mu[wide] / spread, 1.0 / spread)
    return np.clip(out, 0.0, 1.0)


def likeliest_range(mu: np.ndarray, alpha: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, probability) of the heaviest window of ``width`` whole numbers around the mode; NaN where mean or width is missing.

    ``alpha`` NaN or zero means Poisson, else a negative binomial of that dispersion.
    """
    low, high, best = (np.full(len(mu), np.nan) for _ in range(3))
    for w in np.unique(width[~np.isnan(width)]).astype(int):
        rows = np.flatnonzero((width == w) & ~np.isnan(mu))
        m, spread = mu[rows], np.where(alpha[rows] > 0, alpha[rows], np.nan)
        mode = np.floor(m * np.maximum(0.0, 1.0 - np.nan_to_num(spread)))
        first = np.maximum(0.0, mode - w - 1)
        terms = np.stack([_mass(first + j, m, spread) for j in range(2 * w + 3)])
        heaviest, start = np.full(len(rows), -1.0), np.zeros(len(rows))
        for i in range(w + 3):
            mass = terms[i : i + w].sum(axis=0)
            # A window near zero may not pass the last number looked at.
            better = (first + i + w - 1 <= mode + w + 1) & (mass > heaviest)
            heaviest, start = np.where(better, mass, heaviest), np.where(better, first + i, start)
        low[rows], high[rows], best[rows] = start, start + w - 1, heaviest
    return low, high, best


def _mass(k: np.ndarray, mu: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Probability of ``k``; ``alpha`` NaN means Poisson."""
    poisson = np.isnan(alpha)
    a = np.where(poisson, 1.0, alpha)
    size, mean = 1.0 / a, a * mu
    log_nb = k * np.log(mean / (1.0 + mean)) - size * np.log1p(mean) + log_gamma(k + size) - log_gamma(size)
    return np.exp(np.where(poisson, k * np.log(mu) - mu, log_nb) - log_gamma(k + 1.0))


#: Values that are worked on together.
CELLS = 1 << 20


def terms(first: np.ndarray, a: np.ndarray, b: np.ndarray, last: np.ndarray, least: int, tail: float) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of 0..hi of each row, one row after the other, and where the rows begin and end.

    ``first`` is the logarithm of the probability of 0, and ``a + b / k`` what leads from k - 1 to k. ``hi`` is the larger of ``least``
    and the numbers whose cumulative probability lies below ``tail``, ``last`` at most. Rows of NaN have no values.
    """
    known = np.flatnonzero(~(np.isnan(first) | np.isnan(last)))
    order = known[np.argsort(last[known], kind="stable")]
    length, found, at = np.zeros(len(first), np.int64), [], 0
    while at < len(order):
        # The rows of a block end close together; one row may pass the limit.
        size = np.arange(1, len(order) - at + 1) * (last[order[at:]] + 1.0)
        rows = order[at : at + max(1, int(np.searchsorted(size, CELLS, side="right")))]
        at += len(rows)
        k = np.arange(1.0, last[rows[-1]] + 1.0)
        logs = np.empty((len(rows), len(k) + 1))
        logs[:, 0] = first[rows]
        np.log(a[rows, None] + b[rows, None] / k, out=logs[:, 1:])
        p = np.exp(np.cumsum(logs, axis=1, out=logs), out=logs)
        inside = np.arange(p.shape[1]) <= last[rows, None]
        below = ((np.cumsum(p, axis=1) < tail) & inside).sum(axis=1)
        length[rows] = np.minimum(np.maximum(least, below), last[rows].astype(np.int64)) + 1
        found.append((rows, p[np.arange(p.shape[1]) < length[rows, None]]))
    ends = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(ends[-1])
    for rows, values in found:
        own = length[rows]
        out[np.arange(len(values)) + np.repeat(ends[rows] - (np.cumsum(own) - own), own)] = values
    return out, ends
