"""Distribution functions in numpy, elementwise over arrays."""

from __future__ import annotations

from math import lgamma

import numpy as np

_TINY = 1e-300
_lgamma = np.vectorize(lgamma, otypes=[float])


def log_gamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(x)


def _log_gamma_fast(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument beyond 8; for positive arguments."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - shift


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the beta function for shapes above 0 and of moderate size, by Stirling's series 8 beyond them."""
    total, shift = 0.0, 1.0
    for x, sign in ((a, 1), (b, 1), (a + b, -1)):
        y, rising = x + 8, x.copy()
        for i in range(1, 8):
            rising *= x + i
        z = 1 / (y * y)
        series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * (691 / 360360 - z / 156)))))) / y
        total = total + sign * ((y - 0.5) * np.log(y) - y + 0.9189385332046727 + series)
        shift = shift * rising if sign > 0 else shift / rising
    return total - np.log(shift)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b), by its continued fraction."""
    a, b, x = (np.asarray(v, float).copy() for v in np.broadcast_arrays(a, b, x))
    shape = x.shape
    a, b, x = a.ravel(), b.ravel(), x.ravel()
    out = np.where(x >= 1, 1.0, 0.0)
    out[np.isnan(a) | np.isnan(b) | np.isnan(x)] = np.nan
    live = np.flatnonzero((x > 0) & (x < 1))
    if not len(live):
        return out.reshape(shape)
    p, q, t = a[live], b[live], x[live]
    swap = t > (p + 1) / (p + q + 2)
    p, q, t = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - t, t)
    front = np.exp(_log_gamma_fast(p + q) - _log_gamma_fast(p) - _log_gamma_fast(q) + p * np.log(t) + q * np.log1p(-t)) / p
    c, d = np.ones_like(t), 1 - (p + q) * t / (p + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, rounds):
        for numerator in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    value = front * h
    out[live] = np.where(swap, 1 - value, value)
    return out.reshape(shape)


def gamma_upper(a: np.ndarray, x: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x)."""
    a, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, x))
    out = np.ones(x.shape)
    front = np.exp(np.where(x > 0, -x + a * np.log(np.where(x > 0, x, 1)), 0) - log_gamma(a))
    low = (x > 0) & (x < a + 1)
    if low.any():
        p, t = a[low], x[low]
        term = 1 / p
        total, n = term.copy(), p.copy()
        for _ in range(rounds):
            n = n + 1
            term = term * t / n
            total = total + term
            if np.all(np.abs(term) < np.abs(total) * 1e-16):
                break
        out[low] = 1 - front[low] * total
    high = x >= a + 1
    if high.any():
        p, t = a[high], x[high]
        b = t + 1 - p
        c, d = np.full_like(t, 1 / _TINY), 1 / b
        h = d.copy()
        for i in range(1, rounds):
            an = -i * (i - p)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        out[high] = front[high] * h
    return np.where(np.isnan(x), np.nan, out)


def t_two_sided(t: np.ndarray, df: np.ndarray | float) -> np.ndarray:
    """2 (1 - CDF(|t|)) of Student's t."""
    t = np.asarray(t, float)
    df = np.broadcast_to(np.asarray(df, float), t.shape)
    finite = np.where(np.isfinite(t), t, 0)
    p = beta_inc(df / 2, np.full(t.shape, 0.5), df / (df + finite * finite))
    return np.where(np.isnan(t), np.nan, np.where(np.isinf(t), 0.0, p))


def chi2_upper(x: np.ndarray, df: np.ndarray | float) -> np.ndarray:
    """1 - CDF of chi-square."""
    x = np.asarray(x, float)
    return gamma_upper(np.broadcast_to(np.asarray(df, float), x.shape) / 2, x / 2)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return beta_inc(a, b, np.clip(x, 0, 1))


class BetaCdf:
    """Beta CDF at places that stay, ``x`` (rows, places), for shapes of each row that change; both shapes are 10 at most.

    Logarithms of the places are taken once and those of the beta function once a row. The
    continued fraction is computed from its last level to its first. For such shapes it has
    settled to the last digits of a double after as many levels as ``LEVELS`` has for places
    up to each of ``UP_TO``.
    """

    UP_TO, LEVELS, BLOCK = (0.2, 0.4, 0.6, 0.8, 1.0), (9, 11, 14, 21, 40), 4096

    def __init__(self, x: np.ndarray) -> None:
        self.at_ends = np.where(np.isnan(x), np.nan, np.where(x >= 1, 1.0, 0.0))
        self.inside = (x > 0) & (x < 1)
        self.x = np.where(self.inside, x, 0.5)
        self.log, self.log_rest = np.log(self.x), np.log1p(-self.x)

    def __call__(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """CDF at the places of ``rows``, which have the shapes ``a`` and ``b``."""
        out = self.at_ends[rows]
        out[np.isnan(a) | np.isnan(b)] = np.nan
        own, place = np.nonzero(self.inside[rows])
        at, p, q = rows[own], a[own], b[own]
        t = self.x[at, place]
        front = np.exp(p * self.log[at, place] + q * self.log_rest[at, place] - _log_beta(a, b)[own])
        swap = t > (p + 1) / (p + q + 2)
        p, q, t = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - t, t)
        low = -np.inf
        for high, levels in zip(self.UP_TO, self.LEVELS, strict=True):
            these = np.flatnonzero((t > low) & (t <= high))
            for i in range(0, len(these), self.BLOCK):
                k = these[i : i + self.BLOCK]
                front[k] /= self._fraction(p[k], q[k], t[k], levels)
            low = high
        out[own, place] = np.where(swap, 1 - front, front)
        return out

    @staticmethod
    def _fraction(p: np.ndarray, q: np.ndarray, t: np.ndarray, levels: int) -> np.ndarray:
        total, two = p + q, 2 - t
        base = p + 1 - total * t
        f = np.full_like(t, np.inf)  # below the last level is nothing
        part, r, link, near, u = (np.empty_like(t) for _ in range(5))
        below = np.zeros_like(t)  # numerator of the level below
        np.divide(1.0, np.add(p, 2 * levels + 1, out=r), out=r)
        for m in range(levels, -1, -1):
            # this level's own term: m + m (q - m) t / (p + 2 m - 1) + (p + m) (base + m (2 - t)) / (p + 2 m + 1)
            np.multiply(two, m, out=part)
            np.add(part, base, out=part)
            np.multiply(part, np.add(p, m, out=u), out=part)
            np.multiply(part, r, out=part)
            if m:
                np.divide(1.0, np.add(p, 2 * m - 1, out=r), out=r)
                np.multiply(t, r, out=near)
                np.multiply(np.subtract(q, m, out=link), near, out=link)
                np.multiply(link, m, out=link)
                np.add(part, link, out=part)
                np.add(part, m, out=part)
            np.add(part, np.divide(below, f, out=f), out=f)
            if m:  # its numerator: (p + m - 1) (p + q + m - 1) m (q - m) t ** 2 / (p + 2 m - 1) ** 2
                np.multiply(link, near, out=below)
                np.multiply(below, np.add(p, m - 1, out=u), out=below)
                np.multiply(below, np.add(total, m - 1, out=u), out=below)
        return f


def normal_cdf(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    x, mean, sd = (np.asarray(v, float) for v in np.broadcast_arrays(x, mean, sd))
    z = (x - mean) / np.where(sd > 0, sd, np.finfo(float).eps)
    tail = 0.5 * gamma_upper(np.full(z.shape, 0.5), z * z / 2)
    return np.where(z > 0, 1 - tail, tail)
