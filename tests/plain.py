"""Plain versions by numpy of what the library computes as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lociframe.functions import dist
from lociframe.model import EPSILON


@dataclass(frozen=True)
class Fit:
    """Coefficients, statistics and p values, each (designs, columns, traits); ``singular`` designs have NaN."""

    beta: np.ndarray
    t: np.ndarray
    p: np.ndarray
    singular: np.ndarray


def least_squares(x: np.ndarray, y: np.ndarray, likelihood: bool = False, compat: bool = True, ridge: float = 0.0) -> Fit:
    """Fit designs (m, n, p) to traits (n, k) or (m, n, k) at once.

    The test has n - 1 degrees of freedom. With ``likelihood`` the error variance is 2 SSE / n
    and, where ``compat``, the statistic is the coefficient over its variance, not its root:
    the values an optimiser finds for that objective in closed form. ``ridge`` is added to the
    diagonal but for the intercept. With fewer pools than columns the coefficients are the shortest
    that fit exactly, and every p value is 1.
    """
    m, n, p = x.shape
    y = np.broadcast_to(y, (m, *y.shape[-2:]))
    xt = x.transpose(0, 2, 1)
    few = n < p and not ridge  # fewer pools than columns: the shortest of the exact solutions, X'(XX')^-1 y
    product = x @ xt if few else xt @ x
    if ridge:
        product = product + ridge * np.diag([0.0] + [1.0] * (p - 1))
    with np.errstate(all="ignore"):
        singular = np.linalg.cond(product) > 1e12
        inverse = np.linalg.inv(np.where(singular[:, None, None], np.eye(len(product[0])), product))
        beta = xt @ (inverse @ y) if few else inverse @ (xt @ y)
        sse = ((y - x @ beta) ** 2).sum(axis=1)
        # nothing is left for an error where a line goes through all pools: the test says 1
        error = np.full_like(sse, np.nan) if n <= p and not (likelihood and not few) else 2 * sse / n if likelihood else sse / (n - p)
        spread = xt @ inverse @ inverse @ x if few else inverse
        variance = np.einsum("mii->mi", spread)[:, :, None] * error[:, None, :]
        t = np.where(np.abs(beta) <= EPSILON, 0, beta / (variance if likelihood and compat else np.sqrt(variance)))
        pvalue = dist.t_two_sided(t, n - 1)
    pvalue = np.where(np.isnan(pvalue), 1.0, pvalue)
    for a in (beta, t, pvalue):
        a[singular] = np.nan
    return Fit(beta, t, pvalue, singular)


def collinear(x: np.ndarray, limit: float = 0.99) -> np.ndarray:
    """Which columns (designs, columns) go, as an earlier one that stays has |r| of ``limit`` or more with them; never the intercept."""
    centred = x - x.mean(axis=1, keepdims=True)
    scale = np.sqrt((centred * centred).sum(axis=1))
    with np.errstate(all="ignore"):
        r = np.nan_to_num(np.einsum("mni,mnj->mij", centred, centred) / (scale[:, :, None] * scale[:, None, :]))
    near = (np.floor(np.abs(r) * 1e7 + 0.5) / 1e7 >= limit) & (scale[:, :, None] * scale[:, None, :] > EPSILON)
    gone = np.zeros((len(x), x.shape[2]), bool)
    for j in range(2, x.shape[2]):
        gone[:, j] = (near[:, 1:j, j] & ~gone[:, 1:j]).any(axis=1)
    return gone
