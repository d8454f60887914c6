"""Lasso against coordinate descent by plain loops over all columns."""

import numpy as np
import pytest

from lociframe.operators.lasso import lasso, soft_threshold


def plain(x, y, lam, penalise_intercept, sweeps=20_000):
    """Columns of ones and alleles, one coordinate after the other."""
    full = np.column_stack([np.ones(len(x)), x])
    beta, r = np.zeros(full.shape[1]), y.astype(float).copy()
    for _ in range(sweeps):
        change = 0.0
        for j in range(full.shape[1]):
            z = full[:, j] @ full[:, j]
            if not z:
                continue
            rho = full[:, j] @ r + z * beta[j]
            limit = lam if j or penalise_intercept else 0.0
            new = (rho + limit) / z if rho < -limit else (rho - limit) / z if rho > limit else 0.0
            r -= full[:, j] * (new - beta[j])
            change = max(change, abs(new - beta[j]))
            beta[j] = new
        if change < 1e-13:
            break
    return beta


def frame(spark, x, copies=1):
    rows = [("c1", 10 * j + k, "A", [float(v) for v in x[:, j]]) for j in range(x.shape[1]) for k in range(copies)]
    return spark.createDataFrame(rows, "chr string, pos long, allele string, x array<double>").repartition(5)


def test_soft_threshold():
    rho = np.array([-3.0, -1, 0, 0.5, 2])
    assert soft_threshold(rho, np.full(5, 2.0), 1.0).tolist() == [-1, 0, 0, 0, 0.5]


@pytest.mark.parametrize("penalise_intercept", [True, False])
def test_coefficients_of_40_pools_and_200_alleles(spark, penalise_intercept):
    rng = np.random.default_rng(4)
    x = rng.random((40, 200))
    y = np.column_stack([x[:, [3, 50, 120]] @ [2.0, -3, 1] + 0.1 * rng.normal(size=40), rng.normal(size=40)])
    got = lasso(frame(spark, x), y, [0.3, 1.5], penalise_intercept=penalise_intercept)
    found = {(r.phenotype, getattr(r, "lambda"), r.pos): r.beta for r in got.coefficients.collect()}
    for t in range(2):
        for k, lam in enumerate([0.3, 1.5]):
            beta = plain(x, y[:, t], lam, penalise_intercept)
            mine = np.array([found.get((f"Pheno_{t}", lam, None if j == 0 else 10 * (j - 1)), 0.0) for j in range(201)])
            assert np.abs(mine - beta).max() < 1e-6
            assert np.abs(got.fitted[t, k] - np.column_stack([np.ones(40), x]) @ beta).max() < 1e-6
    assert got.passes < 25


def test_many_equal_columns_and_shares(spark):
    """Five pools and 4,000 alleles of 40 kinds: few passes, and the first of equals is taken."""
    rng = np.random.default_rng(6)
    x = np.round(rng.random((5, 40)), 1)
    y = rng.normal(size=(5, 1)) * 100
    got = lasso(frame(spark, x, copies=100), y, [0.5, 0.1, 0.01], shares=True)
    full = np.column_stack([np.ones(5), x])
    top = np.abs(full.T @ y[:, 0]).max()
    assert np.allclose(got.lambdas[0], [0.5 * top, 0.1 * top, 0.01 * top])
    rows = got.coefficients.collect()
    assert all(r.pos is None or r.pos % 10 == 0 for r in rows)
    for k, lam in enumerate(got.lambdas[0]):
        beta = plain(x, y[:, 0], lam, True)
        loss = lambda f, b, lam=lam: ((y[:, 0] - f) ** 2).sum() / 2 + lam * np.abs(b).sum()
        mine = [r.beta for r in rows if getattr(r, "lambda") == lam]
        assert abs(loss(got.fitted[0, k], mine) / loss(full @ beta, beta) - 1) < 1e-9
    assert got.passes < 25


def test_missing_frequencies_and_empty_tables(spark):
    rows = [("c", 1, "A", [0.1, None, 0.5]), ("c", 2, "A", [None, None, None]), ("c", 3, "T", [float("nan"), 0.2, 0.9])]
    alleles = spark.createDataFrame(rows, "chr string, pos long, allele string, x array<double>")
    y = np.array([[1.0], [2.0], [6.0]])
    x = np.array([[0.1, 0.55], [0.3, 0.2], [0.5, 0.9]])
    got = lasso(alleles, y, [0.05])
    beta = plain(x, y[:, 0], 0.05, True)
    found = {r.pos: r.beta for r in got.coefficients.collect()}
    assert np.allclose([found.get(p, 0.0) for p in (None, 1, 3)], beta, atol=1e-7) and 2 not in found
    none = lasso(alleles.where("false"), y, [0.3], penalise_intercept=False)
    assert [(r.allele, round(r.beta, 9)) for r in none.coefficients.collect()] == [("intercept", 3.0)]
    with pytest.raises(ValueError):
        lasso(alleles, y, [0.0])
