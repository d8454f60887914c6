import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from lociframe.functions.arrays import frequencies
from lociframe.model import LOCI_SCHEMA
from lociframe.operators import association as asc
from lociframe.operators import filters as fl
from lociframe.operators import gwalpha as gw


def test_pearson_golden():
    r, p = asc.pearson(np.array([[0.1, 0.2, 0.3, 0.4, 0.5]]), np.array([2, 1, 1, 5, 2.0]))
    assert r[0] == 0.3849002 and abs(p[0] - 0.5223146158470686) < 1e-7


def test_gwalpha_goldens():
    counts = np.array([[5, 2, 6], [2, 2, 7], [3, 2, 5], [4, 3, 3], [5, 5, 0]], float)
    freqs = (counts / counts.sum(axis=1, keepdims=True)).T
    z = gw.Quantiles(np.full(5, 0.2), np.array([0, 0.1, 0.4, 0.7, 0.9]), 0.02, 0.0, 0.9)
    assert np.allclose(gw.effects(freqs, z, "LS")[:2], [5.816067, 9.176892], atol=5e-6)
    assert np.allclose(gw.effects(freqs, z, "ML")[:2], [-3.293261, -7.09898], atol=5e-6)


def fits(spark, x, y, **how):
    """Coefficients and p values, designs by columns by traits; not a number for singular designs."""
    frame = spark.createDataFrame([(i, d.T.tolist()) for i, d in enumerate(x)], "i int, columns array<array<double>>").repartition(3)
    beta, p = np.full((2, len(x), x.shape[2], y.shape[1]), np.nan)
    for r in asc.fitted(frame, y, **how).collect():
        beta[r.i], p[r.i] = ([[f[v] for f in column] for column in r.fits] for v in ("statistic", "pvalue"))
    return beta, p


@pytest.mark.parametrize("pools", [3, 4, 5, 9, 30])
@pytest.mark.parametrize("how", [{}, {"likelihood": True}, {"likelihood": True, "compat": False}, {"ridge": 0.7}])
def test_fits_are_those_of_numpy(spark, pools, how):
    """With more and fewer pools than columns, as many, and singular designs."""
    rng = np.random.default_rng(pools)
    x = np.concatenate([np.ones((24, pools, 1)), rng.random((24, pools, 3))], axis=2)
    x[3, :, 2] = x[3, :, 1]
    x[7, :, 3] = 0.5
    y = np.column_stack([rng.normal(size=pools), x[0, :, 1] * 3 + 1])
    want, (beta, p) = plain.least_squares(x, y, **how), fits(spark, x, y, **how)
    assert np.array_equal(np.isnan(beta), np.isnan(want.beta))
    live = ~want.singular
    assert np.allclose(beta[live], want.beta[live], rtol=1e-6, atol=1e-7)
    if pools != 4 or not how.get("likelihood"):  # else what is left for an error is rounding
        real = np.abs(want.beta[live]) > 1e-9
        assert np.allclose(p[live][:, :, 0], want.p[live][:, :, 0], atol=1e-7)
        assert real.any()


def test_places_of_columns_that_stay(spark):
    rng = np.random.default_rng(17)
    x = np.concatenate([np.ones((90, 7, 1)), rng.normal(size=(90, 7, 4))], axis=2)
    for i in range(90):
        a, b = rng.integers(1, 5, 2)
        x[i, :, a] = x[i, :, b] * rng.choice([-2.0, 1.0]) + 0.1 * (i % 2) * rng.normal(size=7)
    frame = spark.createDataFrame([(i, d.T[1:].tolist()) for i, d in enumerate(x)], "i int, columns array<array<double>>")
    gone = plain.collinear(x)
    for r in frame.select("i", asc.not_collinear(F.col("columns"), 7).alias("at")).collect():
        assert r.at == np.flatnonzero(~gone[r.i][1:]).tolist()


def test_least_squares_is_numpys():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((20, 12, 1)), rng.normal(size=(20, 12, 2))], axis=2)
    y = rng.normal(size=(12, 2))
    fit = plain.least_squares(x, y)
    for i in range(20):
        assert np.allclose(fit.beta[i], np.linalg.lstsq(x[i], y, rcond=None)[0])
    assert not fit.singular.any()
    x[3, :, 2] = x[3, :, 1]
    assert plain.least_squares(x, y).singular.nonzero()[0].tolist() == [3]


def scan_loci(spark):
    rng = np.random.default_rng(2)
    rows = [("c", i, "A", ["A", "T", "C"], rng.integers(1, 30, (6, 3)).tolist()) for i in range(30)]
    return spark.createDataFrame(rows, LOCI_SCHEMA).withColumn("freqs", frequencies(F.col("counts"))), rows


def test_scan_matches_numpy(spark):
    loci, rows = scan_loci(spark)
    y = np.random.default_rng(3).normal(size=(6, 1))
    phen = asc.Phenotypes(tuple("abcdef"), np.full(6, 20.0), y)
    got = {(r.pos, r.alleles): r.statistic for r in asc.regression_scan(loci, phen).collect()}
    for _, pos, _, alleles, counts in rows:
        f = np.array(counts) / np.array(counts).sum(axis=1, keepdims=True)
        order = sorted(range(3), key=lambda j: (-round(f[:, j].sum(), 9), j))[1:]
        beta = np.linalg.lstsq(np.column_stack([np.ones(6), f[:, order]]), y, rcond=None)[0][:, 0]
        for j, b in zip(order, beta[1:], strict=True):
            assert abs(got[pos, alleles[j]] - b) < 1e-6 * max(1, abs(b))


def test_gram_does_not_depend_on_partitions(spark):
    loci, rows = scan_loci(spark)
    alleles = fl.allele_rows(loci)
    a, n = asc.gram(alleles.repartition(1), 6)
    b, m = asc.gram(alleles.repartition(7), 6)
    assert n == m == 90 and np.allclose(a, b)
    x = np.array([r.x for r in alleles.collect()])
    assert np.allclose(a, x.T @ x)


def test_components_explain_what_is_asked():
    k = np.diag([5.0, 3.0, 1.0, 1.0])
    assert asc.principal_components(k, 0.75).shape[1] == 2
    assert asc.principal_components(k, 0.75, compat=True).shape[1] == 1


def test_pools_without_a_phenotype():
    phen = asc.Phenotypes(("a", "b"), np.array([1.0, 1.0]), np.array([[1.0], [np.nan]]))
    assert phen.complete.tolist() == [0]
    with pytest.raises(ValueError):
        _ = asc.Phenotypes(("a",), np.array([1.0]), np.array([[np.nan]])).complete


def test_fewer_pools_than_columns():
    """Three pools and an intercept with three alleles: the shortest exact solution, nothing to test."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.ones((9, 3, 1)), rng.normal(size=(9, 3, 3))], axis=2)
    y = rng.normal(size=(3, 2))
    fit = plain.least_squares(x, y)
    assert not fit.singular.any() and (fit.p == 1).all()
    for i in range(9):
        assert np.allclose(fit.beta[i], np.linalg.pinv(x[i]) @ y)


def test_collinear_columns_are_those_of_a_loop():
    rng = np.random.default_rng(7)
    x = np.concatenate([np.ones((200, 7, 1)), rng.normal(size=(200, 7, 4))], axis=2)
    for i in range(200):
        if i % 3:
            a, b = rng.integers(1, 5, 2)
            x[i, :, a] = x[i, :, b] * rng.choice([-2.0, 1.0]) + 0.1 * (i % 2) * rng.normal(size=7)
        if i % 5 == 0:
            x[i, :, 2] = 0.25
    gone = plain.collinear(x)
    for i in range(200):
        keep = [0]
        for j in range(1, 5):
            r = [abs(np.nan_to_num(asc.pearson(x[None, i, :, k], x[i, :, j])[0][0])) for k in keep if k]
            if not any(v >= 0.99 for v in r):
                keep.append(j)
        assert np.flatnonzero(~gone[i]).tolist() == keep


def test_likelihood_scan_equals_locus_by_locus(spark):
    loci, rows = scan_loci(spark)
    y = np.random.default_rng(9).normal(size=(6, 2))
    phen = asc.Phenotypes(tuple("abcdef"), np.full(6, 20.0), y)
    got = {(r.pos, r.alleles, r.phenotype): (r.statistic, r.pvalue) for r in asc.regression_scan(loci, phen, likelihood=True).collect()}
    n = 0
    for _, pos, _, alleles, counts in rows:
        f = np.array(counts) / np.array(counts).sum(axis=1, keepdims=True)
        order = sorted(range(3), key=lambda j: (-round(f[:, j].sum(), 9), j))[1:]
        x = np.column_stack([np.ones(6), f[:, order]])
        stay = np.flatnonzero(~plain.collinear(x[None])[0])
        fit = plain.least_squares(x[None][:, :, stay], y, likelihood=True)
        for c, j in enumerate(stay[1:], 1):
            for k in range(2):
                assert np.allclose(got[pos, alleles[order[j - 1]], f"Pheno_{k}"], (fit.beta[0, c, k], fit.p[0, c, k]))
                n += 1
    assert n == len(got)


def test_beta_cdf_at_fixed_places_is_the_incomplete_beta_function():
    from lociframe.functions import dist

    rng = np.random.default_rng(7)
    x = np.column_stack([rng.random((4000, 4)), np.zeros(4000), np.ones(4000), np.nextafter(np.ones(4000), 0)])
    x[::50, 0] = np.nan
    a, b = np.where(rng.random((2, 4000)) < 0.5, rng.random((2, 4000)) * 10, 10 ** rng.uniform(-15, 1, (2, 4000)))
    rows = rng.permutation(4000)[:3000]
    want = dist.beta_inc(a[rows][:, None], b[rows][:, None], x[rows])
    assert np.allclose(dist.BetaCdf(x)(rows, a[rows], b[rows]), want, rtol=0, atol=1e-12, equal_nan=True)


def test_a_simplex_that_stays_as_it_is_ends_the_search():
    """Costs that differ by noise keep the spread above the limit for ever."""
    calls = [0]

    def noise(points, at):
        calls[0] += 1
        return 1 + ((points - 1.1) ** 2).sum(axis=1) + 1e-3 * np.sin(1e18 * points).sum(axis=1) ** 2

    found = gw.nelder_mead(noise, 3)
    assert calls[0] < 1000 and np.abs(found - 1.1).max() < 0.5


def test_gwalpha_deals_few_rows_to_all_cores(spark):
    counts = [[6, 2, 1], [3, 3, 2], [1, 5, 2], [2, 6, 4], [4, 4, 4]]
    rows = spark.createDataFrame([("c", i, "A", ["A", "T", "C"], counts) for i in range(300)], "chr string, pos long, ref string, alleles array<string>, counts array<array<long>>").coalesce(1)
    z = gw.Quantiles(np.full(5, 0.2), np.array([0.0, 0.2, 0.4, 0.6, 0.9]), 0.3, 0.0, 1.0)
    out = gw.gwalpha(fl.filter_loci(rows, z.bins), z, "LS")
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = out.toPandas()
    assert len(got) == 600 and got.groupby("alleles")["statistic"].nunique().eq(1).all()
