import numpy as np
from pyspark.sql import functions as F

from lociframe.functions.arrays import frequencies
from lociframe.model import LOCI_SCHEMA, FilterParams
from lociframe.operators import filters as fl
from lociframe.operators import tables


def locus(spark, alleles, counts):
    return spark.createDataFrame([("chr", 1, "A", list(alleles), counts)], LOCI_SCHEMA).withColumn("freqs", frequencies(F.col("counts")))


def test_chi_square_of_fixed_alleles(spark):
    row = tables.chisq_test(locus(spark, "AT", [[0, 20], [20, 0], [0, 20], [20, 0]])).first()
    assert abs(row.statistic - 4) < 1e-12 and abs(row.pvalue - 0.7797774084757156) < 1e-9


def test_fisher(spark):
    loci = locus(spark, "TC", [[0, 3], [1, 5], [2, 6]])
    row = tables.fisher_exact_test(loci).first()
    assert abs(row.statistic - 0.247058823529) < 1e-9 and abs(row.pvalue - 0.60735294117) < 1e-9
    assert abs(tables.fisher_observed(loci).first().statistic - row.statistic) < 1e-12


def test_fisher_scales_large_tables_down():
    observed, p = tables.fisher_kernel(np.array([[[100, 200], [300, 100]]], float))
    assert 0 < observed[0] <= p[0]


def test_corner_tables_keep_the_margins():
    """Each cell of a plain fill takes what its row and column have left."""
    rng = np.random.default_rng(4)
    for n, p in ((1, 2), (2, 2), (3, 2), (5, 4), (4, 6)):
        m = rng.integers(0, 4, (30, n, p))
        rows, columns = m.sum(axis=2), m.sum(axis=1)
        for a in range(n):
            for b in range(p):
                got = tables.corner_tables(rows, columns, a, b)
                assert (got.sum(axis=2) == rows).all() and (got.sum(axis=1) == columns).all() and (got >= 0).all()
                cells = [(i, j) for i in range(n) for j in range(p) if i == n - 1 or j == p - 1 or (i >= a and j >= b)]
                for k in range(30):
                    r, c, t = rows[k].tolist(), columns[k].tolist(), np.zeros((n, p), int)
                    for i, j in cells + [(i, j) for j in range(p)[::-1] for i in range(n)[::-1]]:
                        x = min(r[i], c[j])
                        t[i, j], r[i], c[j] = t[i, j] + x, r[i] - x, c[j] - x
                    assert np.array_equal(t, got[k])


def test_filter_drops_n_rare_alleles_and_shallow_loci(spark):
    rows = [
        ("a", 1, "A", ["A", "T", "N"], [[5, 5, 9], [6, 4, 0]]),
        ("a", 2, "A", ["A", "T", "N"], [[0, 0, 9], [6, 4, 0]]),  # a pool without depth
        ("a", 3, "A", ["A", "T", "C"], [[99, 1, 0], [100, 0, 0]]),  # one allele left
        ("a", 4, "A", ["A", "T", "C"], [[50, 49, 1], [50, 50, 0]]),
        ("a", 5, "A", [], [[], []]),
    ]
    loci = fl.filter_loci(spark.createDataFrame(rows, LOCI_SCHEMA), [0.5, 0.5], FilterParams(min_allele_frequency=0.01))
    got = {r.pos: r for r in loci.collect()}
    assert set(got) == {1, 4}
    assert got[1].alleles == ["A", "T"] and got[4].alleles == ["A", "T"]
    assert abs(got[4].freqs[0][0] - 50 / 99) < 1e-12


def test_major_allele_goes_and_order_is_by_frequency(spark):
    loci = fl.drop_major(locus(spark, "ATCG", [[1, 5, 2, 2], [1, 5, 2, 2]]))
    row = loci.first()
    assert row.alleles == ["C", "G", "A"] and row.counts == [[2, 2, 1], [2, 2, 1]]


def test_frequencies_to_counts(spark):
    row = fl.freqs_to_counts(locus(spark, "ATC", [[4, 2, 6], [0, 3, 9]])).first()
    assert row.counts == [[2, 1, 3], [0, 1, 3]]
