"""Linear algebra and tails as expressions against numpy."""

import numpy as np

from lociframe.functions import dist
from lociframe.functions import linear as ln
from pyspark.sql import functions as F


def test_inverse_and_products(spark):
    rng = np.random.default_rng(8)
    designs = [rng.random((7, p)) for p in (1, 2, 3, 6) for _ in range(4)] + [np.ones((7, 2)), np.column_stack([np.ones(7), np.zeros(7)])]
    frame = spark.createDataFrame([(i, d.T.tolist()) for i, d in enumerate(designs)], "i int, m array<array<double>>").withColumn("g", ln.products(F.col("m"), F.col("m")))
    rows = frame.select("i", "g", ln.inverse(F.col("g")).alias("inv"), ln.is_singular(F.col("g"), ln.inverse(F.col("g"))).alias("no"), ln.transpose(F.col("m")).alias("t")).collect()
    for r in rows:
        d = designs[r.i]
        assert np.allclose(r.g, d.T @ d) and np.allclose(r.t, d)
        assert r.no == (r.i >= 16)
        if not r.no:
            assert np.allclose(r.inv, np.linalg.inv(d.T @ d), rtol=1e-7)


def test_student_tail(spark):
    t = np.concatenate([[0.0, 1e-9, 1e200, -3.0, 50, 1e4], np.linspace(0.01, 40, 60)])
    frame = spark.createDataFrame([(float(v),) for v in t], "t double").repartition(1)
    for df in (1, 2, 3, 4, 5, 8, 24, 99):
        got = np.array([r[0] for r in frame.select(ln.t_two_sided(F.col("t"), df)).collect()])
        assert np.allclose(got, dist.t_two_sided(t, df), rtol=2e-8, atol=1e-300), df
    assert np.isnan(spark.sql("select double('NaN') as t").select(ln.t_two_sided(F.col("t"), 4)).first()[0])
