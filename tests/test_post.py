"""Quantiles with ties, and what passes the significance filter."""

import math

from pyspark.sql import functions as F

from lociframe.operators import post


def scan(spark, rows):
    return spark.createDataFrame(rows, "chr string, pos long, alleles string, freq double, phenotype string, statistic double, pvalue double")


def test_quantiles_of_ties(spark):
    """Half of all p values are 1, some missing or 0."""
    rows = [("c", i, "A", 0.5, f"Pheno_{i % 2}", 1.0, 1.0 if i % 4 < 2 else (i % 7) / 10 if i % 5 else float("nan")) for i in range(4000)]
    got = post.quantiles(scan(spark, rows).repartition(7)).collect()
    for k in range(2):
        p = sorted((r[6], r[1]) for r in rows if r[4] == f"Pheno_{k}" and r[6] > 0)
        mine = {r.pos: (r.observed, r.expected) for r in got if r.phenotype == f"Pheno_{k}"}
        assert len(mine) == len(p)
        for i, (v, pos) in enumerate(p):
            assert math.isclose(mine[pos][0], -math.log10(v), abs_tol=1e-12) and math.isclose(mine[pos][1], -math.log10((i + 0.5) / len(p)), rel_tol=1e-12)


def test_one_p_value_is_no_hot_task(spark):
    rows = spark.range(20_000).selectExpr("'Pheno_0' as phenotype", "1.0D as pvalue", "'c' as chr", "id as pos", "'A' as alleles").repartition(6)
    placed = post.ranked(rows, "phenotype", "pvalue", "chr", "pos", "alleles")
    assert placed.where("place <> pos").count() == 0
    sizes = [r["count"] for r in placed.groupBy(F.floor(F.col("place") / 5_000)).count().collect()]
    assert sizes == [5_000] * 4
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # else so few rows are one partition
    try:
        dealt = rows.repartitionByRange("phenotype", "pvalue", "chr", "pos", "alleles").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset(key)
    assert dealt < 10_000


def test_significance_filter_keeps_what_passes(spark):
    rows = [("c", i, "A", 0.5, "Pheno_0", 1.0, 10.0**-i) for i in range(1, 11)]
    assert sorted(r.pos for r in post.significant(scan(spark, rows)).collect()) == list(range(3, 11))
    assert post.quantiles(scan(spark, rows).where("false")).count() == 0
