"""After a scan: significance by Bonferroni, and the data of Manhattan and quantile plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.sources.shared import materialize


def significant(scan: DataFrame, level: float = 0.05) -> DataFrame:
    """Rows of which p is below ``level`` over the number of tests of one phenotype."""
    tests = scan.agg((F.count("*") / F.countDistinct("phenotype")).alias("tests"))  # one row
    return scan.crossJoin(F.broadcast(tests)).where(F.col("pvalue") < F.lit(level) / F.col("tests")).drop("tests")


def manhattan(scan: DataFrame) -> DataFrame:
    """``scan`` with ``x``, the position along all chromosomes laid end to end, and ``neg_log10_p``."""
    lengths = scan.groupBy("chr").agg(F.max("pos").alias("length"))  # one row a chromosome
    before = Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("chr", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return scan.join(F.broadcast(offsets), "chr").select("*", (F.col("pos") + F.col("offset")).alias("x"), (-F.log10("pvalue")).alias("neg_log10_p")).drop("offset")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place``, from 0, in the order of all of ``order``.

    Rows are sorted over range partitions and written once; a place is that within its
    partition and the number of rows before. Ties in the first columns are split by the later
    ones, so that no task holds all rows of one value.
    """
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    made = materialize(made, "ranked")
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = made.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place")
    return made.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*rows.columns, place)


def quantiles(scan: DataFrame) -> DataFrame:
    """phenotype, chr, pos, alleles, observed and expected -log10 p: p in ascending order against (i - 0.5) / n."""
    rows = scan.where("pvalue > 0 and not isnan(pvalue)").select("phenotype", "pvalue", "chr", "pos", "alleles")
    placed = ranked(rows, *rows.columns)
    each = rows.groupBy("phenotype").agg(F.count("*").alias("n"))  # one row a phenotype
    before = Window.orderBy("phenotype").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    expected = (F.col("place") - F.col("first") + 0.5) / F.col("n")
    return placed.join(F.broadcast(each), "phenotype").select("phenotype", "chr", "pos", "alleles", (-F.log10("pvalue")).alias("observed"), (-F.log10(expected)).alias("expected"))


def ks_statistic(scan: DataFrame) -> DataFrame:
    """phenotype, ks: largest distance between the p values' distribution and the uniform one."""
    q = quantiles(scan).withColumns({"p": F.pow(F.lit(10.0), -F.col("observed")), "e": F.pow(F.lit(10.0), -F.col("expected"))})
    n = q.groupBy("phenotype").agg(F.count("*").alias("n"))
    half = 0.5 / F.col("n")
    gap = F.greatest(F.abs(F.col("p") - F.col("e") - half), F.abs(F.col("p") - F.col("e") + half))
    return q.join(F.broadcast(n), "phenotype").groupBy("phenotype").agg(F.max(gap).alias("ks"))
