"""Missing frequencies: set by depth, counted, and pools and loci dropped by how much they miss. Rows are long."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOCUS = ["chr", "pos"]


def set_missing_by_depth(long: DataFrame, depth: float) -> DataFrame:
    """Coverage below ``depth`` and the frequencies that rest on it become null."""
    low = F.col("coverage").isNull() | (F.col("coverage") < depth)
    return long.withColumns({"freq": F.when(~low, F.col("freq")), "coverage": F.when(~low, F.col("coverage"))})


def _cells(long: DataFrame) -> DataFrame:
    """One row for each locus and pool: whether its coverage is missing."""
    return long.groupBy(*LOCUS, "pool_idx").agg(F.max(F.col("coverage").isNull().cast("int")).alias("missing"))


def missing_rate(long: DataFrame) -> DataFrame:
    """missing_rate: percent of (locus, pool) without coverage, to 2 digits."""
    return _cells(long).agg(F.round(100 * F.avg("missing"), 2).alias("missing_rate"))


def drop_pools(long: DataFrame, share: float) -> DataFrame:
    """Without the pools that miss most: ``share`` of those that miss any, rounded up. Ties stay in pool order."""
    per = _cells(long).groupBy("pool_idx").agg(F.sum("missing").alias("missing"))  # one row a pool
    order = Window.orderBy("missing", "pool_idx")
    every = Window.partitionBy()
    kept = per.withColumns({"place": F.row_number().over(order), "n": F.count("*").over(every), "some": F.sum(F.when(F.col("missing") > 0, 1).otherwise(0)).over(every)})
    kept = kept.where(F.col("place") <= F.col("n") - F.ceil(F.col("some") * share)).select("pool_idx")
    return long.join(F.broadcast(kept), "pool_idx", "left_semi")


def drop_loci(long: DataFrame, share: float) -> DataFrame:
    """Without the loci that miss most: ``share`` of those that miss any, rounded up; with 1.0, all of these.

    Loci are told apart by how many pools they miss, of which there are few values. Whole
    classes go first; only loci of the class that is cut are put in order.
    """
    per = _cells(long).groupBy(*LOCUS).agg(F.sum("missing").alias("missing"))
    if share >= 1:
        return long.join(per.where("missing > 0").select(*LOCUS), LOCUS, "left_anti")
    classes = per.groupBy("missing").count()  # at most pools + 1 rows
    some = Window.partitionBy()
    more = Window.orderBy(F.desc("missing")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.where("missing > 0").withColumns({"total": F.sum("count").over(some), "above": F.coalesce(F.sum("count").over(more), F.lit(0))})
    classes = classes.withColumn("cut", F.ceil(F.col("total") * share) - F.col("above")).where("cut > 0")
    whole = classes.where("cut >= count").select("missing")
    partly = classes.where("cut < count").select("missing", "cut")
    gone = per.join(F.broadcast(whole), "missing", "left_semi").select(*LOCUS)
    # the last loci of the class in genome order go: their number is what the first pass left over
    ranked = per.join(F.broadcast(partly), "missing")
    last = Window.partitionBy("chr").orderBy(F.desc("pos"))
    per_chr = ranked.groupBy("chr").count()
    later = per_chr.withColumn("later", F.coalesce(F.sum("count").over(Window.orderBy(F.desc("chr")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("place", F.row_number().over(last)).join(F.broadcast(later.select("chr", "later")), "chr")
    gone = gone.unionByName(ranked.where("place + later <= cut").select(*LOCUS))
    return long.join(gone, LOCUS, "left_anti")
