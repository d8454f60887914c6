"""Genomic unusual diversity: Tajima's D troughs and peaks of one pool beside its Fst with another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import dist
from lociframe.model import EPSILON
from lociframe.operators.diversity import WINDOW, both_ways


def one_tail(x: str | Column, mean: str, sd: str) -> Column:
    """Normal tail beyond ``x`` on its side of the mean."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, mean: pd.Series, sd: pd.Series) -> pd.Series:
        v, m = x.to_numpy(float), mean.to_numpy(float)
        below = dist.normal_cdf(v, m, sd.to_numpy(float))
        return pd.Series(np.where(v < m, below, 1 - below))

    return tail(x, mean, sd)


def _spread(value: str) -> Column:
    return F.greatest(F.stddev_pop(value), F.lit(EPSILON))


def tajima_widths(tajima: DataFrame, threshold: float) -> DataFrame:
    """``tajima`` with mean, sd and width: the bp of a window whose D is ``threshold`` or more off the pool's mean.

    Windows that overlap the one before on the chromosome add its width, as far back as that
    goes on: a running sum over islands, which a window that is not significant, does not
    overlap, or is first, begins anew.
    """
    rows = tajima.where("tajima_d is not null and not isnan(tajima_d)")
    stats = rows.groupBy("pool_idx").agg(F.avg("tajima_d").alias("mean_d"), _spread("tajima_d").alias("sd_d"))  # one row a pool
    rows = rows.join(F.broadcast(stats), "pool_idx")
    order = Window.partitionBy("pool_idx", "chr").orderBy("pos_ini")
    strong = F.abs(F.col("tajima_d") - F.col("mean_d")) >= threshold
    rows = rows.withColumn("bp", F.when(strong, F.col("pos_fin") - F.col("pos_ini")).otherwise(0))
    rows = rows.withColumn("fresh", F.when(strong & (F.col("pos_ini") <= F.lag("pos_fin").over(order)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("fresh").over(order))
    return rows.withColumn("width", F.sum("bp").over(Window.partitionBy("pool_idx", "chr", "island").orderBy("pos_ini"))).drop("bp", "fresh", "island")


def gudmc(tajima: DataFrame, fst: DataFrame, threshold: float = 2.0, cm_per_mb: float = 0.73) -> DataFrame:
    """For each ordered pair of pools and window: the second's D and width, and their Fst, with tail probabilities."""
    recombination = cm_per_mb / 100 * 1e6
    widths = tajima_widths(tajima, threshold).select(*WINDOW, F.col("pool_idx").alias("pool_b"), "tajima_d", "mean_d", "sd_d", "width")
    pairs = both_ways(fst, *WINDOW).where("fst is not null")
    moments = pairs.groupBy("pool_a", "pool_b").agg(F.avg("fst").alias("mean_fst"), _spread("fst").alias("sd_fst"))  # pools squared
    rows = pairs.join(widths, [*WINDOW, "pool_b"]).join(F.broadcast(moments), ["pool_a", "pool_b"])
    spans = widths.groupBy("pool_b").agg(F.avg("width").alias("mean_w"), _spread("width").alias("sd_w"))  # one row a pool
    rows = rows.join(F.broadcast(spans), "pool_b")
    return rows.select(
        "pool_a", "pool_b", *WINDOW, F.col("mean_d").alias("mean_tajima_d_pop_b"), "mean_fst", F.col("sd_d").alias("sd_tajima_d_pop_b"), "sd_fst",
        F.col("tajima_d").alias("tajima_d_pop_b"), F.col("width").cast("double").alias("tajima_width_pop_b"), (F.col("width") - recombination).alias("tajima_width_deviation_from_r_pop_b"),
        one_tail(F.col("width").cast("double"), "mean_w", "sd_w").alias("tajima_width_one_tail_pval_pop_b"),
        (F.col("fst") - F.col("mean_fst")).alias("fst_delta"), one_tail("fst", "mean_fst", "sd_fst").alias("fst_delta_one_tail_pval"),
    )
