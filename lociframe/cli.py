"""Command line: ``python -m lociframe.cli VERB -f INPUT -p PHENOTYPES -o OUTPUT``."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lociframe.model import ALLELES, ALLELES_N_BEFORE_D, FilterParams, WindowParams
from lociframe.operators import association as asc
from lociframe.operators import diversity as dv
from lociframe.operators import filters as fl
from lociframe.operators import gudmc as gd
from lociframe.operators import gwalpha as gw
from lociframe.operators import impute, post, prediction, tables
from lociframe.operators.windows import sliding_windows
from lociframe.sources import phen as ph
from lociframe.sources import pileup, sync, vcf
from lociframe.sources.shared import materialize

SCANS = ("ols_iter", "ols_iter_with_kinship", "mle_iter", "mle_iter_with_kinship", "ridge_iter", "pearson_corr")
VERBS = (
    "pileup2sync", "vcf2sync", "sync2csv", "fisher_exact_test", "chisq_test", "pearson_corr", "ols_iter", "ols_iter_with_kinship", "mle_iter", "mle_iter_with_kinship", "ridge_iter",
    "gwalpha", "genomic_prediction_cross_validation", "fst", "heterozygosity", "watterson_estimator", "tajima_d", "gudmc", "impute",
)


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("verb", choices=VERBS)
    a.add_argument("-f", "--fname", required=True)
    a.add_argument("-o", "--output", default="")
    a.add_argument("-p", "--phen-fname", required=True)
    a.add_argument("--phen-delim", default=",")
    a.add_argument("--phen-name-col", type=int, default=0)
    a.add_argument("--phen-pool-size-col", type=int, default=1)
    a.add_argument("--phen-value-col", default="2")
    a.add_argument("--max-base-error-rate", type=float, default=0.01)
    a.add_argument("--min-coverage-breadth", type=float, default=1.0)
    a.add_argument("--min-coverage-depth", type=int, default=1)
    a.add_argument("--min-allele-frequency", type=float, default=0.001)
    a.add_argument("--max-missingness-rate", type=float, default=0.0)
    for flag in ("--generate-plots", "--output-sig-snps-only", "--keep-lowercase-reference", "--keep-ns", "--keep-p-minus-1", "--n-before-d"):
        a.add_argument(flag, action="store_true")
    a.add_argument("-x", "--xxt-eigen-variance-explained", type=float, default=0.75)
    a.add_argument("--gwalpha-method", choices=("LS", "ML"), default="ML")
    a.add_argument("--ridge", type=float, default=1.0)
    a.add_argument("--k-folds", type=int, default=10)
    a.add_argument("--n-reps", type=int, default=3)
    a.add_argument("--window-size-bp", type=int, default=100)
    a.add_argument("--window-slide-size-bp", type=int, default=50)
    a.add_argument("--min-loci-per-window", type=int, default=10)
    a.add_argument("--sigma-threshold", type=float, default=2.0)
    a.add_argument("--recombination-rate-cm-per-mb", type=float, default=0.73)
    a.add_argument("--min-depth-set-to-missing", type=float, default=5)
    a.add_argument("--frac-top-missing-pools", type=float, default=0.1)
    a.add_argument("--genome-order", action="store_true", help="write loci by chromosome and position instead of in the input's order")
    a.add_argument("--frac-top-missing-loci", type=float, default=0.1)
    a.add_argument("--imputation-method", choices=("mean", "aLD-kNNi"), default="aLD-kNNi")
    a.add_argument("--n-loci-to-estimate-distance", type=int, default=10)
    a.add_argument("--k-neighbours", type=int, default=5)
    return a


#: Digits after the point of what a verb writes, where not all of them.
DIGITS = {"fst": 8, "heterozygosity": 8, "watterson_estimator": 8, "tajima_d": 8, "gudmc": 7, "chisq_test": 6}


def frames(spark: SparkSession, a: argparse.Namespace, tally: Observation | None = None) -> dict[str, DataFrame]:
    """Results of a verb by name; the empty name is the main one. ``tally`` counts the lines of the input."""
    p = FilterParams(not a.keep_ns, a.max_base_error_rate, a.min_coverage_depth, a.min_coverage_breadth, a.min_allele_frequency, a.max_missingness_rate, a.keep_lowercase_reference)
    w = WindowParams(a.window_size_bp, a.window_slide_size_bp, a.min_loci_per_window)
    # written once, so that lines are parsed and counted once, however often a sort or a second pass reads them
    read = lambda: materialize(sync.read(spark, a.fname, ALLELES_N_BEFORE_D if a.n_before_d else ALLELES, tally), "raw")
    if a.verb == "gwalpha":
        z = ph.read_quantiles(spark, a.phen_fname)
        loci = fl.filter_loci(read(), z.bins, p)
        return {"": gw.gwalpha(loci, z, a.gwalpha_method)}
    phen = ph.read_delimited(spark, a.phen_fname, a.phen_delim, a.phen_name_col, a.phen_pool_size_col, [int(x) for x in a.phen_value_col.split(",")])
    if a.verb in ("pileup2sync", "vcf2sync"):
        loci = pileup.read(spark, a.fname, p, len(phen.names), tally) if a.verb == "pileup2sync" else vcf.read(spark, a.fname, tally)
        loci = materialize(loci, "raw")
        loci = fl.enough_alleles(fl.enough_breadth(loci, p), phen.weights, p.min_allele_frequency)
        return {"": vcf.to_sync(loci) if a.verb == "vcf2sync" else loci}
    raw = read()
    if a.verb in SCANS or a.verb == "genomic_prediction_cross_validation":
        keep = phen.complete
        raw, phen = asc.only_pools(raw, keep), phen.only(keep)
    loci = fl.filter_loci(raw, phen.weights, p)
    if a.verb == "sync2csv":
        return {"": sync.wide_frequencies(fl.drop_major(loci) if a.keep_p_minus_1 else loci, phen.names)}
    if a.verb == "fisher_exact_test":
        return {"": tables.fisher_exact_test(loci)}
    if a.verb == "chisq_test":
        return {"": tables.chisq_test(loci)}
    if a.verb in SCANS:
        found = {
            "pearson_corr": lambda: asc.correlation_scan(loci, phen),
            "ols_iter": lambda: asc.regression_scan(loci, phen),
            "mle_iter": lambda: asc.regression_scan(loci, phen, likelihood=True),
            "ridge_iter": lambda: asc.regression_scan(loci, phen, ridge=a.ridge),
            "ols_iter_with_kinship": lambda: asc.kinship_scan(fl.drop_major(loci) if a.keep_p_minus_1 else loci, phen, a.xxt_eigen_variance_explained),
            "mle_iter_with_kinship": lambda: asc.kinship_scan(fl.drop_major(loci) if a.keep_p_minus_1 else loci, phen, a.xxt_eigen_variance_explained, likelihood=True),
        }[a.verb]()
        out = {"": post.significant(found) if a.output_sig_snps_only else found}
        return out | ({"manhattan": post.manhattan(found), "qq": post.quantiles(found)} if a.generate_plots else {})
    if a.verb == "genomic_prediction_cross_validation":
        rows = fl.allele_rows(fl.drop_major(loci) if a.keep_p_minus_1 else loci)
        cv = prediction.cross_validate(rows, phen.values, k=a.k_folds, reps=a.n_reps)
        return {"": spark.createDataFrame(cv.metrics), "predictions": spark.createDataFrame(cv.predictions), "predictors": prediction.predictors(rows, phen.values)}
    if a.verb == "impute":
        long = fl.to_long(loci).join(fl.to_long(loci.withColumn("freqs", F.transform("counts", lambda r: r.cast("array<double>"))), name="count"), ["chr", "pos", "allele", "allele_ord", "pool_idx"])
        cover = long.groupBy("chr", "pos", "pool_idx").agg(F.sum("count").alias("coverage"))
        rows = long.drop("count").join(cover, ["chr", "pos", "pool_idx"])
        filled = impute.impute_pipeline(rows, a.min_depth_set_to_missing, a.frac_top_missing_pools, a.frac_top_missing_loci, a.imputation_method, w, a.n_loci_to_estimate_distance, a.k_neighbours)
        return {"": sync.wide_long(materialize(filled, "imputed"), phen.names)}
    loci = materialize(loci, "loci")  # windows and values are both made of it
    windows = sliding_windows(loci, w)
    fst = lambda: dv.fst_windows(loci, windows, w)
    if a.verb == "fst":
        return {"": dv.fst_matrix(dv.fst_genome(loci), phen.names), "windows": dv.fst_wide(fst(), phen.names)}
    if a.verb == "heterozygosity":
        return {"": dv.wide(dv.pi_windows(loci, windows, w), "pi", phen.names)}
    if a.verb == "watterson_estimator":
        return {"": dv.wide(dv.watterson_windows(loci, windows, phen.sizes, w), "theta_w", phen.names)}
    tajima = dv.tajima_windows(loci, windows, phen.sizes, w)
    if a.verb == "tajima_d":
        return {"": dv.wide(tajima, "tajima_d", phen.names)}
    found = gd.gudmc(materialize(tajima, "tajima"), materialize(fst(), "fst"), a.sigma_threshold, a.recombination_rate_cm_per_mb)
    name = lambda c: F.array(*[F.lit(n) for n in phen.names])[F.col(c)]
    return {"": found.select(name("pool_a").alias("pop_a"), name("pool_b").alias("pop_b"), *found.columns[2:])}


def pool_names(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Of the pools of a sync file to be written: a VCF's samples, or the phenotypes' names."""
    if a.verb == "vcf2sync":
        return vcf.sample_names(spark.read.text(a.fname))
    return list(ph.read_delimited(spark, a.phen_fname, a.phen_delim, a.phen_name_col, a.phen_pool_size_col, [int(x) for x in a.phen_value_col.split(",")]).names)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Run a verb; returns the output's path."""
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName(f"lociframe {a.verb}").getOrCreate()
    out = a.output or f"{Path(a.fname).with_suffix('')}-{a.verb}-{int(time.time())}"
    tally, lines = Observation("lines"), None if a.genome_order else spark.read.text(a.fname)
    for name, frame in frames(spark, a, tally).items():
        path = f"{out}-{name}" if name else out
        if a.verb in ("pileup2sync", "vcf2sync"):
            sync.write(frame, path, pool_names(spark, a), lines)
        else:
            sync.write_csv(sync.to_digits(frame, DIGITS[a.verb]) if a.verb in DIGITS else frame, path, lines)
    print(", ".join(f"{k}: {v}" for k, v in tally.get.items()), file=sys.stderr)
    return out


if __name__ == "__main__":
    print(main())
