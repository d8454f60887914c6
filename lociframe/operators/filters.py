"""Filters of loci and alleles, frequencies, and the long form.

All of these are narrow: a locus is one row, so nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import arrays as ar
from lociframe.model import FilterParams


def keep_alleles(loci: DataFrame, at: Column) -> DataFrame:
    """``loci`` with only the alleles at the given places."""
    kept = ar.let(at, lambda p: F.struct(ar.pick(F.col("alleles"), p).alias("alleles"), F.transform("counts", lambda row: ar.pick(row, p)).alias("counts")))
    return _unpack(loci, kept, "alleles", "counts")


def _unpack(loci: DataFrame, made: Column, *names: str) -> DataFrame:
    """The fields of a struct in the place of the columns of their names."""
    rest = [c for c in loci.columns if c not in names]
    return loci.select(*rest, made.alias("_made")).select(*rest, *[F.col(f"_made.{n}").alias(n) for n in names])


def drop_label(loci: DataFrame, label: str = "N") -> DataFrame:
    """``loci`` without the allele of this label."""
    return keep_alleles(loci, F.filter(ar.places(F.col("alleles")), lambda i: F.get("alleles", i) != label))


def filter_loci(loci: DataFrame, weights: Sequence[float], p: FilterParams = FilterParams()) -> DataFrame:
    """Loci and alleles that pass; ``freqs`` is made anew from the counts of the alleles that stay.

    Order: drop N; every pool has the depth; an allele's weighted mean frequency lies within
    [maf, 1 - maf]; two alleles stay; not too many pools are missing.
    """
    loci = drop_label(loci) if p.remove_ns else loci
    depth = ar.coverage(F.col("counts"))
    n = len(weights)
    loci = loci.where((F.size("alleles") >= 2) & (F.size("counts") == n) & (F.array_min(depth) >= p.min_coverage_depth))
    low, high = p.min_allele_frequency, 1 - p.min_allele_frequency
    places = ar.places(F.col("alleles"))
    stay = ar.let(ar.frequencies(F.col("counts")), lambda f: F.filter(places, lambda i: ar.weighted_mean(f, weights, i).between(low, high)))
    missing = F.size(F.filter("counts", lambda row: ar.total(row.cast("array<double>")) == 0)) / float(n)
    loci = loci.where((missing <= p.max_missingness_rate) & (missing < 1)).withColumn("stay", stay).where(F.size("stay") >= 2)
    loci = keep_alleles(loci, F.col("stay")).drop("stay")
    return loci.withColumn("freqs", ar.frequencies(F.col("counts")))


def filter_freqs(loci: DataFrame, weights: Sequence[float], p: FilterParams = FilterParams()) -> DataFrame:
    """As ``filter_loci``, where only ``freqs`` are known: there is no depth to ask for.

    Frequencies are made to add up to 1 once N is dropped, and stay as they are when other alleles go.
    """
    rows = loci.drop("counts").withColumnRenamed("freqs", "counts")
    rows = drop_label(rows) if p.remove_ns else rows
    rows = rows.withColumn("counts", ar.frequencies(F.col("counts")))
    low, high, n = p.min_allele_frequency, 1 - p.min_allele_frequency, len(weights)
    stay = F.filter(ar.places(F.col("alleles")), lambda i: ar.weighted_mean(F.col("counts"), weights, i).between(low, high))
    missing = F.size(F.filter("counts", lambda row: F.get(row, F.lit(0)).isNull())) / float(n)
    rows = rows.where((F.size("counts") == n) & (missing <= p.max_missingness_rate) & (missing < 1)).withColumn("stay", stay).where(F.size("stay") >= 2)
    return keep_alleles(rows, F.col("stay")).drop("stay").withColumnRenamed("counts", "freqs")


def enough_breadth(loci: DataFrame, p: FilterParams) -> DataFrame:
    """Loci of which at least ceil(breadth * pools) pools have the depth, with that number as ``n_pass``."""
    n_pass = F.size(F.filter(ar.coverage(F.col("counts")), lambda c: c >= p.min_coverage_depth))
    return loci.withColumn("n_pass", n_pass).where(F.col("n_pass") >= F.ceil(F.size("counts") * p.min_coverage_breadth))


def enough_alleles(loci: DataFrame, weights: Sequence[float], maf: float) -> DataFrame:
    """Loci with at least two alleles whose weighted mean frequency lies within [maf, 1 - maf]."""
    places = ar.places(F.col("alleles"))
    passing = ar.let(ar.frequencies(F.col("counts")), lambda f: F.filter(places, lambda i: ar.weighted_mean(f, weights, i).between(maf, 1 - maf)))
    return loci.where(F.size(passing) >= 2)


def sort_alleles(loci: DataFrame, descending: bool = True, skip_first: bool = False) -> DataFrame:
    """Alleles by their summed frequency; those equal to 9 digits keep their order. Needs ``freqs``.

    With ``skip_first`` the first goes where there are two or more.
    """
    sign = -1.0 if descending else 1.0

    def order(f: Column) -> Column:
        sum_of = lambda i: F.round(F.aggregate(f, F.lit(0.0), lambda s, row: s + F.coalesce(F.get(row, i), F.lit(0.0))), 9) * sign
        keyed = F.array_sort(F.transform(ar.places(F.col("alleles")), lambda i: F.struct(sum_of(i).alias("x"), i.alias("i"))))
        at = F.transform(keyed, lambda k: k["i"])
        return F.when(F.size(at) >= 2, F.slice(at, 2, F.size(at))).otherwise(at) if skip_first else at

    def sorted_(f: Column) -> Column:
        rows = lambda m, p: F.transform(m, lambda row: ar.pick(row, p))
        return ar.let(order(f), lambda p: F.struct(ar.pick(F.col("alleles"), p).alias("alleles"), rows(F.col("counts"), p).alias("counts"), rows(f, p).alias("freqs")))

    return _unpack(loci, ar.let(F.col("freqs"), sorted_), "alleles", "counts", "freqs")


def drop_major(loci: DataFrame) -> DataFrame:
    """Alleles sorted by summed frequency, without the first where there are two or more. Needs ``freqs``."""
    return sort_alleles(loci, skip_first=True)


def freqs_to_counts(loci: DataFrame) -> DataFrame:
    """``counts`` from ``freqs``: in each pool the smallest frequency above 0 is one count."""

    def one(row: Column) -> Column:
        return ar.let(F.array_min(F.filter(row, lambda x: x > 0)), lambda least: F.transform(row, lambda x: F.round(F.try_divide(x, least)).cast("long")))

    return loci.withColumn("counts", F.transform("freqs", one))


def to_long(loci: DataFrame, column: str = "freqs", name: str = "freq") -> DataFrame:
    """One row for each locus, allele and pool: chr, pos, allele, allele_ord, pool_idx and the value."""
    cells = ar.let(
        F.col("alleles"),
        lambda labels: F.flatten(F.transform(column, lambda row, pool: F.transform(row, lambda x, i: F.struct(F.get(labels, i).alias("allele"), i.alias("allele_ord"), pool.alias("pool_idx"), x.alias(name))))),
    )
    return loci.select("chr", "pos", F.explode(cells).alias("_x")).select("chr", "pos", "_x.*")


def allele_rows(loci: DataFrame) -> DataFrame:
    """One row for each locus and allele, with the pools' frequencies as the array ``x``. Needs ``freqs``."""
    columns = ar.let(F.col("freqs"), lambda f: F.transform("alleles", lambda a, i: F.struct(a.alias("allele"), F.transform(f, lambda row: F.get(row, i)).alias("x"))))
    return loci.select("chr", "pos", F.posexplode(columns).alias("allele_ord", "_x")).select("chr", "pos", "_x.allele", "allele_ord", "_x.x")
