"""Variant calls: allele depths (AD) of each sample, as counts of the pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lociframe.functions.arrays import bound
from lociframe.model import ALLELES
from lociframe.sources.lines import COMMENT, first_of, keep


#: Why lines are passed over or dropped.
REASONS = (COMMENT, "fields", "depths", "position")


def parse_lines(lines: DataFrame, tally: Observation | None = None) -> DataFrame:
    """``loci`` from rows of ``value``: alleles are REF and the ALTs, of which those of several letters are D.

    Lines whose FORMAT does not have AD exactly once are left out and counted in ``tally``; a depth of ``.`` is 0.
    A line is made and split once, its depths are split once a sample, however often the parts are used.
    """
    rows = bound(lines.select(F.inline(F.array(F.struct("value")))), f=F.split("value", "\t"))
    rows = bound(rows, form=F.split(F.get("f", F.lit(8)), ":"))
    form = F.col("form")
    pos = F.get("f", F.lit(1)).try_cast("long")
    reason = first_of((F.col("value").startswith("#"), COMMENT), (F.size("f") <= 9, "fields"), (F.size(F.filter(form, lambda x: x == "AD")) != 1, "depths"), (pos.isNull(), "position"))
    rows = keep(rows, reason, REASONS, tally).withColumn("at", F.array_position(form, "AD"))
    single = lambda a: F.when(F.length(a) == 1, F.upper(a)).otherwise("D")
    alleles = F.concat(F.array(single(F.get("f", F.lit(3)))), F.transform(F.split(F.get("f", F.lit(4)), ","), single))
    samples = F.slice("f", 10, F.size("f"))
    depths = F.transform(samples, lambda s: F.split(F.get(F.split(s, ":"), F.col("at").cast("int") - 1), ","))
    rows = bound(rows, alleles=alleles, depths=depths)
    known = lambda row: F.transform(F.col("alleles"), lambda a, i: F.coalesce(F.get(row, i).try_cast("long"), F.lit(0).cast("long")))
    numbers = F.transform("depths", known)
    return rows.select(F.get("f", F.lit(0)).alias("chr"), pos.alias("pos"), single(F.get("f", F.lit(3))).alias("ref"), "alleles", numbers.alias("counts"))


def sample_names(lines: DataFrame) -> list[str]:
    """Samples of the last header line."""
    found = lines.where(F.col("value").startswith("#CHROM")).agg(F.max("value")).first()[0]  # one header line
    if found is None:
        raise ValueError("there is no #CHROM line")
    return found.split("\t")[9:]


def read(spark: SparkSession, path: str, tally: Observation | None = None) -> DataFrame:
    """Plain or gzipped files."""
    return parse_lines(spark.read.text(path), tally)


def to_sync(loci: DataFrame) -> DataFrame:
    """Counts in the order of a sync file; of several alleles of one label the first counts, others are 0."""

    def of(row: Column, a: str) -> Column:
        at = F.array_position("alleles", a).cast("int")
        return F.when(at > 0, F.get(row, at - 1)).otherwise(F.lit(0)).cast("long")

    counts = F.transform("counts", lambda row: F.array(*[of(row, a) for a in ALLELES]))
    return loci.withColumn("counts", counts).withColumn("alleles", F.array(*[F.lit(a) for a in ALLELES]))
