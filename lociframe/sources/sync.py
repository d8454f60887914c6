"""Synchronised counts: chr, pos, ref and ``a:t:c:g:d:n`` for each pool, tab separated; ``#`` lines are comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lociframe.model import ALLELES
from lociframe.sources.lines import COMMENT, first_of, in_order, keep


#: Why lines are passed over or dropped.
REASONS = (COMMENT, "fields", "position", "counts")


def parse_lines(lines: DataFrame, alleles: Sequence[str] = ALLELES, tally: Observation | None = None) -> DataFrame:
    """``loci`` from rows of ``value``. Lines with a bad position, or a pool without six counts, are left out and counted in ``tally``."""
    field = F.split("value", "\t")
    pools = F.slice(field, 4, F.greatest(F.size(field), F.lit(0)))
    counts = F.transform(pools, lambda p: F.transform(F.split(p, ":"), lambda x: x.try_cast("long")))
    rows = lines.select(
        "value", F.size(field).alias("n"), F.get(field, F.lit(0)).alias("chr"), F.get(field, F.lit(1)).try_cast("long").alias("pos"), F.get(field, F.lit(2)).alias("ref"),
        F.array(*[F.lit(a) for a in alleles]).alias("alleles"), counts.alias("counts"),
    )
    whole = F.forall("counts", lambda c: (F.size(c) == len(alleles)) & F.forall(c, lambda x: x.isNotNull()))
    reason = first_of((F.col("value").startswith("#"), COMMENT), (F.col("n") <= 3, "fields"), (F.col("pos").isNull(), "position"), (~whole, "counts"))
    return keep(rows, reason, REASONS, tally).drop("value", "n")


def read(spark: SparkSession, path: str, alleles: Sequence[str] = ALLELES, tally: Observation | None = None) -> DataFrame:
    return parse_lines(spark.read.text(path), alleles, tally)


def line_of(loci: DataFrame) -> Column:
    """The sync line of a locus; alleles that it does not have count 0."""
    count_of = lambda row, a: F.coalesce(F.get(row, F.array_position("alleles", a).cast("int") - 1), F.lit(0))
    pools = F.transform("counts", lambda row: F.concat_ws(":", *[F.when(F.array_contains("alleles", a), count_of(row, a)).otherwise(0).cast("string") for a in ALLELES]))
    return F.concat_ws("\t", "chr", F.col("pos").cast("string"), "ref", F.array_join(pools, "\t"))


def header(names: Sequence[str]) -> str:
    return "\t".join(["#chr", "pos", "ref", *names])


def write(loci: DataFrame, path: str, names: Sequence[str] | None = None, lines: DataFrame | None = None) -> None:
    """Sync lines below a line with the pools' names if these are given; fails where ``path`` exists.

    They are in the order of ``lines``, the input's, or of the genome where it is not given.
    """
    rows = loci.select("chr", "pos", line_of(loci).alias("value"))
    if names is not None:
        rows = loci.sparkSession.createDataFrame([(None, None, header(names))], "chr string, pos long, value string").unionByName(rows)
    rows = rows.orderBy(F.col("chr").isNotNull(), "chr", "pos") if lines is None else in_order(rows, lines)
    rows.select("value").write.text(path)


def wide_frequencies(loci: DataFrame, names: Sequence[str]) -> DataFrame:
    """chr, pos, allele and a column of each pool's frequency to 6 digits. Needs ``freqs``."""
    from lociframe.operators.filters import allele_rows

    return allele_rows(loci).select("chr", "pos", "allele", *[F.round(F.get("x", F.lit(i)), 6).alias(n) for i, n in enumerate(names)])


def wide_long(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """chr, pos, allele and a column of each pool's frequency to 6 digits, from rows of one pool each.

    Pools of which no row is left have no column.
    """
    left = sorted(r[0] for r in long.select("pool_idx").distinct().collect())  # pools
    cells = F.map_from_entries(F.collect_list(F.struct("pool_idx", "freq")))
    rows = long.groupBy("chr", "pos", "allele", "allele_ord").agg(cells.alias("_x"))
    return rows.select("chr", "pos", "allele", *[F.round(F.try_element_at("_x", F.lit(i)), 6).alias(names[i]) for i in left])


def to_digits(frame: DataFrame, digits: int) -> DataFrame:
    """``frame`` with all fractions rounded, as they are printed."""
    return frame.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c, kind in frame.dtypes if kind == "double"})


def write_csv(frame: DataFrame, path: str, lines: DataFrame | None = None) -> None:
    """A table with a header; fails where ``path`` exists.

    Rows are in the order of ``lines``, the input's, where it is given and rows have a locus, or of the genome.
    """
    keys = [c for c in ("model", "chr", "pos", "pos_ini", "allele", "alleles", "phenotype", "pop_a", "pop_b", "pool_a", "pool_b", "pool_idx", "rep", "fold") if c in frame.columns]
    if lines is not None and {"chr", "pos"} <= set(frame.columns) and "model" not in keys:
        frame = in_order(frame, lines)
    elif keys:
        frame = frame.orderBy(*keys)
    frame.write.csv(path, header=True)
