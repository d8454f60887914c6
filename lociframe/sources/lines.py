"""Lines of text files: counts of what a parser keeps and drops, and the order they came in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Lines that hold no record: not dropped, but passed over.
COMMENT = "comment"


def keep(rows: DataFrame, reason: Column, reasons: Sequence[str], tally: Observation | None = None) -> DataFrame:
    """``rows`` whose ``reason`` to be dropped is null.

    ``tally`` gets, as the rows are first read and without another pass over them, the number
    of ``lines``, of those ``kept``, and of those dropped for each of ``reasons``.
    """
    rows = rows.withColumn("_reason", reason)
    if tally is not None:
        named = [F.count_if(F.col("_reason") == r).alias(r) for r in reasons]
        rows = rows.observe(tally, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("_reason").isNull()).alias("kept"), *named)
    return rows.where("_reason is null").drop("_reason")


def first_of(*tests: tuple[Column, str]) -> Column:
    """The name of the first test that holds, null being none."""
    out = F.lit(None).cast("string")
    for test, name in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), name).otherwise(out)
    return out


def in_order(frame: DataFrame, lines: DataFrame) -> DataFrame:
    """``frame`` (chr, pos, ...) sorted by where its loci stand in the files that ``lines`` were read from.

    ``lines`` has ``value``, as ``spark.read.text`` gives it. A line's place is its file, its
    split of the file and its place within the split, which a scan finds again each time; of
    lines of one locus the first counts. Rows without a locus come first, others without a line last.
    """
    field = F.split("value", "\t")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    placed = lines.select(F.get(field, F.lit(0)).alias("chr"), F.get(field, F.lit(1)).try_cast("long").alias("pos"), place.alias("_place"))
    places = placed.where("pos is not null").groupBy("chr", "pos").agg(F.min("_place").alias("_place"))
    rest = [c for c in ("allele", "alleles", "phenotype") if c in frame.columns]
    return frame.join(places, ["chr", "pos"], "left").orderBy(F.col("chr").isNotNull(), F.col("_place").asc_nulls_last(), "chr", "pos", *rest).select(*frame.columns)
