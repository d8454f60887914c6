"""Pileup: for each pool a coverage, read codes and base qualities.

Read codes are undone with regular expressions and array functions: ``^`` and the quality
after it and ``$`` go; then the text is cut at ``+`` and ``-``, and each cut loses its length
and as many letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import arrays as ar
from lociframe.model import ALLELES, FilterParams
from lociframe.sources.lines import COMMENT, first_of, keep


def bases(reads: Column, ref: Column) -> Column:
    """Read codes to an array of letters A, T, C, G, D or N; ``.`` and ``,`` are the reference."""
    plain = F.regexp_replace(F.regexp_replace(reads, r"\^.", ""), r"\$", "")
    parts = F.split(plain, r"[+-](?=\d)")
    length = lambda s: F.regexp_extract(s, r"^(\d+)", 1)
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda s: F.substring(s, F.length(length(s)) + length(s).try_cast("int") + 1, F.length(s)))
    joined = F.concat(parts[0], F.array_join(rest, ""))
    letter = (
        lambda c: F.when(c.isin(".", ","), F.when(ref.isin("A", "T", "C", "G", "a", "t", "c", "g"), ref).otherwise("N"))
        .when(c == "*", "D")
        .when(F.upper(c).isin("A", "T", "C", "G"), F.upper(c))
        .otherwise("N")
    )
    return F.when(F.length(joined) > 0, F.transform(F.split(joined, ""), letter)).otherwise(F.array().cast("array<string>"))


#: Why lines are passed over or dropped.
REASONS = (COMMENT, "fields", "position", "codes")


def parse_lines(lines: DataFrame, tally: Observation | None = None) -> DataFrame:
    """chr, pos, ref and pools (cov, bases, quals). Lines of which the numbers of codes do not fit are left out and counted in ``tally``, and comments."""
    rows = lines.select("value", F.split("value", "\t").alias("f"))
    rows = rows.select("value", F.get("f", F.lit(0)).alias("chr"), F.get("f", F.lit(1)).try_cast("long").alias("pos"), F.get("f", F.lit(2)).alias("ref"), "f")
    n = F.floor((F.size("f") - 3) / 3).cast("int")

    def pool(i: Column) -> Column:
        cov = F.get("f", 3 + 3 * i).try_cast("long")
        empty = F.array().cast("array<string>")
        return F.struct(
            cov.alias("cov"), F.when(cov > 0, bases(F.get("f", 4 + 3 * i), F.col("ref"))).otherwise(empty).alias("bases"),
            F.when(cov > 0, F.filter(F.split(F.get("f", 5 + 3 * i), ""), lambda c: c != "")).otherwise(empty).alias("quals"),
        )

    # a comment is not parsed, whatever it looks like
    early = first_of((F.col("value").startswith("#"), COMMENT), (F.size("f") <= 3, "fields"), (F.col("pos").isNull(), "position"))
    rows = ar.bound(rows, _early=early)
    rows = ar.bound(rows, pools=F.when(F.col("_early").isNull(), F.transform(F.sequence(F.lit(0), n - 1), pool)))
    whole = F.forall("pools", lambda p: p["cov"].isNotNull() & (p["cov"] == F.size(p["bases"])) & (p["cov"] == F.size(p["quals"])))
    reason = F.coalesce("_early", F.when(~F.coalesce(whole, F.lit(False)), "codes"))
    return keep(rows, reason, REASONS, tally).drop("f", "value", "_early")


def filter_quality(rows: DataFrame, p: FilterParams = FilterParams(), n_pools: int | None = None) -> DataFrame:
    """Bases with an error above the limit become N, and N goes where ``remove_ns``; a quality below ``!`` drops the line.

    A reference in lower case, as soft-masked genomes have it, stands for its letter where
    ``keep_lowercase_reference``, and counts as N otherwise. With ``n_pools`` lines of another
    number of pools are dropped.
    """
    error = lambda q: F.pow(F.lit(10.0), -(F.ascii(q) - 33) / 10.0)
    letter = lambda b: F.upper(b) if p.keep_lowercase_reference else b
    good = lambda x: F.zip_with(x["bases"], x["quals"], lambda b, q: F.when(error(q) > p.max_base_error_rate, "N").otherwise(letter(b)))
    kept = lambda x: F.filter(good(x), lambda b: b != "N") if p.remove_ns else good(x)
    if n_pools is not None:
        rows = rows.where(F.size("pools") == n_pools)
    rows = rows.where(F.forall("pools", lambda x: F.forall(x["quals"], lambda q: F.ascii(q) >= 33)))
    pools = F.transform("pools", lambda x: F.struct(F.size(kept(x)).cast("long").alias("cov"), kept(x).alias("bases")))
    return rows.withColumns({"pools": pools, "ref": letter(F.col("ref"))})


def to_loci(rows: DataFrame) -> DataFrame:
    """``loci`` with counts in the order A, T, C, G, D, N; what is none of the others is N."""
    other = lambda b: ~b.isin(*[a for a in ALLELES if a != "N"])
    number = lambda x, a: F.size(F.filter(x["bases"], other if a == "N" else lambda b: b == a)).cast("long")
    counts = F.transform("pools", lambda x: F.array(*[number(x, a) for a in ALLELES]))
    return rows.select("chr", "pos", "ref", F.array(*[F.lit(a) for a in ALLELES]).alias("alleles"), counts.alias("counts"))


def read(spark: SparkSession, path: str, p: FilterParams = FilterParams(), n_pools: int | None = None, tally: Observation | None = None) -> DataFrame:
    return to_loci(filter_quality(parse_lines(spark.read.text(path), tally), p, n_pools))
