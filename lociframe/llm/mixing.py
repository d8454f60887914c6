"""Mixing sources to target weights by pivotal dependent rounding.

Each source is to give a target number of words; a document of it should be copied
target / source size times on average. The whole part of that is certain. The fractional
parts are settled by dependent rounding: two documents' fractions are paired, and words
move from one to the other, in a random direction with odds that keep the expectation,
until one fraction is 0 or 1. The other goes on to the next pair. Words are conserved in
each step, so a source misses its target by half a document at most.

The pairing is a reduction tree: documents fall by hash into chunks of about ``chunk``,
each chunk leaves at most one fraction, and these meet in chunks of chunks until a source
has one left, which goes to the nearer side. All random numbers come from the seed,
the source and the chunk, and rows are put in order first, so reruns agree.

Defined cases: null text has size 0; documents of size 0 are taken as 0 words; a source
without words has target 0; null is a source of its own, last in order; equal rows are taken
each on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.llm.scratch import materialize
from lociframe.llm.text import WORD

#: Rows of the per-source table up to which it is broadcast.
BROADCAST_SOURCES = 100_000


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round the fractions ``p`` to 0 or 1, but for one at most, keeping the sum of p * size."""
    p = p.astype(np.float64).copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    while len(open_) > 1:
        i, j = open_[0 : len(open_) - 1 : 2], open_[1::2]
        odd = open_[len(open_) - 1 :] if len(open_) % 2 else open_[:0]
        to_i = np.minimum((1 - p[i]) * size[i], p[j] * size[j])
        to_j = np.minimum(p[i] * size[i], (1 - p[j]) * size[j])
        up = rng.random(len(i)) * (to_i + to_j) < to_j
        fills = np.where(up, (1 - p[i]) * size[i] <= p[j] * size[j], (1 - p[j]) * size[j] <= p[i] * size[i])
        gain, lose = np.where(up, i, j), np.where(up, j, i)
        moved = np.where(up, to_i, to_j)
        gained, lost = p[gain] + moved / size[gain], p[lose] - moved / size[lose]
        p[gain] = np.where(fills, 1.0, np.clip(gained, 0, 1))
        p[lose] = np.where(fills, np.clip(lost, 0, 1), 0.0)
        rest = np.where(fills, lose, gain)
        rest = rest[(p[rest] > 1e-12) & (p[rest] < 1 - 1e-12)]
        open_ = np.concatenate([rest, odd])
    near = np.abs(p - np.rint(p)) <= 1e-12
    p[near] = np.rint(p[near])
    return p


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source: rank by code point (null last), source_size and target.

    Weights repeat over the ranks. Targets share ``share`` of all words by weight, none above
    ``cap`` times its source; what a capped source leaves goes to the others by weight, over
    and over until none is above. Sources may be many: they are ranked in ranges, and each
    round of sharing is one sum over them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranges = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("source").asc_nulls_last()
    per = materialize(per.repartitionByRange(ranges, by).withColumn("range", F.spark_partition_id()), "sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    lower = per.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lower"))
    rank = F.col("lower") + F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int") + 1)
    per = per.join(F.broadcast(lower), "range").withColumn("rank", rank).withColumn("weight", weight).drop("range", "lower")
    per = materialize(per, "ranked")
    total = float(share) * (per.agg(F.sum("source_size")).first()[0] or 0)
    limit, level, n = F.col("source_size") * float(cap), 0.0, -1
    while True:
        full = F.col("weight") * level >= limit if n >= 0 else F.lit(False)
        held, free, count = per.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if count == n:
            break
        n, level = count, (total - (held or 0.0)) / free if free else float("inf")
    target = F.least(F.col("weight") * level, limit)
    return per.select("source", "rank", "n_docs", "source_size", target.alias("target"))


def _settle(frame: DataFrame, seed: int, level: int) -> DataFrame:
    """Pivot within each (rank, chunk). Rows: rank, chunk, key, doc_id, size, p."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "size"], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, level, int(group["rank"].iat[0]), int(group["chunk"].iat[0])])
        group["p"] = pivot(group["p"].to_numpy(), group["size"].to_numpy(np.float64), rng)
        return group

    return frame.groupBy("rank", "chunk").applyInPandas(one, frame.schema)


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, chunk: int = 4096, fan_in: int = 64,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, copies, taken, and the columns ``carry``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("hash"), *carry)
    sizes = materialize(sizes, "sizes")
    per = materialize(targets(sizes, weights, share, cap), "targets")
    top = per.agg(F.count("*"), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    small = F.broadcast(per) if top[0] <= BROADCAST_SOURCES else per
    joined = sizes.join(small, sizes["source"].eqNullSafe(per["source"])).drop(sizes["source"])
    copies = F.least(F.try_divide("target", "source_size"), F.lit(float(cap)))
    copies = F.when(F.col("size") > 0, copies).otherwise(0.0)
    near = F.when(F.abs(copies - F.round(copies)) < 1e-9, F.round(copies)).otherwise(copies)
    whole = F.floor(near)
    key = F.xxhash64(F.lit(seed), "doc_id", "hash", *carry)
    rows = joined.select(
        "doc_id", "size", "source_size", "target", "rank", whole.cast("long").alias("whole"), (near - whole).alias("p"), key.alias("key"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "hash", *carry), F.ceil(F.col("n_docs") / chunk)).alias("chunk"), *carry,
    )
    columns = ["rank", "chunk", "key", "doc_id", "size", "p", "whole", "source_size", "target", *carry]
    settled = materialize(_settle(rows.where("p > 0").select(*columns), seed, 0), "settled")
    open_ = settled.where("p > 0 and p < 1").select("rank", "chunk", "key", "doc_id", "size", "p", F.col("chunk").alias("leaf"))
    done, level, widest = None, 0, -(-top[1] // chunk)
    while True:
        level += 1
        widest = -(-widest // fan_in)
        open_ = materialize(_settle(open_.withColumn("chunk", F.floor(F.col("chunk") / fan_in)), seed, level), f"level{level}")
        shut = open_.where("p = 0 or p = 1").select("rank", "leaf", "p")
        done = shut if done is None else done.unionByName(shut)
        open_ = open_.where("p > 0 and p < 1")
        if widest <= 1:
            break
    # the last fraction of each source goes to the nearer side, at most half a document from the target
    done = done.unionByName(open_.select("rank", "leaf", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0).alias("p")))
    done = materialize(done.withColumnRenamed("leaf", "chunk").withColumnRenamed("p", "last"), "rests")
    few = done.count() <= BROADCAST_SOURCES * 10
    fixed = settled.where("p = 0 or p = 1").withColumn("last", F.col("p"))
    rest = settled.where("p > 0 and p < 1").join(F.broadcast(done) if few else done, ["rank", "chunk"])
    out = fixed.unionByName(rest).withColumn("whole", F.col("whole") + F.col("last").cast("long")).select("doc_id", "size", "source_size", "target", "whole", *carry)
    out = out.unionByName(rows.where("not (p > 0)").select("doc_id", "size", "source_size", "target", "whole", *carry))
    return out.select("doc_id", "size", "source_size", "target", F.col("whole").alias("copies"), (F.col("whole") * F.col("size")).alias("taken"), *carry)
