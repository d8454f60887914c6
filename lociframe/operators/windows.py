"""Sliding windows anchored at observed loci.

A window begins at a locus and reaches ``size`` bp, both ends included. The next begins at
the first locus ``slide`` bp or more after the beginning of the one before, or at the first
of the next chromosome. Windows of fewer than ``min_loci`` loci are dropped, and so is one
that ends where the one kept before it ends. The last window of the genome is kept if it
has more than one locus, or if the one before it had enough.

The chain of beginnings is sequential, but what a block of a chromosome makes of it depends
only on where the chain enters, which is one of the loci in its first ``slide`` bp or the
first after these. So each block lists where each entry leads, a small table of the blocks'
entries is walked, and each block then lays out its own windows. No task holds more loci
than a block has, plus the walk over one row per block and entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.model import WindowParams
from lociframe.sources.shared import materialize


def _leaps(pos: np.ndarray, p: WindowParams) -> np.ndarray:
    """Place of the next beginning after each locus; len(pos) where it is not among them."""
    return np.searchsorted(pos, pos + p.slide, "left")


def chain(pos: np.ndarray, entry: int, p: WindowParams) -> Iterator[int]:
    """Places of the beginnings among sorted positions, from the place ``entry`` on."""
    leap = _leaps(pos, p)
    while entry < len(pos):
        yield entry
        entry = int(leap[entry])


def sliding_windows(loci: DataFrame, p: WindowParams = WindowParams()) -> DataFrame:
    """Windows over the distinct (chr, pos) of ``loci``: chr, pos_ini, pos_fin, n_loci.

    Positions and windows, which are narrow, are written in the shared folder, as each is used several times.
    """
    block = F.floor(F.col("pos") / p.block).alias("block")
    points = loci.select("chr", "pos").where("chr is not null and pos is not null").distinct().select("chr", "pos", block)
    points = materialize(points, "positions")

    def leads(group: pd.DataFrame) -> pd.DataFrame:
        pos = np.sort(group["pos"].to_numpy())
        leap = _leaps(pos, p)
        to = np.empty(len(pos), np.int64)  # the least position at which the chain goes on, beyond the block
        for i in range(len(pos) - 1, -1, -1):
            to[i] = to[leap[i]] if leap[i] < len(pos) else pos[i] + p.slide
        n = int(np.searchsorted(pos, group["block"].iat[0] * p.block + p.slide, "left")) + 1
        return pd.DataFrame({"chr": group["chr"].iat[0], "block": group["block"].iat[0], "entry": pos[:n], "leads_to": to[:n], "last": pos[-1]})

    led = points.groupBy("chr", "block").applyInPandas(leads, "chr string, block long, entry long, leads_to long, last long")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "entry"], ignore_index=True)
        at, out = None, []
        for block, rows in group.groupby("block", sort=True):
            if at is not None and rows["last"].iat[0] < at:
                continue
            i = 0 if at is None else int(np.searchsorted(rows["entry"].to_numpy(), at, "left"))
            out.append((rows["chr"].iat[0], block, rows["entry"].iat[i]))
            at = rows["leads_to"].iat[i]
        return pd.DataFrame(out, columns=["chr", "block", "entry"])

    entries = led.groupBy("chr").applyInPandas(walk, "chr string, block long, entry long")
    # a block also needs the loci up to one window's size beyond it
    halo = points.where(F.col("pos") - F.col("block") * p.block <= p.size).select("chr", "pos", (F.col("block") - 1).alias("block"))
    laid = points.unionByName(halo).join(entries, ["chr", "block"])

    def lay(group: pd.DataFrame) -> pd.DataFrame:
        pos = np.sort(group["pos"].to_numpy())
        end = (group["block"].iat[0] + 1) * p.block
        starts = np.array([i for i in chain(pos, int(np.searchsorted(pos, group["entry"].iat[0])), p) if pos[i] < end], np.int64)
        tails = np.searchsorted(pos, pos[starts] + p.size, "right") - 1
        return pd.DataFrame({"chr": group["chr"].iat[0], "pos_ini": pos[starts], "pos_fin": pos[tails], "n_loci": tails - starts + 1})

    made = materialize(laid.groupBy("chr", "block").applyInPandas(lay, "chr string, pos_ini long, pos_fin long, n_loci long"), "windows-laid")
    final = points.agg(F.max(F.struct("chr", "pos")).alias("end"))  # one row
    made = made.crossJoin(F.broadcast(final))
    in_chr = Window.partitionBy("chr").orderBy("pos_ini")
    on_last = F.col("chr") == F.col("end.chr")
    made = made.withColumns({"before_fin": F.lag("pos_fin").over(in_chr), "before_n": F.lag("n_loci").over(in_chr)})
    made = made.where(~(on_last & F.coalesce(F.col("before_fin") == F.col("end.pos"), F.lit(False))))
    is_final = on_last & (F.col("pos_fin") == F.col("end.pos"))
    # a last chromosome of one locus: what came before it is on another chromosome
    ends = made.groupBy("chr").agg(F.max_by("n_loci", "pos_ini").alias("n"), F.first("end.chr").alias("last_chr")).where("chr < last_chr")
    earlier = ends.agg(F.max_by("n", "chr").alias("n_earlier"))
    made = made.crossJoin(F.broadcast(earlier))
    before = F.coalesce("before_n", "n_earlier")
    keep = (F.col("n_loci") >= p.min_loci) | (is_final & ((F.col("n_loci") > 1) | before.isNull() | (before >= p.min_loci)))
    kept = made.where(keep).withColumn("kept_fin", F.lag("pos_fin").over(in_chr))
    return materialize(kept.where("kept_fin is null or kept_fin <> pos_fin").select("chr", "pos_ini", "pos_fin", "n_loci"), "windows")


def in_windows(values: DataFrame, windows: DataFrame, p: WindowParams) -> DataFrame:
    """Rows of ``values`` (chr, pos, ...) once for each window that holds them, with pos_ini and pos_fin.

    Positions and windows meet in bins of one window's size, of which a window touches two at most.
    """
    bins = F.explode(F.sequence(F.floor(F.col("pos_ini") / p.size), F.floor(F.col("pos_fin") / p.size)))
    binned = windows.select("chr", "pos_ini", "pos_fin", bins.alias("bin"))
    return values.withColumn("bin", F.floor(F.col("pos") / p.size)).join(binned, ["chr", "bin"]).where("pos between pos_ini and pos_fin").drop("bin")
