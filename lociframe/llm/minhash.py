"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Each text's set of distinct five-word shingles gets a MinHash signature. Texts with the
   same set fall into one class by a 128-bit digest of the set; the class goes on as one,
   under a number of its own.
2. Bands of the signature put classes into buckets. A pair of similarity 0.75 misses all 32
   bands of 4 rows with probability 5e-6.
3. Members of a bucket are compared 64 signature bits at a time. With m of n bits equal, the
   posterior of the similarity under a uniform prior bounds the chance that it reaches the
   threshold; below ``miss`` the pair is dropped (BayesLSH; Satuluri and Parthasarathy,
   2012). What is left connects classes to clusters. Only links that keep the members of a
   bucket connected are given, one a member at most; in a bucket beyond a task's share all
   members are taken for close, which only makes clusters larger.
4. In each cluster, pairs that the bits do not rule out are confirmed on full sets, unless
   both are known to be linked already. A cluster beyond a task's share is dealt into
   blocks. First, each block meets itself and some centres of the cluster. What is then not
   in the cluster's largest component meets the whole cluster, block by block. Again only
   links that connect are given, so no step makes rows of all pairs of a group.

Defined cases: A-Z are lowered, words are runs of other characters than ASCII white space;
with fewer than five words the whole sequence is one shingle; without words or text (null)
the set is empty and linked with nothing. A doc_id may stand on several texts: each is
linked as it is, and all its rows may get different components. Rows without doc_id are
linked as others are; they count for no component's name, which is null where no row has a
doc_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm import text as tx
from lociframe.llm.components import components
from lociframe.llm.scratch import ROW, columns, materialize, numbered, plain

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    bits: int = 256
    miss: float = 1e-6
    seed: int = 3
    broadcast_rows: int = 200_000
    bucket: tuple[int, int] = (512, 4096)  # members: a task's share is within these bounds
    block: tuple[int, int] = (128 << 10, 16 << 20)  # bytes of sets
    centres: int = 16


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], s: Settings) -> np.ndarray:
    """``s.bits`` 32-bit minima for each set of 64-bit hashes; all ones for an empty set."""
    rng = np.random.default_rng(s.seed)
    factor = rng.integers(0, 1 << 31, s.bits, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, s.bits, dtype=np.uint32)
    out = np.full((len(sets), s.bits), 0xFFFFFFFF, np.uint32)
    for i, found in enumerate(sets):
        x = (found >> _U(32)).astype(np.uint32)
        for at in range(0, len(x), 512):
            part = x[at : at + 512, None] * factor
            part += shift
            np.minimum(out[i], part.min(axis=0), out=out[i])
    return out


def _pack(sig: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of the bands, and one mixed bit of each minimum in words of 64."""
    n = len(sig)
    rows = sig[:, : s.bands * s.rows].reshape(n, s.bands, s.rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(s.bands, dtype=np.uint64) + _U(1), (n, s.bands)).copy()
    for j in range(s.rows):
        keys = tx.mix(keys * _U(0x9E3779B97F4A7C15) + rows[:, :, j])
    bits = np.packbits((_mix32(sig) & np.uint32(1)).astype(np.uint8), axis=1)
    return keys.view(np.int64), np.ascontiguousarray(bits).view("<i8")


def sketch(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles, the set's digest (d1, d2), bands, bits."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, data, offsets in tx.slices(batch):
                sets = tx.shingle_sets(tx.words(data, offsets), s.shingle)
                keys, bits = _pack(signatures(sets, s), s)
                listed = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *_digests(sets), listed(keys), listed(bits)],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands", "bits"],
                )

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, bits array<long>")


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two sums of 64 bits that stand for a set."""
    first = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64)
    second = np.array([tx.mix(x ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in sets], np.uint64)
    return [pa.array(first.view(np.int64)), pa.array(second.view(np.int64))]


def full_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, d1, d2, set) for each row of ``docs`` (doc_id, text): the sorted distinct shingle hashes and their digest."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, data, offsets in tx.slices(batch):
                sets = tx.shingle_sets(tx.words(data, offsets), s.shingle)
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([cut.column(0).cast(pa.int64()), *_digests(sets), listed], names=["doc_id", "d1", "d2", "set"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, d1 long, d2 long, set array<long>")


@cache
def least_equal(s: Settings) -> list[int]:
    """For 64, 128, ... compared bits, the fewest equal ones with which a pair goes on.

    A bit is equal with chance p = (1 + J) / 2. Under a uniform J, p is uniform on [1/2, 1],
    and its posterior after m of n equal is a Beta(m + 1, n - m + 1) cut to that range.
    """
    low = (1 + s.percent / 100) / 2

    def above(m: int, n: int, x: float) -> float:  # chance that Beta(m + 1, n - m + 1) exceeds x
        return sum(comb(n + 1, k) * x**k * (1 - x) ** (n + 1 - k) for k in range(m + 1))

    out = []
    for n in range(64, s.bits + 1, 64):
        out.append(next(m for m in range(n + 1) if above(m, n, low) / above(m, n, 0.5) >= s.miss))
    return out


def survivors(bits: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs no batch of bits rules out; after the first that does, the others aren't compared."""
    at, equal = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, m in enumerate(least):
        equal = equal + 64 - np.bitwise_count((bits[left[at], k] ^ bits[right[at], k]).view(np.uint64)).astype(np.int64)
        ok = equal >= m
        at, equal = at[ok], equal[ok]
    return at


def _long(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column of lists."""
    column = table[name].combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return np.append(0, np.cumsum(column.value_lengths().to_numpy())), column.flatten().to_numpy()


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.append(np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])), len(sorted_keys)) if len(sorted_keys) else np.zeros(1, np.int64)


def _spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of the first length, then those of the second, and so on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + lengths, lengths)


def _links(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def close_in_buckets(members: pa.Table, s: Settings, chunk: int = 400_000) -> pa.Table:
    """Links (a, b) that connect the members (bucket, node, bits) of each bucket which no batch of bits tells apart."""
    least = least_equal(s)
    bucket, node = _long(members, "bucket"), _long(members, "node")
    order = np.lexsort((node, bucket))
    bucket, node, bits = bucket[order], node[order], _lists(members, "bits")[1].reshape(len(order), -1)[order]
    edges = _starts(bucket)
    later = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(node)) - 1  # members of the bucket that follow
    steps = np.append(0, np.cumsum(later))
    label = np.arange(len(node))
    at = 0
    while at < len(node):
        to = max(at + 1, int(np.searchsorted(steps, steps[at] + chunk, "right")) - 1)
        left = np.repeat(np.arange(at, to), later[at:to])
        right = _spans(np.arange(at, to) + 1, later[at:to])
        apart = np.flatnonzero(label[left] != label[right])
        left, right = left[apart], right[apart]
        kept = survivors(bits, left, right, least)
        left, right = left[kept], right[kept]
        while len(left):  # the smallest label goes from each to the other until nothing changes
            low = np.minimum(label[left], label[right])
            np.minimum.at(label, label[left], low)
            np.minimum.at(label, label[right], low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            open_ = label[left] != label[right]
            left, right = left[open_], right[open_]
        at = to
    moved = np.flatnonzero(label != np.arange(len(node)))
    pairs = np.unique(np.stack([node[moved], node[label[moved]]], axis=1), axis=0)
    return _links(pairs[:, 0], pairs[:, 1])


def link(members: pa.Table, s: Settings) -> pa.Table:
    """Links (a, b) between labels, confirmed on full sets, that connect what is similar.

    ``members`` has team, node, label, seeks, bits and set. In each team, members that seek
    meet all others of other labels: bits rule pairs out batch by batch, for the rest the
    shingles in common are counted over the lists of who holds each shingle. Once a pair is
    found similar, their labels are one and need not meet again.
    """
    least = least_equal(s)
    team, node = _long(members, "team"), _long(members, "node")
    order = np.lexsort((~_long(members, "seeks"), node, team))
    order = order[np.append(True, (np.diff(team[order]) != 0) | (np.diff(node[order]) != 0))]  # a node counts once in a team
    team, label, seeks = team[order], _long(members, "label")[order], _long(members, "seeks")[order]
    bits = _lists(members, "bits")[1].reshape(members.num_rows, -1)[order]
    bounds, shingles = _lists(members, "set")
    sizes = np.diff(bounds)[order]
    shingles = shingles[_spans(bounds[:-1][order], sizes)]
    bounds = np.append(0, np.cumsum(sizes))
    by = np.argsort(shingles, kind="stable")
    first = _starts(shingles[by])
    holders, which = np.repeat(np.arange(len(order)), sizes)[by], np.empty(len(by), np.int64)
    which[by] = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edges, found = _starts(team), []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        names, now = np.unique(label[a:b], return_inverse=True)
        given = np.arange(len(names))
        passive = ~seeks[a:b]
        for i in np.flatnonzero(seeks[a:b]):
            meets = np.flatnonzero(now != now[i])
            meets = meets[(meets > i) | passive[meets]]
            meets = meets[survivors(bits[a:b], np.full(len(meets), i), meets, least)]
            if not len(meets):
                continue
            mine = which[bounds[a + i] : bounds[a + i + 1]]
            who = holders[_spans(first[mine], first[mine + 1] - first[mine])]
            common = np.bincount(who[(who >= a) & (who < b)] - a, minlength=b - a)[meets]
            similar = meets[100 * common >= s.percent * (sizes[a + i] + sizes[a + meets] - common)]
            if len(similar):
                one = np.unique(np.append(now[similar], now[i]))
                now[np.isin(now, one)] = one[0]
                given[np.isin(given, one)] = one[0]
        moved = np.flatnonzero(given != np.arange(len(names)))
        found.append((names[moved], names[given[moved]]))
    return _links(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else _links(np.zeros(0), np.zeros(0))


def _narrow(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a materialized table of at most ``limit`` narrow rows."""
    return F.broadcast(df) if df.count() <= limit else df


def _share(docs: DataFrame, total: int, bounds: tuple[int, int]) -> int:
    """A task's share of ``total``, within bounds that hold for any input."""
    return min(max(total // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), bounds[0]), bounds[1])


def _of_hash(n: int | Column, *columns: str) -> Column:
    """A number below ``n`` by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(n))


def clusters(classes: DataFrame, s: Settings) -> DataFrame:
    """(node, cluster) of the ``classes`` (node, bands, bits) that the bits don't tell apart from all others."""
    entries = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = materialize(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = materialize(entries.join(_narrow(buckets, s.broadcast_rows), "bucket"), "members")
    total = members.count()
    share = _share(classes, total, s.bucket)
    few = members.where(F.col("n") <= share).join(classes.select("node", "bits"), "node")
    few = few.select(_of_hash(-(-total // share) or 1, "bucket").alias("bin"), "bucket", "node", "bits")
    links = few.groupBy("bin").applyInArrow(lambda t: close_in_buckets(t, s), "a long, b long")
    many = members.where(F.col("n") > share)
    least = materialize(many.groupBy("bucket").agg(F.min("node").alias("b")), "least-members")
    links = links.unionByName(many.join(_narrow(least, s.broadcast_rows), "bucket").select(F.col("node").alias("a"), "b").where("a <> b"))
    return components(materialize(links, "close")).withColumnRenamed("component", "cluster")


def links_of(docs: DataFrame, classes: DataFrame, near: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between nodes that connect what is similar in each of the clusters ``near`` (node, cluster)."""
    small = lambda df: _narrow(df, s.broadcast_rows)
    weight = 8 * F.col("n_shingles") + F.lit(4096)
    known = classes.select("node", "id", "d1", "d2", "bits", weight.alias("weight"))
    known = materialize(known.join(small(near), "node"), "clustered")
    wanted = known.select("id", "d1", "d2", "node")
    ids = materialize(wanted.select("id").distinct(), "wanted")
    texts = docs.select("doc_id", "text").join(small(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = full_sets(texts, s).join(small(wanted), ["d1", "d2"]).where(F.col("doc_id").eqNullSafe(F.col("id")))
    sets = sets.select("node", "set").dropDuplicates(["node"])
    per = materialize(known.groupBy("cluster").agg(F.sum("weight").alias("weight")), "cluster-sizes")
    total, most = per.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max("weight"), F.lit(0))).first()
    share = _share(docs, total, s.block)
    parts = lambda w: F.ceil(F.col(w) / share)
    full = known.select("node", "cluster", "bits", "weight").join(small(per.select("cluster", parts("weight").alias("parts"))), "cluster")
    full = materialize(full.join(sets, "node"), "cluster-sets")

    def met(rows: DataFrame, weight: int) -> DataFrame:
        rows = rows.withColumn("bin", _of_hash(-(-weight // share) or 1, "team"))
        return materialize(rows.groupBy("bin").applyInArrow(lambda t: link(t, s), "a long, b long"), "links")

    team = lambda *of: F.xxhash64("cluster", *of).alias("team")
    own = [F.col("node").alias("label"), F.lit(True).alias("seeks"), "bits", "set"]
    block = _of_hash(F.col("parts"), "node")
    rows = full.withColumn("part", block).select(team("part"), "node", *own)
    if most <= share:
        return met(rows, total)
    large = full.where("parts > 1")
    salt = F.pmod(F.xxhash64(F.lit(s.seed), "node"), F.lit(s.centres))
    centres = large.groupBy("cluster", salt.alias("salt")).agg(F.min("node").alias("node")).select("node")
    centres = large.join(small(materialize(centres, "centres")), "node", "left_semi")
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    found = met(rows.unionByName(centres.withColumn("part", to_all(F.col("parts"))).select(team("part"), "node", *own)), total)
    # what is not in its cluster's largest component yet meets the whole cluster
    label = components(found)
    named = large.select("node", "cluster", "weight").join(label, "node", "left").withColumn("label", F.coalesce("component", "node"))
    named = materialize(named.drop("component"), "labels")
    largest = named.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "label"))["label"].alias("largest"))
    seekers = materialize(named.join(largest, "cluster").where("label <> largest").select("node", "cluster", "weight"), "seekers")
    count = materialize(seekers.groupBy("cluster").agg(F.sum("weight").alias("w")).select("cluster", parts("w").alias("seeker_parts")), "seeker-sizes")
    size = count.join(per, "cluster").agg(F.sum(F.col("seeker_parts") * F.col("weight"))).first()[0]
    if not size:
        return found
    large = large.join(small(count), "cluster").join(named.select("node", "label"), "node")
    asks = large.join(small(seekers.select("node")), "node", "left_semi")
    asks = asks.withColumns({"a": _of_hash(F.col("seeker_parts"), "node"), "b": to_all(F.col("parts"))})
    told = large.withColumns({"b": block, "a": to_all(F.col("seeker_parts"))})
    rows = [x.select(team("a", "b"), "node", "label", F.lit(seeks).alias("seeks"), "bits", "set") for x, seeks in ((asks, True), (told, False))]
    return found.unionByName(met(rows[0].unionByName(rows[1]), size))


def duplicate_groups(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that can be reached over links of similarity
    ``s.percent`` / 100 or more.
    """
    drawn = materialize(sketch(docs, s), "sketch")
    classes = drawn.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles")
    classes = classes.agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    moved = components(links_of(docs, classes, clusters(classes, s), s))
    # names of the classes that are more than one row
    ids = classes.select("node", "d1", "d2", "n_shingles", "id", "n").join(_narrow(moved, s.broadcast_rows), "node", "left")
    ids = materialize(ids.where("n > 1 or component is not null").select("d1", "d2", "n_shingles", "id", F.coalesce("component", "node").alias("component")), "several")
    least = ids.groupBy("component").agg(F.min("id").alias("least"))
    names = materialize(ids.join(least, "component").select("d1", "d2", "n_shingles", F.struct("least").alias("name")), "names")
    rows = drawn.select("doc_id", "n_shingles", "d1", "d2").join(_narrow(names, s.broadcast_rows), ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("name").isNotNull(), F.col("name.least")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest doc_id, null last.

    Rows are told apart by numbers of their own, so rows without doc_id are linked like others,
    and of equal rows, or of rows that share a doc_id and are linked, one stays.
    """
    rows = numbered(docs, "rows")
    groups = duplicate_groups(rows.select(F.col(ROW).alias("doc_id"), "text"), s)
    groups = materialize(groups.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("component"), "kept"), "groups")
    several = groups.where("not kept").select("component").distinct()
    members = materialize(groups.join(several, "component", "left_semi").join(rows.select(ROW, "doc_id"), ROW), "group-members")
    best = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias("best"))
    best = _narrow(materialize(best, "best"), s.broadcast_rows)
    dropped = materialize(members.join(best, "component").where(F.col(ROW) != F.col("best")).select(ROW), "dropped")
    return rows.join(_narrow(dropped, s.broadcast_rows), ROW, "left_anti").select(*columns(plain(docs)))
