"""Documents packed into sequences of a fixed number of tokens, as few as can be.

Documents longer than a sequence are cut into whole sequences and a shorter first piece. The
rest is bin packing, for which the lengths are all that matters, and there are no more of them
than a sequence has tokens. So only the number of pieces of each length reaches the driver,
which plans for ranks of pieces in descending order of length, not for pieces:

1. Large lengths are put into groups of equal cardinality and rounded up to a group's largest.
2. With few sizes, the sets of sizes that fit into a sequence (configurations) are searched by
   linear programming: a basis of configurations, and a knapsack for the one that improves it.
   Rounded down, the solution says how many sequences follow each configuration.
3. Actual pieces take the places of rounded ones, each group's in order of rank. What a
   sequence then has left follows from the lengths at the ranks it holds. Those that have more
   than ``slack`` tokens left are taken apart again.
4. What the rounding left over, and small pieces, go by descending length to the sequence with
   the least room that is enough, or to a new one. Sequences with the same room and pieces of
   the same length are handled together.

The plan is a list of segments of ranks; within one, sequence and offset are linear in the
rank. Its length depends on the capacity alone. Ranks come from one sort of the pieces' rows by
length and row number over range partitions, which ties don't make uneven.

Defined cases: a null or empty text is its end id alone. Rows with a null doc_id, or that share
one, are packed each on its own. An empty table has no pieces and no sequences.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.llm.scratch import columns, materialize
from lociframe.llm.text import release
from lociframe.llm.tokens import Encoder, texts_of

ROW, PLACE = "__lociframe_row", "__lociframe_place"


@dataclass(frozen=True)
class Settings:
    """``capacity``: tokens of a sequence. Lengths above ``capacity / large`` are large. ``groups``: numbers of groups of equal cardinality; of all, the plan with the fewest sequences is taken. ``slacks``: tokens that a configured sequence may leave. ``gap``: by what share the linear program may miss its least."""

    capacity: int = 1024
    large: int = 8
    groups: tuple[int, ...] = (32, 64, 128)
    slacks: tuple[int, ...] = (2, 8, 32, 1024)
    gap: float = 1e-3


def pieces(docs: DataFrame, definition: str, end_id: int, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, and ids if asked for; and which row of ``docs`` it comes from.

    ``ids`` are little-endian unsigned 32-bit integers. A longer document's first piece has
    what whole sequences leave.
    """
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    names = ["doc_id", ROW, "piece", "start", "length", "ids_crc32", "ids"][: 6 + with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(sent.value), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], names=["i", "text"])
            for at, texts in texts_of(numbered):
                rows: list[tuple] = []
                for i, encoded in zip(at, encoder.batch(texts), strict=True):
                    encoded, start = encoded + end, 0
                    n = len(encoded) // 4
                    ends = range((n - 1) % capacity + 1, n + 1, capacity)
                    for piece, stop in enumerate(ends):
                        part = encoded[4 * start : 4 * stop]
                        rows.append((i, piece, start, stop - start, zlib.crc32(part), part))
                        start = stop
                which, *columns = zip(*rows, strict=True)
                own = batch.take(pa.array(which)).columns
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([own[0], own[2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))][: len(names)], names=names)
        encoder.rest()
        release()

    kinds = ("long", "long", "int", "long", "long", "long", "binary")
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias(ROW))
    return rows.mapInArrow(cut, schema)


class Plan:
    """Segments of ranks: first rank, length, sequence of the first, pieces a sequence, offset of a sequence's first."""

    def __init__(self, lengths: list[tuple[int, int]], capacity: int):
        """``lengths``: pairs of length and number of pieces, in descending order of length."""
        self.capacity, self.sequences = capacity, 0
        self.lengths = [x for x, _ in lengths]
        self.steps = np.cumsum([0, *(n for _, n in lengths)]).tolist()  # rank of the first piece of each length
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = {}  # sequences with so much room: first, number

    def runs(self, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """Length, first and last rank of pieces of one length among ranks ``low`` to ``high``."""
        k = bisect.bisect_right(self.steps, low) - 1
        while low < high:
            to = min(high, self.steps[k + 1])
            yield self.lengths[k], low, to
            low, k = to, k + 1

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def configured(self, starts: list[int], n: int, slack: int) -> list[tuple[int, int]]:
        """Up to ``n`` sequences, of which sequence i holds the pieces with ranks i more than each of ``starts``; returns the ranks that would leave more than ``slack``."""
        cuts = sorted({low - s for s in starts for _, low, _ in self.runs(s, s + n)} | {n})
        apart = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            lengths = [next(self.runs(s + low, s + high))[0] for s in starts]
            room = self.capacity - sum(lengths)
            if room > slack:
                apart += [(s + low, s + high) for s in starts]
                continue
            first, offset = self.new(high - low), 0
            for s, length in zip(starts, lengths, strict=True):
                self.segments.append((s + low, length, first, 1, offset))
                offset += length
            self.room.setdefault(room, []).append((first, high - low))
        return apart

    def best_fit(self, low: int, high: int) -> None:
        """Ranks ``low`` to ``high``, of one length, each to the sequence with the least room that is enough."""
        length = next(self.runs(low, high))[0]
        while low < high:
            room = min((r for r, found in self.room.items() if r >= length and found), default=None)
            if room is None:
                room = self.capacity
                each = room // length
                free = self.new(-(-(high - low) // each)), -(-(high - low) // each)
            else:
                each, free = room // length, self.room[room].pop()
            first, n = free
            whole = min(n, (high - low) // each)
            takes = [(whole, each)] if whole else [(1, high - low)]  # else one sequence takes all that is left
            for k, q in takes:
                self.segments.append((low, length, first, q, self.capacity - room))
                self.room.setdefault(room - q * length, []).append((first, k))
                low, first, n = low + k * q, first + k, n - k
            if n:
                self.room.setdefault(room, []).append((first, n))


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most that pieces of these sizes in one sequence can be worth, and how many of each these are."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    width = int(sizes.min())  # what fits into less room than this is known before
    for low in range(width, capacity + 1, width):
        rest = np.arange(low, min(low + width, capacity + 1)) - sizes[:, None]
        value = np.where(rest >= 0, best[np.maximum(rest, 0)] + worth[:, None], -np.inf)
        choice, at = value.argmax(0), slice(low, low + rest.shape[1])
        value = value[choice, np.arange(rest.shape[1])]
        best[at], last[at] = np.maximum(value, 0), np.where(value > 0, choice, -1)
    column, left = np.zeros(len(sizes)), capacity
    while last[left] >= 0:
        column[last[left]] += 1
        left -= int(sizes[last[left]])
    return best[capacity], column


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse, by elimination."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        at = k + int(np.abs(both[k:, k]).argmax())
        both[[k, at]] = both[[at, k]]
        both[k] /= both[k, k]
        others = both[:, k].copy()
        others[k] = 0
        both -= others[:, None] * both[k]
    return both[:, n:]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float) -> list[tuple[int, np.ndarray]]:
    """How many sequences hold how many pieces of each size: a solution of the linear program, rounded down.

    It is within the share ``gap`` of the least. The basis is inverted anew after every 50 steps.
    Matrices are small, and many threads for them would wait for each other beside Spark's.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)  # a configuration a column
    for step in range(60 * m):
        if step % 50 == 0:
            inverse = inverted(basis)
            used = np.maximum((inverse * demand).sum(1), 0)
        value, column = knapsack(sizes, inverse.sum(0), capacity)
        if value <= 1 + gap:
            break
        change = (inverse * column).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, used / change, np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * change, 0)
        used[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / change[out]
        inverse -= change[:, None] * row
        inverse[out] = row
    left, found = demand.astype(np.int64), []
    for j in np.argsort(-used, kind="stable"):
        column = np.rint(basis[:, j]).astype(np.int64)
        n = min([int(used[j] + 1e-6), *(left[column > 0] // column[column > 0]).tolist()])
        if n > 0:
            left = left - n * column
            found.append((n, column))
    return found


def plan(lengths: dict[int, int], settings: Settings = Settings()) -> Plan:
    """A plan for so many pieces of each length, that with the fewest sequences of those with any of ``groups`` and ``slacks``."""
    ordered, plans = sorted(lengths.items(), reverse=True), []
    for groups in settings.groups:
        sizes = grouped(ordered, groups, settings)
        found = configurations(np.array([s[0] for s in sizes]), np.array([s[2] - s[1] for s in sizes], float), settings.capacity, settings.gap) if sizes else []
        plans += [filled(ordered, sizes, found, slack, settings.capacity) for slack in settings.slacks]
    return min(plans, key=lambda p: p.sequences)


def grouped(lengths: list[tuple[int, int]], groups: int, settings: Settings) -> list[tuple[int, int, int]]:
    """Rounded length, first and last rank of each group of large pieces; whole sequences are none. Groups of one length are one."""
    steps, counts = Plan(lengths, settings.capacity), [n for x, n in lengths if settings.capacity > x > settings.capacity / settings.large]
    first = dict(lengths).get(settings.capacity, 0)
    last = first + sum(counts)
    if len(counts) <= groups:  # each length is a group of its own
        return list(steps.runs(first, last))
    each, out = -(-sum(counts) // groups), []
    for low in range(first, last, each):
        x, high = next(steps.runs(low, low + 1))[0], min(low + each, last)
        if out and out[-1][0] == x:
            low = out.pop()[1]
        out.append((x, low, high))
    return out


def filled(lengths: list[tuple[int, int]], sizes: list[tuple[int, int, int]], found: list[tuple[int, np.ndarray]], slack: int, capacity: int) -> Plan:
    """Actual pieces in the configurations' places, and the others by best fit."""
    made = Plan(lengths, capacity)
    whole = dict(lengths).get(capacity, 0)
    if whole:
        made.configured([0], whole, 0)
    at, rest = [low for _, low, _ in sizes], []
    for n, column in found:
        starts = []
        for i in np.flatnonzero(column):
            for _ in range(column[i]):
                starts.append(at[i])
                at[i] += n
        rest += made.configured(starts, n, slack)
    rest += [(low, high) for low, (_, _, high) in zip(at, sizes, strict=True)]
    rest.append((sizes[-1][2] if sizes else whole, made.steps[-1]))
    for low, high in sorted(rest):
        for _, a, b in made.runs(low, high):
            made.best_fit(a, b)
    made.segments.sort()
    return made


def pack(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset; all other columns stay.

    Sequences are numbered from 0. Their pieces lie one after the other from offset 0.
    """
    spark = found.sparkSession
    order = [F.col("length").desc(), F.xxhash64(ROW, "piece"), F.col(ROW), F.col("piece")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranked = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = materialize(ranked.withColumn(PLACE, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(PLACE, 33)  # the number of the partition; below it, the row's place there
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = ranked.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    counted = ranked.groupBy("length").count().toArrow()  # a row for each length up to the capacity
    made = plan(dict(zip(counted["length"].to_pylist(), counted["count"].to_pylist(), strict=True)), settings)
    first, length, sequence, each, offset = np.array(made.segments or [(0,) * 5], np.int64).T

    @F.pandas_udf("sequence_id long, offset long")
    def at(ranks: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(first, ranks.to_numpy(), "right") - 1
        i = ranks.to_numpy() - first[k]
        return pd.DataFrame({"sequence_id": sequence[k] + i // each[k], "offset": offset[k] + i % each[k] * length[k]})

    rank = F.col("__before") + F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))
    joined = ranked.withColumn("__part", part).join(F.broadcast(offsets.select(F.col("part").alias("__part"), F.col("before").alias("__before"))), "__part")
    return joined.withColumn("__at", at(rank)).select(*columns(found), "__at.*")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids: sequence_id, ids (little-endian unsigned 32-bit integers), and the places of documents in them.

    ``packed`` has ``ids``. A sequence holds no more tokens than the capacity.
    """
    rows = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    found = packed.groupBy("sequence_id").agg(rows.alias("rows"))
    ids = F.aggregate("rows", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return found.select("sequence_id", ids.alias("ids"), F.transform("rows", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("documents"))
