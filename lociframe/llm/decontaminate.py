"""Benchmark passages in documents: SimHash over item-sized windows, then exact similarity.

For a benchmark item of n words, each window of n words of a document (the whole document
where it is shorter) is a candidate place. A window's 128-bit SimHash sums one random sign
vector per five-word shingle, as often as the shingle occurs. Window and item are compared
by a multi-index: if the fingerprints differ in at most ``radius`` bits, one of their eight
16-bit blocks differs in at most radius / 8 bits, so tables of blocks, looked up with all
values so near, give all fingerprints within the radius. At similarity 0.75 two fingerprints differ in about 22 bits,
if neither side repeats a shingle; more than 40 is a chance of about 2e-5. A shingle that
repeats weighs by its count and may turn most bits, so where window or item repeat one, the
radius decides nothing: all windows are taken that hold as many of the item's shingles as the
similarity needs, and none of these is missed. What is taken is verified by the exact
weighted Jaccard similarity of the shingle counts.

Only windows that cannot reach the similarity, as they hold no shingle of any item of their
size, get no fingerprint; which item a window is compared with is for the index to say. The benchmark is a stated set of queries: it is worked off in blocks of
at most ``block_bytes`` of text, each broadcast, over all documents.

Defined cases: null text counts as empty and matches nothing; items without words match
nothing; an item of fewer than five words matches where its words stand in a row; a match
is reported once per row of documents and item, at its most similar window, the first of equals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm import text as tx
from lociframe.llm.scratch import ROW, columns, materialize, numbered, plain

_U = np.uint64
BITS, BLOCKS = 128, 8
BLOCK_BYTES = 16 << 20
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)  # set bits of each 16-bit number


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 75
    radius: int = 40
    block_bytes: int = BLOCK_BYTES


def signs(shingles: np.ndarray) -> np.ndarray:
    """A vector of 128 signs for each shingle hash."""
    halves = np.stack([tx.mix(shingles ^ _U(0x1F83D9ABFB41BD6B)), tx.mix(shingles ^ _U(0x5BE0CD19137E2179))], axis=1)
    return (np.unpackbits(halves.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Sums of signs to fingerprints of eight 16-bit blocks."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


class BlockIndex:
    """A multi-index over fingerprints: for each of the eight blocks a table from its value to the items that have it.

    Two fingerprints within ``radius`` bits have a block within radius / 8 bits. So each of a
    window's blocks is looked up with all values that are so near, by walking whichever is
    fewer: these values, or those that the table has.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.near = prints, radius, radius // BLOCKS
        self.ball = np.flatnonzero(_ONES <= self.near).astype(np.uint16)
        self.tables = []
        for b in range(BLOCKS):
            order = np.argsort(prints[:, b], kind="stable")
            values, first = np.unique(prints[order, b], return_index=True)
            self.tables.append((values, np.append(first, len(order)), order))

    def _values(self, blocks: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in ``values``) of all that are near."""
        if len(values) <= len(self.ball):
            return np.nonzero(_ONES[blocks[:, None] ^ values] <= self.near)
        asked = blocks[:, None] ^ self.ball
        place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
        w, k = np.nonzero(values[place] == asked)
        return w, place[w, k]

    def pairs(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of at most ``radius`` bits, each once."""
        found = []
        step = max(1, 1_000_000 // max(1, min(len(self.prints), len(self.ball))))
        for a in range(0, len(windows), step):
            part, keys = windows[a : a + step], []
            for b, (values, first, order) in enumerate(self.tables):
                w, v = self._values(part[:, b], values)
                n = first[v + 1] - first[v]
                ends = np.cumsum(n)
                items = order[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[v] - ends + n, n)]
                keys.append(np.repeat(w, n) * len(self.prints) + items)
            keys = np.unique(np.concatenate(keys))
            w, i = keys // len(self.prints), keys % len(self.prints)
            ok = _ONES[part[w] ^ self.prints[i]].sum(axis=1, dtype=np.int64) <= self.radius
            found.append((w[ok] + a, i[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Items:
    """Items of one number of words: ids, fingerprints, shingle counts."""

    words: int
    width: int  # words in a shingle
    ids: list[int] = field(default_factory=list)
    counts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    prints: np.ndarray | None = None
    index: BlockIndex | None = None
    shingles: np.ndarray | None = None
    owners: tuple[np.ndarray, np.ndarray] | None = None  # items that hold shingle k: owners[1][owners[0][k] : owners[0][k + 1]]
    repeats: np.ndarray | None = None  # which items repeat a shingle


def index(ids: list[int], texts: list[str | None], s: Settings) -> dict[int, Items]:
    """Items by their number of words."""
    data, offsets = tx.flat(pa.array(texts, pa.string()))
    w = tx.words(data, offsets)
    found: dict[int, Items] = {}
    for i, n in enumerate(w.counts.tolist()):
        if not n:
            continue
        group = found.setdefault(n, Items(n, min(n, s.shingle)))
        mine = w.hashes[w.first[i] : w.first[i + 1]]
        group.ids.append(ids[i])
        group.counts.append(np.unique(runs(mine, group.width), return_counts=True))
    for group in found.values():
        group.prints = fingerprints(np.stack([(signs(h) * c[:, None]).sum(axis=0) for h, c in group.counts]))
        group.index = BlockIndex(group.prints, s.radius)
        group.shingles, at = np.unique(np.concatenate([h for h, _ in group.counts]), return_inverse=True)
        item = np.repeat(np.arange(len(group.ids)), [len(h) for h, _ in group.counts])
        group.owners = np.searchsorted(np.sort(at), np.arange(len(group.shingles) + 1)), item[np.argsort(at, kind="stable")]
        group.repeats = np.array([bool((c > 1).any()) for _, c in group.counts])
    return found


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words of one text."""
    n = len(hashes) - k + 1
    total = np.full(max(n, 0), _U(k), np.uint64)
    for j in range(k if n > 0 else 0):
        total += hashes[j : j + n] * tx._PLACE[j]
    return tx.mix(total)


def similarity(a: np.ndarray, item: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sums of the smaller and of the larger counts of shingles."""
    mine, n = np.unique(a, return_counts=True)
    h, c = item
    at = np.minimum(np.searchsorted(h, mine), len(h) - 1)
    same = h[at] == mine
    both = int(np.minimum(n[same], c[at[same]]).sum())
    return both, len(a) + int(c.sum()) - both


def by_count(shingles: np.ndarray, starts: np.ndarray, size: int, group: Items, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (window, item) that share enough for the similarity, of those where either side repeats a shingle.

    ``starts`` are the windows' first shingles, ``size`` how many a window has.
    """
    values, at, n = np.unique(shingles, return_inverse=True, return_counts=True)
    later = np.full(len(shingles), np.iinfo(np.int64).max)  # where the same shingle comes next
    order = np.argsort(at, kind="stable")
    same = at[order[1:]] == at[order[:-1]]
    later[order[:-1][same]] = order[1:][same]
    repeated = np.minimum.accumulate(later[::-1])[::-1][starts] < starts + size
    if not repeated.any() and not group.repeats.any():
        return
    place = np.minimum(np.searchsorted(group.shingles, values), len(group.shingles) - 1)
    held = np.flatnonzero(group.shingles[place] == values)
    edges, items = group.owners
    few = np.diff(edges)[place[held]]
    owned = np.repeat(edges[place[held]] - np.cumsum(few) + few, few) + np.arange(few.sum())
    which, item = np.repeat(held, few), items[owned]
    total = np.bincount(item, n[which], minlength=len(group.ids))
    for i in np.flatnonzero(total):
        # both / (size + item - both) >= percent / 100; positions that hold the item's shingles are at least ``both``
        need = s.percent * (size + int(group.counts[i][1].sum()))
        if (100 + s.percent) * total[i] < need or not (group.repeats[i] or repeated.any()):
            continue
        mine = np.zeros(len(values), bool)
        mine[which[item == i]] = True
        sums = np.append(0, np.cumsum(mine[at]))
        enough = (100 + s.percent) * (sums[starts + size] - sums[starts]) >= need
        w = np.flatnonzero(enough if group.repeats[i] else enough & repeated)
        yield w, np.full(len(w), i)


def matches_of(hashes: np.ndarray, shingles: np.ndarray, hits: np.ndarray, group: Items, s: Settings) -> Iterator[tuple[int, int, int, int, float]]:
    """(item_id, start, words, distance, similarity) of one document against the items of one size.

    ``shingles`` has the document's runs of ``group.width`` words, ``hits`` where they are of an item.
    """
    n = len(hashes)
    length = min(group.words, n)
    reach = length - group.width
    edge = np.zeros(n - length + 2, np.int64)
    np.add.at(edge, np.clip(hits - reach, 0, n - length), 1)
    np.add.at(edge, np.minimum(hits, n - length) + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    low, high = starts[0], starts[-1] + reach + 1
    sums = np.zeros((high - low + 1, BITS), np.int32)
    np.cumsum(signs(shingles[low:high]), axis=0, dtype=np.int32, out=sums[1:])
    windows = fingerprints(sums[starts - low + reach + 1] - sums[starts - low])
    best: dict[int, tuple[float, int, int]] = {}
    near = [group.index.pairs(windows), *by_count(shingles[low:high], starts - low, reach + 1, group, s)]
    pairs = np.unique(np.concatenate([w * len(group.ids) + i for w, i in near]))
    for w, i in zip((pairs // len(group.ids)).tolist(), (pairs % len(group.ids)).tolist(), strict=True):
        at = int(starts[w])
        both, all_ = similarity(shingles[at : at + reach + 1], group.counts[i])
        if 100 * both >= s.percent * all_ and (i not in best or both / all_ > best[i][0]):
            best[i] = (both / all_, at, int(_ONES[windows[w] ^ group.prints[i]].sum(dtype=np.int64)))
    for i, (value, at, d) in sorted(best.items()):
        yield group.ids[i], at, length, d, value


def matches(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Places of benchmark items in whole documents.

    ``docs`` (doc_id, text) and ``benchmark`` (item_id, text) give rows of doc_id, item_id,
    start and n_words (of the window, in words from 0), distance (bits) and similarity.
    """
    items = materialize(benchmark.where("text is not null and item_id is not null").select("item_id", "text"), "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-total // s.block_bytes) if total else 1
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about block_bytes
        found = _scan(docs, index([r[0] for r in part], [r[1] for r in part], s), s)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(docs: DataFrame, groups: dict[int, Items], s: Settings) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(groups)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = sent.value
        widths: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for k in sorted({g.width for g in groups.values()}):
            known = np.unique(np.concatenate([g.shingles for g in groups.values() if g.width == k]))
            sizes: list[list[int]] = [[] for _ in known]
            for n, g in sorted(groups.items()):
                if g.width == k:
                    for at in np.searchsorted(known, g.shingles):
                        sizes[at].append(n)
            widths[k] = known, sizes
        for batch in batches:
            for cut, data, offsets in tx.slices(batch):
                rows = list(scan(cut.column(0), tx.words(data, offsets), groups, widths))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 5, pa.float64()], strict=True)],
                        names=["doc_id", "item_id", "start", "n_words", "distance", "similarity"],
                    )

    def scan(ids: pa.Array, w: tx.Words, groups: dict[int, Items], widths: dict) -> Iterator[tuple]:
        text_of = w.text_of()
        for k, (known, sizes) in widths.items():
            runs_, at = tx.sequences(w, k)
            if not len(runs_):
                continue
            place = np.minimum(np.searchsorted(known, runs_), len(known) - 1)
            hit = np.flatnonzero(known[place] == runs_)
            if not len(hit):
                continue
            doc = text_of[at[hit]]
            edges = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                d = doc[a]
                own, first = hit[a:b], w.first[d]
                of: dict[int, list[int]] = {}
                for x, p in zip((at[own] - first).tolist(), place[own].tolist(), strict=True):
                    for n in sizes[p]:
                        of.setdefault(n, []).append(x)
                low = own[0] - (at[own[0]] - first)
                shingles = runs_[low : low + w.counts[d] - k + 1]
                hashes = w.hashes[first : w.first[d + 1]]
                for n, where in sorted(of.items()):
                    for m in matches_of(hashes, shingles, np.array(where), groups[n], s):
                        yield (ids[int(d)].as_py(), *m)

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, item_id long, start long, n_words long, distance long, similarity double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, whether or not they have a doc_id."""
    rows = numbered(docs, "rows")
    found = matches(rows.select(F.col(ROW).alias("doc_id"), "text"), benchmark, s)
    found = materialize(found.select(F.col("doc_id").alias(ROW)).distinct(), "contaminated")
    found = F.broadcast(found) if found.count() <= 500_000 else found
    return rows.join(found, ROW, "left_anti").select(*columns(plain(docs)))
