"""Interpolated modified Kneser-Ney language model of words, counted in Spark.

Counting: each task counts the words, then the pairs, of a few MB of text at a time, sorts
them and sends them out compressed, one blob a part; parts are ranges of a mixed hash, so no
word or pair, however frequent, makes one larger. There are ``MOST_PARTS`` of them at most,
so blobs grow in proportion to the text, and workers map a bounded number of files. A part's
task reads its blobs as a stream, keeps what exceeds ``MERGED`` keys in sorted runs in a
temporary file of its own, and writes sorted arrays into the shared folder:

* ``words``: hash, count, and beside it how many different words come before the word, and
  how many of its followers were seen once, twice, or more;
* ``pairs``: mixed key (ids of both words) and count;
* with order 3, ``triples``: mixed key (the pair's place among all pairs, the third word's id)
  and count, and beside each pair how many different words come before it, and how many of
  its followers were seen once, twice, or more.

Counts of pairs and triples take one byte; those of 255 and more are listed beside them.
Shuffle files and tables of blobs go as soon as the arrays made of them are written.

Scoring: workers map these files into memory and look words and pairs up by binary search,
in sorted order. With c a count, p(v | u) = (c(uv) - D(c(uv))) / c(u) + g(u) p(v), where
D1, D2, D3+ come from the counts of counts, g(u) is what the discounts took from u, and p(v)
is discounted in the same way from the number of different words before v, over a uniform
share for a word never seen. A word never seen as a context gives p(v) alone. With order 3
the same holds for p(w | uv) over p(w | v), whose counts are then the numbers of different
words before vw (but the count itself where v is what is before a text's first word, as
nothing comes before that); a text's first word has the pair alone.

Defined cases: null text counts as empty and has the end token only; without training rows
every token gets the uniform share.
"""

from __future__ import annotations

import mmap
import sys
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm import text as tx
from lociframe.llm.scratch import discard, filesystem, materialize, new_path

_U = np.uint64
#: Hashes that stand for the end of a text, and for what is before its first word.
END, START = _U(0xE4D0F7E875A11CE5), _U(0x57A2700000000001)
CHUNK_TOKENS = 700_000
LEAST_WORD_PARTS = 16
#: Parts of words, of pairs and of triples, each of which workers map as one file, or two.
MOST_PARTS = 256
#: Keys that a part's task sums up and writes at a time.
MERGED = 1 << 20
#: Ids of words, and places of pairs, have 32 bits of a key.
MOST_IDS = 1 << 32
#: Beside each word: how many words come before it and how many follow once, twice or more (fewer than ``MOST_IDS``), and a sum of counts.
STATS = ("<u4", "<u4", "<u4", "<u4", "<u8")
PAIRS_IN_PART = 1_000_000
ORDER = 3


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys and their counts, byte planes of the differences compressed; counts take 4 bytes where that is enough."""
    width = 4 if not len(counts) or int(counts.max()) < 1 << 32 else 8
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(keys), -1).T).tobytes() for x in (np.diff(keys, prepend=_U(0)), counts.astype(f"<u{width}"))]
    return np.array([len(keys), width], "<u8").tobytes() + zstandard.compress(b"".join(planes), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    raw = np.frombuffer(zstandard.decompress(blob[16:], max_output_size=(8 + width) * n), np.uint8)
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    return keys, np.ascontiguousarray(raw[8 * n :].reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of equal keys, in the order of the keys."""
    keys = np.concatenate([k for k, _ in held])
    counts = np.concatenate([c for _, c in held])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def merged(blobs: Iterator[bytes], mixed: bool, most: int = MERGED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of the counts of equal keys of any number of blobs, in the order of the keys (``mixed``: of what ``tx.mix`` makes of them, which is given).

    They come in pieces of about ``most`` keys. What has more waits in sorted runs in a file of the task.
    """
    held, size, spilled = [], 0, []
    with tempfile.TemporaryFile() as spill:
        for blob in blobs:
            keys, n = unpack(blob)
            held.append((tx.mix(keys) if mixed else keys, n))
            size += len(keys)
            if size >= most:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > most // 2:
                    for x in held[0]:
                        spill.write(x.data)
                    spilled.append(size)
                    held, size = [], 0
        runs = [_summed(held)] if held else []
        if not spilled:
            yield from runs
            return
        spill.flush()
        flat = np.memmap(spill, np.uint64, "r")
        for n, end in zip(spilled, 2 * np.cumsum(spilled), strict=True):
            runs.append((flat[end - 2 * n : end - n], flat[end - n : end].view(np.int64)))
        low, high = min(int(k[0]) for k, _ in runs), max(int(k[-1]) for k, _ in runs) + 1
        pieces = -(-sum(len(k) for k, _ in runs) // most)  # keys are hashes, so equal ranges hold about as many
        inner = np.array([low + (high - low) * j // pieces for j in range(1, pieces)], np.uint64)
        cuts = [[0, *np.searchsorted(k, inner).tolist(), len(k)] for k, _ in runs]
        for j in range(pieces):
            part = [(k[c[j] : c[j + 1]], n[c[j] : c[j + 1]]) for (k, n), c in zip(runs, cuts, strict=True) if c[j] < c[j + 1]]
            if part:
                yield _summed(part)


def tokens(w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text with the end token after them, and where each text begins."""
    n = len(w.counts)
    out = np.empty(len(w.hashes) + n, np.uint64)
    first = w.first[:-1] + np.arange(n)
    ends = w.first[1:] + np.arange(n)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = w.hashes
    out[ends] = END
    return out, first


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Tokens of about ``CHUNK_TOKENS`` of the texts, and where each text begins."""
    held, size = [], 0
    for batch in batches:
        for cut, data, offsets in tx.slices(batch):
            held.append((cut, *tokens(tx.words(data, offsets))))
            size += len(held[-1][1])
            if size >= CHUNK_TOKENS:
                yield _joined(held)
                held, size = [], 0
                tx.release()
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]:
    base = np.cumsum([0, *(len(t) for _, t, _ in held)])
    return [c for c, _, _ in held], np.concatenate([t for _, t, _ in held]), np.concatenate([f + b for (_, _, f), b in zip(held, base[:-1], strict=True)])


def _part(mixed: np.ndarray, parts: int) -> np.ndarray:
    """The range of a mixed 64-bit key among ``parts`` equal ones."""
    return ((mixed >> _U(32)) * _U(parts)) >> _U(32)


def _blobs(keys: np.ndarray, counts: np.ndarray, parts: int, mixed: bool) -> pa.RecordBatch:
    part = _part(tx.mix(keys) if mixed else keys, parts)
    order = np.argsort(part, kind="stable")
    keys, counts, part = keys[order], counts[order], part[order]
    edges = np.append(np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1)), len(part))
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(part[a]) for a, _ in spans], pa.int64()), pa.array([pack(keys[a:b], counts[a:b]) for a, b in spans], pa.binary())], names=["part", "blob"]
    )


#: A map needs no file descriptor, of which a process has few.
_MAPPED = {"access": mmap.ACCESS_READ} | ({"trackfd": False} if sys.version_info >= (3, 13) else {})


class Reader:
    """Arrays of a file one after the other, mapped into memory where the folder is mounted, else read."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.offset = 0
        if isinstance(fs, pafs.LocalFileSystem):
            with open(at, "rb") as f:
                self.raw = mmap.mmap(f.fileno(), 0, **_MAPPED)
        else:
            with fs.open_input_stream(at) as f:
                self.raw = f.read()

    def __call__(self, dtype: str, n: int) -> np.ndarray:
        at, self.offset = self.offset, self.offset + n * np.dtype(dtype).itemsize
        return np.frombuffer(self.raw, dtype, n, at) if n else np.zeros(0, dtype)


def load(path: str, n: int, *dtypes: str) -> list[np.ndarray]:
    """Arrays of ``n`` entries each."""
    read = Reader(path)
    return [read(dtype, n) for dtype in dtypes]


class Counted:
    """Sorted keys with counts: one byte each, and beside them the counts of 255 and more by their places."""

    def __init__(self, path: str, n: int):
        read = Reader(path)
        many = (len(read.raw) - 9 * n) // 16
        self.keys, self.places, self.large, self.small = read("<u8", n), read("<u8", many), read("<u8", many), read("u1", n)

    def counts(self, at: np.ndarray) -> np.ndarray:
        out = self.small[at].astype(np.int64)
        high = np.flatnonzero(out == 255)
        if len(high):
            out[high] = self.large[np.searchsorted(self.places, at[high].astype(np.uint64))]
        return out


class Output:
    """A file that no other attempt writes; arrays go to it one after the other, small or large."""

    def __init__(self, folder: str, name: str):
        self.path = f"{folder}/{name}-{uuid.uuid4().hex}.bin"
        fs, at = filesystem(self.path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.stream = fs.open_output_stream(at)

    def __enter__(self) -> Output:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()

    def write(self, a: np.ndarray) -> None:
        self.stream.write(np.ascontiguousarray(a).tobytes())


class CountedOutput(Output):
    """Writes what ``Counted`` reads, a piece of sorted keys at a time; ``of_counts`` says how many have the count 1, 2, 3 and 4."""

    def __init__(self, folder: str, name: str):
        super().__init__(folder, name)
        self.n, self.of_counts = 0, np.zeros(4, np.int64)
        self.places, self.large, self.small = [], [], []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.write(keys.astype("<u8"))
        large = np.flatnonzero(counts >= 255)
        self.places.append((large + self.n).astype("<u8"))
        self.large.append(counts[large].astype("<u8"))
        self.small.append(np.minimum(counts, 255).astype("u1"))
        self.of_counts += _of_counts(counts)
        self.n += len(keys)

    def __exit__(self, *_) -> None:
        for a in (*self.places, *self.large, *self.small):
            self.write(a)
        super().__exit__()


def _of_counts(counts: np.ndarray) -> np.ndarray:
    """How many of the counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the model's totals. Paths go by part; ``starts`` are ids of the parts' first words."""

    words: list[tuple[str, int]]
    stats: list[str]
    pairs: list[tuple[str, int]]
    starts: list[int]
    n_tokens: int
    n_types: int
    n_pairs: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    triples: list[tuple[str, int]] | None = None
    pair_stats: list[tuple[str, int]] | None = None  # by part of the pairs: its file, how many large numbers are there
    triple_discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many have the count 1, 2, 3 and 4; absolute 0.5 where these don't suffice."""
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True))


class Words:
    """The mapped word arrays."""

    def __init__(self, words: list[tuple[str, int]], starts: list[int], stats: list[str] | None = None):
        self.starts = np.array(starts, np.int64)
        self.keys = [load(p, n, "<u8", "<u8") if n else None for p, n in words]
        self.stats = [load(p, n, *STATS) if n else None for p, (_, n) in zip(stats, words, strict=True)] if stats else None

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        part = _part(hashes, len(self.keys)).astype(np.int64)
        edges = np.searchsorted(part, np.arange(len(self.keys) + 1))
        for k, found in enumerate(self.keys):
            a, b = edges[k], edges[k + 1]
            if found is None or a == b:
                continue
            keys, n = found
            at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
            ok = keys[at] == hashes[a:b]
            ids[a:b] = np.where(ok, at + self.starts[k], -1)
            counts[a:b] = np.where(ok, n[at].astype(np.int64), 0)
        return ids, counts

    def stat(self, ids: np.ndarray) -> np.ndarray:
        """Rows (words before, followers seen once, twice, more, sum of their counts) of sorted ids; zeros for -1."""
        out = np.zeros((5, len(ids)), np.int64)
        edges = np.searchsorted(ids, np.append(self.starts, np.iinfo(np.int64).max))
        for k, found in enumerate(self.stats):
            a, b = edges[k], edges[k + 1]
            if found is not None and b > a:
                for j in range(5):
                    out[j, a:b] = found[j][ids[a:b] - self.starts[k]]
        return out


class Pairs:
    """The mapped arrays of pairs; a pair's place counts through all parts."""

    def __init__(self, pairs: list[tuple[str, int]], stats: list[tuple[str, int]] | None = None):
        self.starts = np.append(0, np.cumsum([n for _, n in pairs])).astype(np.int64)
        self.arrays = [Counted(p, n) if n else None for p, n in pairs]
        self.stats = [self._stats(p, n, many) if n else None for (p, many), (_, n) in zip(stats, pairs, strict=True)] if stats else None

    @staticmethod
    def _stats(path: str, n: int, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Four numbers of each pair in a byte each, and places and values of those of 255 and more."""
        read = Reader(path)
        small = read("u1", 4 * n).reshape(n, 4)
        read("u1", -4 * n % 8)
        return small, read("<u8", many), read("<u8", many)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (-1: unknown) and counts of distinct keys."""
        mixed = tx.mix(keys)
        order = np.argsort(mixed)
        mixed = mixed[order]
        place, got = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        edges = np.searchsorted(_part(mixed, len(self.arrays)).astype(np.int64), np.arange(len(self.arrays) + 1))
        for k, found in enumerate(self.arrays):
            a, b = edges[k], edges[k + 1]
            if found is None or a == b:
                continue
            at = np.minimum(np.searchsorted(found.keys, mixed[a:b]), len(found.keys) - 1)
            ok = np.flatnonzero(found.keys[at] == mixed[a:b])
            place[a + ok], got[a + ok] = at[ok] + self.starts[k], found.counts(at[ok])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return place[back], got[back]

    def keys(self, places: np.ndarray) -> np.ndarray:
        """Keys of sorted places."""
        out = np.empty(len(places), np.uint64)
        edges = np.searchsorted(places, self.starts)
        for k, found in enumerate(self.arrays):
            if edges[k] < edges[k + 1]:
                out[edges[k] : edges[k + 1]] = found.keys[places[edges[k] : edges[k + 1]] - self.starts[k]]
        return unmix(out)

    def stat(self, places: np.ndarray) -> np.ndarray:
        """Rows (adjusted count, followers seen once, twice, more) of places; zeros for -1."""
        order = np.argsort(places, kind="stable")
        ids = places[order]
        got = np.zeros((4, len(ids)), np.int64)
        edges = np.searchsorted(ids, self.starts)
        for k, found in enumerate(self.stats):
            a, b = edges[k], edges[k + 1]
            if found is None or a == b:
                continue
            small, keys, values = found
            local = ids[a:b] - self.starts[k]
            got[:, a:b] = small[local].T
            for j in range(4):
                high = np.flatnonzero(got[j, a:b] == 255)
                if len(high):
                    got[j, a + high] = values[np.searchsorted(keys, (local[high] * 4 + j).astype(np.uint64))]
        out = np.empty_like(got)
        out[:, order] = got
        return out


_INVERSE = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``tx.mix`` made ``x`` of."""
    x = x ^ (x >> _U(32))
    x = x * _INVERSE
    x = x ^ (x >> _U(32))
    x = x * _INVERSE
    return x ^ (x >> _U(32))


#: What tasks tell of the parts of words, of pairs and of triples (kind 0), and send to them (kinds from 1).
TOLD = "kind long, part long, path string, n long, counts array<long>, blob binary"
_TOLD = pa.schema({"kind": pa.int64(), "part": pa.int64(), "path": pa.string(), "n": pa.int64(), "counts": pa.list_(pa.field("element", pa.int64())), "blob": pa.binary()})


def _told(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _TOLD)


def _written(part: int, path: str, n: int, counts: np.ndarray) -> pa.RecordBatch:
    return _told([{"kind": 0, "part": part, "path": path, "n": n, "counts": counts.tolist(), "blob": None}])


def _column(batches: Iterator[pa.RecordBatch], name: str = "blob") -> Iterator:
    """A column's values, one after the other."""
    for batch in batches:
        for x in batch.column(name):
            yield x.as_py()


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kind, ids and numbers of each row that brings some."""
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
            if kind:
                ids, times = unpack(blob.as_py())
                yield kind, ids.astype(np.int64), times


def _ranges(kind: int, keys: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> list[dict]:
    """Rows with what falls between the edges, one blob a part; ``keys`` are sorted and distinct."""
    cut = np.searchsorted(keys, edges)
    return [
        {"kind": kind, "part": k, "path": None, "n": 0, "counts": None, "blob": pack(keys[cut[k] : cut[k + 1]].astype(np.uint64), counts[cut[k] : cut[k + 1]])}
        for k in range(len(edges) - 1)
        if cut[k] < cut[k + 1]
    ]


def _followers(context: np.ndarray, n: np.ndarray, edges: np.ndarray) -> list[dict]:
    """Rows of kinds 2 to 4: how many followers of each context have the count 1, 2, or more."""
    return [r for j, chosen in enumerate((n == 1, n == 2, n > 2)) for r in _ranges(2 + j, *np.unique(context[chosen], return_counts=True), edges)]


def _pairs(all_tokens: np.ndarray, first: np.ndarray, known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, each token's place in them, and ids of each token and of the one before it."""
    hashes, at = np.unique(np.append(all_tokens, START), return_inverse=True)
    ids, counts = known.find(hashes)
    before = np.empty(len(all_tokens), np.int64)
    before[1:] = at[: len(all_tokens) - 1]
    before[first] = at[-1]
    return ids, counts, at[:-1], before


def _few_enough(n: int, what: str) -> None:
    if n >= MOST_IDS:
        raise ValueError(f"{n} {what} are more than keys of this layout tell apart")


def count(train: DataFrame, folder: str, word_parts: int | None = None, pairs_in_part: int = PAIRS_IN_PART, order: int = 2, at_once: int = MERGED) -> Model:
    """Count ``train`` (text) and write the arrays below ``folder``; ``order`` is 2 or 3.

    There are two parts of words for each partition of ``train``, and one of pairs for each
    ``pairs_in_part`` tokens, up to ``MOST_PARTS``; a part's task sums up and writes ``at_once``
    keys at a time. More than 2**32 different words, or with order 3 pairs, are an error.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    word_parts = word_parts or min(MOST_PARTS, max(LEAST_WORD_PARTS, 2 * train.rdd.getNumPartitions()))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, all_tokens, first in chunks(batches):
            keys, n = np.unique(np.append(all_tokens, np.full(len(first), START)), return_counts=True)
            yield _blobs(keys, n, word_parts, False)

    def write_words(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = total = texts = 0
        counts = []
        with Output(folder, "words") as out:
            for keys, n in merged(_column(batches), False, at_once):
                out.write(keys.astype("<u8"))
                counts.append(n.astype("<u8"))
                size, total, texts = size + len(keys), total + int(n.sum()), texts + int(n[keys == START].sum())
            for n in counts:
                out.write(n)
        tx.release()
        yield pa.RecordBatch.from_pydict({"part": [key[0].as_py()], "path": [out.path], "n": [size], "total": [total - texts], "texts": [texts]})

    text = train.select("text")
    words = text.mapInArrow(count_words, "part long, blob binary").groupBy("part").applyInArrow(write_words, "part long, path string, n long, total long, texts long")
    found = {r.part: r for r in materialize(words, "words", release=True).collect()}  # one row a part
    files = [(found[k].path, found[k].n) if k in found else ("", 0) for k in range(word_parts)]
    starts = [0, *np.cumsum([n for _, n in files]).tolist()][:-1]
    n_tokens, n_types = sum(r.total for r in found.values()), max(0, sum(r.n for r in found.values()) - 1)
    _few_enough(n_types + 1, "words")
    pair_parts = min(MOST_PARTS, max(8, -(-n_tokens // pairs_in_part)))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(files, starts)
        for _, all_tokens, first in chunks(batches):
            ids, _, at, before = _pairs(all_tokens, first, known)
            keys = (ids[before].astype(np.uint64) << _U(32)) | ids[at].astype(np.uint64)
            yield _blobs(*np.unique(keys, return_counts=True), pair_parts, True)

    edges = np.array([*starts, np.iinfo(np.int64).max])

    def write_pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with CountedOutput(folder, "pairs") as out:
            for mixed, n in merged(_column(batches), True, at_once):
                out.add(mixed, n)
                keys = unmix(mixed)
                before, after = (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64)
                rows = _ranges(1, *np.unique(after, return_counts=True), edges)
                if order == 2:
                    rows += _followers(before, n, edges)
                yield _told(rows)
                tx.release()
        yield _written(key[0].as_py(), out.path, out.n, out.of_counts)

    pairs = text.mapInArrow(count_pairs, "part long, blob binary").groupBy("part").applyInArrow(write_pairs, TOLD)
    scratch = [new_path(train.sparkSession, "pairs")]
    pairs = materialize(pairs, "pairs", scratch[0], release=True)
    done = {r.part: r for r in pairs.where("kind = 0").select("part", "path", "n", "counts").collect()}  # one row a part
    pair_files = [(done[k].path, done[k].n) if k in done else ("", 0) for k in range(pair_parts)]
    of_counts = np.sum([r.counts for r in done.values()], axis=0).tolist() if done else [0] * 4
    longer, told = {}, pairs
    if order == 3:
        scratch.append(new_path(train.sparkSession, "pair-stats"))
        longer, told, of_counts = _count_triples(text, folder, scratch[1], files, starts, edges, pair_files, at_once)
        told = pairs.where("kind = 1").unionByName(told)

    def write_stats(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        arrays = [np.zeros(files[part][1], x) for x in STATS]
        if order == 2:  # the sum of the followers' counts is the word's own
            arrays[4][:] = load(*files[part], "<u8", "<u8")[1]
        for kind, ids, times in _numbers(batches):
            a = arrays[kind - 1]
            a[ids - starts[part]] += times.astype(a.dtype)
        with Output(folder, "stats") as out:
            for a in arrays:
                out.write(a)
        tx.release()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [out.path], "counts": [_of_counts(arrays[0]).tolist()]}, schema=pa.schema([_TOLD.field(x) for x in ("part", "path", "counts")]))

    stats = told.where("kind > 0").groupBy("part").applyInArrow(write_stats, "part long, path string, counts array<long>")
    written = {r.part: r for r in materialize(stats, "stats", release=True).collect()}  # one row a part
    for path in scratch:
        discard(path)
    word_counts = np.sum([r.counts for r in written.values()], axis=0).tolist() if written else [0] * 4
    return Model(files, [written[k].path if k in written else "" for k in range(word_parts)], pair_files, starts, n_tokens, n_types, sum(n for _, n in pair_files), discounts(of_counts), discounts(word_counts), **longer)


def _count_triples(
    text: DataFrame, folder: str, path: str, files: list[tuple[str, int]], starts: list[int], edges: np.ndarray, pair_files: list[tuple[str, int]], at_once: int
) -> tuple[dict, DataFrame, list[int]]:
    """Count runs of three words and write them, and what they tell of pairs.

    Gives the model's fields, rows of kinds 2 to 5 about words as contexts (a table at ``path``),
    and the counts of the pairs' adjusted counts.
    """
    parts, pair_edges = min(MOST_PARTS, 2 * len(pair_files)), np.append(0, np.cumsum([n for _, n in pair_files]))
    _few_enough(int(pair_edges[-1]), "pairs")
    cuts = np.append(pair_edges[:-1], np.iinfo(np.int64).max)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, two = Words(files, starts), Pairs(pair_files)
        for _, all_tokens, first in chunks(batches):
            ids, _, at, before = _pairs(all_tokens, first, known)
            context, inner = _contexts(two, ids, at, before, first)[:2]
            keys, n = np.unique((context[inner].astype(np.uint64) << _U(32)) | ids[at[inner]].astype(np.uint64), return_counts=True)
            if len(keys):
                yield _blobs(keys, n, parts, True)

    def write_triples(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = Pairs(pair_files)
        with CountedOutput(folder, "triples") as out:
            for mixed, n in merged(_column(batches), True, at_once):
                out.add(mixed, n)
                keys = unmix(mixed)
                by = np.argsort(keys)
                keys, n = keys[by], n[by]
                context = (keys >> _U(32)).astype(np.int64)
                last, times = np.unique((two.keys(context) << _U(32)) | (keys & _U(0xFFFFFFFF)), return_counts=True)
                place = two.find(last)[0]
                by = np.argsort(place)
                yield _told(_ranges(1, place[by], times[by], cuts) + _followers(context, n, cuts))
                tx.release()
        yield _written(key[0].as_py(), out.path, out.n, out.of_counts)

    scratch = new_path(text.sparkSession, "triples")
    triples = text.mapInArrow(count_triples, "part long, blob binary").groupBy("part").applyInArrow(write_triples, TOLD)
    triples = materialize(triples, "triples", scratch, release=True)
    done = {r.part: r for r in triples.where("kind = 0").select("part", "path", "n", "counts").collect()}  # one row a part
    of_triples = np.sum([r.counts for r in done.values()], axis=0).tolist() if done else [0] * 4

    def write_pair_stats(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        total, base = pair_files[part][1], int(pair_edges[part])
        stored = Counted(*pair_files[part])
        start = Words(files, starts).find(np.array([START]))[0][0]
        of_counts, places, large = np.zeros(4, np.int64), [], []
        with tempfile.TemporaryFile() as f, Output(folder, "pair-stats") as out:
            numbers = np.memmap(f, "<u4", "w+", shape=(total, 4))
            for kind, ids, times in _numbers(batches):
                numbers[ids - base, kind - 1] += times.astype("<u4")
            for a in range(0, total, at_once):
                piece = numbers[a : a + at_once].astype(np.int64)
                at = np.arange(a, a + len(piece))
                before = (unmix(stored.keys[at]) >> _U(32)).astype(np.int64)
                piece[:, 0] = np.where(before == start, stored.counts(at), piece[:, 0])
                out.write(np.minimum(piece, 255).astype("u1"))
                high = np.flatnonzero(piece.ravel() >= 255)  # by pair, then by kind
                places.append((high + 4 * a).astype("<u8"))
                large.append(piece.ravel()[high].astype("<u8"))
                of_counts += _of_counts(piece[:, 0])
                some, at = np.unique(before, return_inverse=True)
                sums = np.bincount(at, piece[:, 0], minlength=len(some)).astype(np.int64)
                yield _told(_followers(before, piece[:, 0], edges) + _ranges(5, some, sums, edges))
                tx.release()
            for x in (np.zeros(-4 * total % 8, "u1"), *places, *large):
                out.write(x)
        yield _written(part, out.path, sum(map(len, places)), of_counts)

    # each part of the pairs has a row here even if no triple tells of it
    every = text.sparkSession.createDataFrame([(0, k, None, 0, None, None) for k, (_, n) in enumerate(pair_files) if n], TOLD)
    told = triples.where("kind > 0").unionByName(every).groupBy("part").applyInArrow(write_pair_stats, TOLD)
    told = materialize(told, "pair-stats", path, release=True)
    discard(scratch)
    stats = {r.part: r for r in told.where("kind = 0").select("part", "path", "n", "counts").collect()}  # one row a part
    of_pairs = np.sum([r.counts for r in stats.values()], axis=0).tolist() if stats else [0] * 4
    fields = {
        "triples": [(done[k].path, done[k].n) if k in done else ("", 0) for k in range(parts)],
        "pair_stats": [(stats[k].path, stats[k].n) if k in stats else ("", 0) for k in range(len(pair_files))],
        "triple_discounts": discounts(of_triples),
    }
    return fields, told.where("kind > 0"), of_pairs


def _contexts(two: Pairs, ids: np.ndarray, at: np.ndarray, before: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: place and count of the pair before it (-1 and 0: unknown or a text's first word), and of the pair that it ends; second, which tokens are not first."""
    known = (ids[before] >= 0) & (ids[at] >= 0)
    keys, where = np.unique((ids[before].astype(np.uint64) << _U(32)) | (ids[at].astype(np.uint64) & _U(0xFFFFFFFF)), return_inverse=True)
    place, n = (np.where(known, x[where], m) for x, m in zip(two.find(keys), (-1, 0), strict=True))
    inner = np.ones(len(at), bool)
    inner[first] = False
    context = np.where(inner, np.roll(place, 1), -1)
    return context, np.flatnonzero(inner), np.where(inner, np.roll(n, 1), 0), place, n


class Scorer:
    """A model's arrays as one worker maps them."""

    def __init__(self, m: Model):
        self.m, self.words = m, Words(m.words, m.starts, m.stats)
        self.pairs = Pairs(m.pairs, m.pair_stats)
        self.triples = Pairs(m.triples) if m.triples is not None else None

    def log10(self, all_tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: training count, log10 by counts alone with 0.5 added, log10 by the model."""
        m = self.m
        ids, counts, at, before = _pairs(all_tokens, first, self.words)
        order = np.argsort(ids, kind="stable")
        stat = np.empty((5, len(ids)), np.int64)
        stat[:, order] = self.words.stat(ids[order])
        discount = np.array([0.0, *m.discounts])
        of_word = np.array([0.0, *m.word_discounts])
        # words alone: from how many different words come before them
        cont = stat[0]
        total = max(m.n_pairs, 1)
        alone = (cont - of_word[np.minimum(cont, 3)]) / total + self.rest / (m.n_types + 1)
        triple, inner, n_context, place, both = _contexts(self.pairs, ids, at, before, first)
        pair_stat = None
        if self.triples is not None:
            some, where = np.unique(place, return_inverse=True)
            pair_stat = self.pairs.stat(some)[:, where]
            both = pair_stat[0]
        context = stat[4][before]
        gone = (m.discounts[0] * stat[1] + m.discounts[1] * stat[2] + m.discounts[2] * stat[3])[before]
        seen = context > 0
        p = np.where(seen, (both - discount[np.minimum(both, 3)] + gone * alone[at]) / np.maximum(context, 1), alone[at])
        if self.triples is not None:
            d3 = np.array([0.0, *m.triple_discounts])
            ok = np.flatnonzero(triple >= 0)
            known = ids[at[ok]] >= 0
            keys, where = np.unique((triple[ok].astype(np.uint64) << _U(32)) | (ids[at[ok]].astype(np.uint64) & _U(0xFFFFFFFF)), return_inverse=True)
            n = np.where(known, self.triples.find(keys)[1][where], 0)
            gone = (d3[1:] @ pair_stat[1:])[ok - 1]  # the pair before a token ends at the token before it
            p[ok] = (n - d3[np.minimum(n, 3)] + gone * p[ok]) / n_context[ok]
        c = counts[at]
        base = np.log10((c + 0.5) / (m.n_tokens + 0.5 * (m.n_types + 1)))
        return c, base, np.log10(p)

    @property
    def rest(self) -> float:
        """What the discounts took from the words alone, which goes to all words alike."""
        if not self.m.n_pairs:
            return 1.0
        if not hasattr(self, "_rest"):
            taken = 0.0
            for found in self.words.stats:
                if found is not None:
                    n = np.bincount(np.minimum(found[0], 3), minlength=4)
                    taken += float(n[1:] @ np.array(self.m.word_discounts))
            self._rest = taken / self.m.n_pairs
        return self._rest


def score(docs: DataFrame, m: Model) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, base_score, score, perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(m)
        for cuts, all_tokens, first in chunks(batches):
            c, base, model = scorer.log10(all_tokens, first)
            n = np.diff(np.append(first, len(all_tokens)))
            sums = [np.add.reduceat(x, first) for x in (c > 0, base, model)]
            ids = pa.concat_arrays([x.column(0) for x in cuts]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10 ** (-sums[2] / n))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def fit(train: DataFrame, order: int = ORDER) -> Model:
    """Count ``train`` (text) into a new folder of the shared one."""
    return count(train, new_path(train.sparkSession, "lm"), order=order)
