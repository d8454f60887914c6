"""Words, hashes and shingles of whole Arrow batches of text, without a loop over words.

All functions work on the UTF-8 bytes of a batch laid end to end. A word's hash is a
polynomial in its bytes modulo 2**64, taken from prefix sums, then mixed; equal words have
equal hashes in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of other characters than the ASCII space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = np.random.default_rng(20240502).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Class of each byte, 0 between words: space-separated words.
SPACED = np.ones(256, np.uint8)
SPACED[[0x20, *range(0x09, 0x0E)]] = 0
#: ASCII letters and digits and all that is not ASCII.
ALNUM = np.zeros(256, np.uint8)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: Runs of letters and digits, and runs of other marks.
RUNS = np.where(ALNUM == 1, 1, np.where(SPACED == 1, 2, 0)).astype(np.uint8)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the faster ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits after which each bit depends on all."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of some texts: their hashes, byte ranges, and each text's range of words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of text i: words first[i] to first[i + 1]
    kind: np.ndarray
    prefix: np.ndarray  # sums of the bytes' terms
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins and the last ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Split texts into runs of one non-zero class of bytes, and hash the runs."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    kind = classes[data]
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    change[inner] = True
    bounds = np.flatnonzero(change)
    starts, ends = bounds[:-1], bounds[1:]
    if n == 0:
        starts = ends = np.zeros(0, np.int64)
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    up, down = _power(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), kind[starts], prefix, hashes)


def sequences(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words within a text, and the index of its first word."""
    n = len(w.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.repeat(w.first[1:], w.counts)[:n] - np.arange(n) >= k)
    total = np.full(n, _U(k), np.uint64)
    for j in range(k):
        total += w.hashes[j : j + n] * _PLACE[j]
    return mix(total[at]), at


def beginnings(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words are longer than ``k`` bytes, and the hashes of their first ``k`` bytes."""
    longer = np.flatnonzero(w.ends - w.starts > k)
    starts = w.starts[longer]
    return longer, mix((w.prefix[starts + k] - w.prefix[starts]) * _power(len(w.data) + 1)[1][starts] + _U(1_000_003 * k))


def whole(hashes: np.ndarray) -> np.ndarray:
    """The hash of a sequence of fewer words than a shingle has."""
    return mix(np.array([len(hashes)], np.uint64) + (hashes * _PLACE[: len(hashes)]).sum(dtype=np.uint64))


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of ``k`` words; with fewer words, the whole sequence as one."""
    hashes, at = sequences(w, k)
    bounds = np.searchsorted(at, w.first)
    out = []
    for i, n in enumerate(w.counts):
        if n >= k:
            out.append(np.unique(hashes[bounds[i] : bounds[i + 1]]))
        else:
            out.append(whole(w.hashes[w.first[i] : w.first[i + 1]]) if n else np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch so that each cut holds about ``limit`` bytes of text or one longer text."""
    data, offsets = flat(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    release()


def release() -> None:
    """Give freed memory back to the system; workers live on between tasks and share a limit with the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
