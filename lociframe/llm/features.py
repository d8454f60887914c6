"""Hashed sparse features of texts: row bounds, indices and values of a batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lociframe.llm import text as tx

_U = np.uint64
_REPEAT = _U(0xA5A5F00D12345671)
#: A batch of sparse rows: row i has the features bounds[i] to bounds[i + 1].
Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Hashing:
    """How texts become features.

    ``bits``: there are 2**bits indices. ``runs``: words are split into runs of letters and
    runs of other marks. ``bigrams``: pairs of neighbours count too; a word that follows
    itself is one n-gram of its own kind, whatever the word. ``prefixes``: lengths in bytes
    of word beginnings that count too. ``lower``: lower-case A-Z first.

    The value of a feature is log(1 + its count) over the fourth root of the number of the
    text's features, so that long texts weigh more than short ones, but not in proportion.
    """

    bits: int = 18
    runs: bool = False
    bigrams: bool = False
    prefixes: tuple[int, ...] = ()
    lower: bool = True

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Rows:
        w = tx.words(data, offsets, tx.RUNS if self.runs else tx.ALNUM, self.lower)
        row, hashed = [w.text_of()], [w.hashes]
        if self.bigrams and len(w.hashes) > 1:
            pair, at = tx.sequences(w, 2)
            hashed.append(np.where(w.hashes[at] == w.hashes[at + 1], _REPEAT, pair))
            row.append(row[0][at])
        for k in self.prefixes:
            longer, beginning = tx.beginnings(w, k)
            hashed.append(beginning)
            row.append(row[0][longer])
        rows, index = np.concatenate(row), np.concatenate(hashed) >> _U(64 - self.bits)
        keys, counts = np.unique((rows.astype(np.uint64) << _U(self.bits)) | index, return_counts=True)
        rows = (keys >> _U(self.bits)).astype(np.int64)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        scale = np.maximum(np.diff(bounds), 1) ** -0.25
        return bounds, (keys & _U((1 << self.bits) - 1)).astype(np.int64), np.log1p(counts) * scale[rows]


def dot(rows: Rows, weights: np.ndarray) -> np.ndarray:
    """The sparse dot product of each row with ``weights``; 0 for a row without features."""
    bounds, index, values = rows
    n = len(bounds) - 1
    return np.bincount(np.repeat(np.arange(n), np.diff(bounds)), weights[index] * values, minlength=n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def take(rows: Rows, at: np.ndarray, block: int = 1024) -> Rows:
    """The chosen rows, in the order of ``at``; ``block`` rows are copied at a time."""
    bounds, index, values = rows
    lengths = np.diff(bounds)[at]
    ends = np.append(0, np.cumsum(lengths))
    out = np.empty(ends[-1], index.dtype), np.empty(ends[-1], values.dtype)
    for k in range(0, len(at), block):
        a, b = ends[k], ends[min(k + block, len(at))]
        where = np.arange(a, b) + np.repeat(bounds[at[k : k + block]] - ends[k : k + block][: len(at[k : k + block])], lengths[k : k + block])
        out[0][a:b], out[1][a:b] = index[where], values[where]
    return ends, *out


def texts_with(index: np.ndarray, size: int, block: int = 1 << 20) -> np.ndarray:
    """In how many rows each of ``size`` features occurs."""
    return sum((np.bincount(index[k : k + block], minlength=size) for k in range(0, len(index), block)), np.zeros(size, np.int64))


def _values(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a binary column's entries, and all their numbers one after the other."""
    lengths, parts = [np.zeros(0, np.int64)], [np.zeros(0, dtype)]
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        lengths.append(np.diff(offsets).astype(np.int64) // np.dtype(dtype).itemsize)
        if offsets[-1] > offsets[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype))
    return np.concatenate(lengths), np.concatenate(parts)


def gather(docs: DataFrame, hashing: Hashing, columns: tuple[str, ...]) -> tuple[dict[str, np.ndarray], Rows]:
    """Features of a bounded sample, made on the executors and brought to the driver.

    ``docs`` has ``text`` and the integer ``columns``; the caller has bounded its rows. Rows
    come in the order of the columns, so that training does not depend on partitions. The
    driver holds 8 bytes for each feature of a text, and as much again for a moment.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, data, offsets in tx.slices(batch):
                bounds, index, values = hashing(data, offsets)
                index, values = index.astype("<u4"), values.astype("<f4")
                spans = list(zip(bounds[:-1], bounds[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [cut.column(cut.schema.get_field_index(c)).cast(pa.int64()) for c in columns]
                    + [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (index, values)],
                    names=[*columns, "index", "values"],
                )

    schema = ", ".join([f"{c} long" for c in columns] + ["index binary", "values binary"])
    table = docs.select("text", *columns).mapInArrow(make, schema).toArrow()
    labels = {c: table[c].to_numpy() for c in columns}
    order = np.lexsort(tuple(reversed(labels.values())))
    lengths, index = _values(table["index"], "<u4")
    table = table.drop_columns(["index"])
    values = _values(table["values"], "<f4")[1]
    del table
    pa.default_memory_pool().release_unused()
    bounds = np.append(0, np.cumsum(lengths))
    return {c: x[order] for c, x in labels.items()}, take((bounds, index, values), order)


def score(docs: DataFrame, hashing: Hashing, weights: np.ndarray, bias: float, scale: float = 1.0) -> DataFrame:
    """All columns of ``docs`` and ``score``, the sigmoid of the sparse dot product with the weights.

    ``docs`` has ``text``; an empty or null text has no features and gets the bias alone.
    """
    spark, schema = docs.sparkSession, docs.schema
    sent = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2**bits numbers, whatever the input

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sent.value.astype(np.float64)
        for batch in batches:
            for cut, data, offsets in tx.slices(batch):
                z = (dot(hashing(data, offsets), kept) + bias) * scale
                at = cut.schema.get_field_index("text")
                rest = [i for i in range(cut.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*[cut.column(i) for i in rest], pa.array(sigmoid(z))], names=[*[cut.schema.names[i] for i in rest], "score"])

    from pyspark.sql import types as T

    out = T.StructType([f for f in schema.fields if f.name != "text"] + [T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(make, out)
