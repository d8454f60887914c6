"""Runs: maximal stretches of words that repeat with one smallest period.

Words become numbers, and a text an integer sequence. Let a run have period d, and let size be
the power of two with size <= d < 2 size. The run holds a block of ``size`` words that begins
at a multiple of ``size`` among the run's first ``size`` words, and the same block d words
later. So for each scale the aligned blocks are put into an Aho-Corasick automaton with
integer-sequence keys, which is searched over the text; an occurrence at a distance from
``size`` to ``2 size - 1`` is a seed, extended word by word in both directions as long as words
a distance apart are equal. Nothing is missed:

* A block is left out only where one of the words that a run's first aligned block would need
  to recur within less than ``2 size`` words does not, or where all of its seeds would be.
  Text that lies in no such distance of any block need not be searched.
* A seed is left out only where its words lie in a stretch that was extended before with the
  same distance, or in a run of a smaller period: two periods that fit into a common stretch
  have a common divisor as period there, so the larger one is not the smallest.
* Keys of more than ``KEY_WORDS`` words are cut to that many, which finds more seeds, not fewer.

Defined cases: a null or empty text, and one of white space, has no words and no runs. Rows
with a null doc_id, or that share one, are each a text of their own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lociframe.llm.text import WORD, release

KEY_WORDS = 256
RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
_WORD = re.compile(WORD)


def numbers(words: list[str]) -> np.ndarray:
    """A number for each word, equal for equal words alone."""
    seen: defaultdict[str, int] = defaultdict()
    seen.default_factory = seen.__len__
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


def recurrence(ids: np.ndarray) -> np.ndarray:
    """Distance from each word to its next occurrence; the number of words where there is none."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), len(ids), np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = np.diff(order)[same]
    return gap


def seeds(sequence: tuple[int, ...], starts: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Aligned blocks of ``size`` words and the distances, from size to 2 size - 1, at which they occur again."""
    width = min(size, KEY_WORDS)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    named: dict[tuple[int, ...], int] = {}
    block = [-1] * (len(sequence) // size + 1)
    for at in starts:
        key = sequence[at : at + width]
        block[at // size] = name = named.setdefault(key, len(named))
        automaton.add_word(key, name)
    automaton.make_automaton()
    spans: list[list[int]] = []
    for at in starts:
        low, high = at + size, min(len(sequence), at + 2 * size - 1 + width)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    for low, high in spans:
        for end, name in automaton.iter(sequence[low:high]):
            at = low + end - width + 1
            k = at // size - 1  # the one block whose distance is of this scale
            if block[k] == name:
                yield k * size, at - k * size


def extended(ids: np.ndarray, at: int, distance: int) -> tuple[int, int]:
    """The largest range around word ``at`` whose words equal those ``distance`` later."""
    last = len(ids) - distance
    low, high, step = at, at, 64
    while high < last:
        to = min(last, high + step)
        other = np.flatnonzero(ids[high:to] != ids[high + distance : to + distance])
        high = high + int(other[0]) if len(other) else to
        if len(other):
            break
        step *= 2
    step = 64
    while low > 0:
        to = max(0, low - step)
        other = np.flatnonzero(ids[to:low] != ids[to + distance : low + distance])
        low = to + int(other[-1]) + 1 if len(other) else to
        if len(other):
            break
        step *= 2
    return low, high


def is_smallest(ids: np.ndarray, low: int, high: int, period: int) -> bool:
    """Whether a stretch of at least two periods has none that is smaller, which would divide it."""
    rest, divisor = period, 2
    while rest > 1:
        if divisor * divisor > rest:
            divisor = rest
        if rest % divisor == 0:
            p = period // divisor
            if np.array_equal(ids[low : high - p], ids[low + p : high]):
                return False
            while rest % divisor == 0:
                rest //= divisor
        divisor += 1
    return True


def reach(n: int, runs: list[tuple[int, int, int]], longest: int) -> np.ndarray:
    """For each of ``n`` words, where the last of the runs that begin no later ends, of those with periods up to ``longest``."""
    ends = np.zeros(n, np.int64)
    for start, length, period in runs:
        if period <= longest:
            ends[start] = max(ends[start], start + length)
    return np.maximum.accumulate(ends)


def runs_of(ids: np.ndarray, shortest: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """Start, length and period of each run of at least ``shortest`` words and ``exponent`` periods, by start, then period."""
    if exponent < 3:
        raise ValueError("runs of fewer than three periods need not hold an aligned block and its copy")
    n, size, found = len(ids), 1, []
    if n < max(shortest, exponent):
        return found
    gap, sequence = recurrence(ids), None
    while size * exponent <= n:
        far = np.flatnonzero(gap >= 2 * size)  # the last word of the text is always one
        need = (exponent - 2) * size
        if np.diff(far, prepend=-1).max() > need:
            starts = np.arange(0, n, size)
            starts = starts[far[np.searchsorted(far, starts)] - starts >= need]
            width = min(size, KEY_WORDS)
            short, long = reach(n, found, width) - width, reach(n, found, size) - size
            most = np.maximum(short, long)  # from each word, how far a seed may go to be left out
            starts = starts[most[starts] < starts + 2 * size - 1]
            if len(starts):
                sequence = sequence or tuple(ids.tolist())
                done: dict[int, int] = {}
                for at, distance in seeds(sequence, starts.tolist(), size):
                    if at < done.get(distance, 0) or at + distance <= most[at]:
                        continue
                    low, high = extended(ids, at, distance)
                    done[distance] = high
                    length = high + distance - low
                    if length >= max(shortest, exponent * distance) and is_smallest(ids, low, high + distance, distance):
                        found.append((low, length, distance))
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when each run is cut to its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def find_runs(docs: DataFrame, shortest: int = 6, exponent: int = 4, source: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): doc_id, n_words, runs, collapsed.

    ``runs`` are structs of start, length and period in words, by start and period;
    ``collapsed`` is the text's words, joined by a space, without those that a run repeats
    after its first period. ``source`` may give, for a doc_id and a number of words, from which
    word each word is taken; None leaves the text as it is. Other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, words = doc_id.as_py(), _WORD.findall(text.as_py() or "")
                taken = source(doc_id, len(words)) if source else None
                if taken is not None:
                    words = [words[i] for i in taken.tolist()]
                runs = runs_of(numbers(words), shortest, exponent)
                if runs:
                    keep = kept_words(len(words), runs).tolist()
                    collapsed = " ".join([w for w, k in zip(words, keep, strict=True) if k])
                else:
                    collapsed = " ".join(words)
                out.append((doc_id, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed))
                size += len(collapsed)
                if size > 4_000_000:
                    yield give(out)
                    out, size = [], 0
            if out:
                yield give(out)
        release()

    def give(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), _RUN, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(scan, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
