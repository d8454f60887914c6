"""Packing: plans against all that a packing must hold, best-fit decreasing and bounds; pieces against the tokenizer."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lociframe.llm import packing
from lociframe.llm.queries import END_ID, tokenizer_path

CAPACITY = 1024


def best_fit_decreasing(lengths):
    rooms, n = Counter(), 0
    for x in sorted(lengths, reverse=True):
        room = min((r for r, k in rooms.items() if k and r >= x), default=None)
        if room is None:
            n, room = n + 1, CAPACITY
        else:
            rooms[room] -= 1
        rooms[room - x] += 1
    return n


def places(plan, n):
    """Sequence, offset and length at each rank."""
    out = []
    for (first, length, sequence, each, offset), end in zip(plan.segments, [*(s[0] for s in plan.segments[1:]), n], strict=False):
        out += [(sequence + i // each, offset + i % each * length, length) for i in range(end - first)]
    return out


def assert_packed(rows, sequences):
    """Rows of sequence, offset, length: gapless from 0, within the capacity, sequences numbered from 0."""
    held = {}
    for s, offset, length in sorted(rows):
        assert offset == held.get(s, 0)
        held[s] = offset + length
    assert set(held) == set(range(sequences)) and max(held.values(), default=0) <= CAPACITY


rng = np.random.default_rng(5)
LENGTHS = {
    "uniform": rng.integers(1, 1025, 6000),
    "without small ones": rng.integers(260, 520, 6000),
    "third": rng.integers(342, 1025, 3000),
    "skewed": np.minimum(1024, rng.lognormal(5.5, 1, 6000).astype(int) + 1),
    "one length for a third": np.append(np.full(2000, 400), rng.integers(1, 1025, 4000)),
    "few": np.array([1, 5, 1024]),
    "one": np.array([7]),
    "whole": np.full(9, 1024),
    "small": np.full(5000, 3),
    "two thirds": np.repeat([700, 324], 1000),
    "none": np.zeros(0, int),
}


@pytest.mark.parametrize("name", LENGTHS)
def test_plan(name):
    lengths = sorted(LENGTHS[name].tolist(), reverse=True)
    for settings in (packing.Settings(groups=(8,), slacks=(1024,)), packing.Settings()):
        plan = packing.plan(dict(Counter(lengths)), settings)
        rows = places(plan, len(lengths))
        assert [x for _, _, x in rows] == lengths
        assert_packed(rows, plan.sequences)
    assert -(-sum(lengths) // CAPACITY) <= plan.sequences <= math.ceil(1.002 * best_fit_decreasing(lengths))
    if name == "without small ones":  # what configurations are for
        assert plan.sequences < 0.97 * best_fit_decreasing(lengths)
    if name == "two thirds":
        assert plan.sequences == 1000


def test_a_plans_length_depends_on_the_capacity_alone():
    small, large = (packing.plan({x: n for x in range(1, 1025)}, packing.Settings(groups=(32,))) for n in (2000, 2_000_000))
    assert max(len(small.segments), len(large.segments)) < 4 * CAPACITY
    assert large.sequences < 1.02 * 2_000_000 * sum(range(1, 1025)) / CAPACITY


def test_knapsack_and_configurations():
    sizes = np.array([900, 512, 511, 300, 130])
    value, column = packing.knapsack(sizes, np.array([0.9, 0.5, 0.52, 0.3, 0.1]), CAPACITY)
    best = max(0.9 * a + 0.5 * b + 0.52 * c + 0.3 * d + 0.1 * e for a in range(2) for b in range(3) for c in range(3) for d in range(4) for e in range(8) if 900 * a + 512 * b + 511 * c + 300 * d + 130 * e <= CAPACITY)
    assert abs(value - best) < 1e-12 and sizes @ column <= CAPACITY
    demand = np.array([10.0, 40, 40, 100, 60])
    found = packing.configurations(sizes, demand, CAPACITY, 1e-9)
    assert all(sizes @ c <= CAPACITY for _, c in found) and (sum(n * c for n, c in found) <= demand).all()
    assert sum(n * (sizes @ c) for n, c in found) > 0.8 * sizes @ demand


def test_pack_documents(spark):
    with open(tokenizer_path(), encoding="utf-8") as f:
        definition = f.read()
    texts = [None, "", "one", "word " * 5000, "é\U0001f600 " * 900, "a b c d " * 256, "x" * 3000] + [f"text {i} " * (i % 300) for i in range(300)] + ["same words"] * 200
    rows = [(i if i % 9 else None if i % 2 else 4, t, 1, 2, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, offset long, sequence_id string").repartition(3)
    found = packing.pieces(docs, definition, END_ID, with_ids=True)
    packed = packing.pack(found.withColumn("count", F.lit(1)).withColumn("before", F.lit(2)).withColumn("a.b", F.lit(3)))
    got = packed.drop("a.b").collect()
    t = Tokenizer.from_str(definition)
    want = []
    for i, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [END_ID], "<u4")
        ends = range((len(ids) - 1) % CAPACITY + 1, len(ids) + 1, CAPACITY)
        want += [repr((i, k, e0, e - e0, zlib.crc32(ids[e0:e].tobytes()))) for k, (e0, e) in enumerate(zip([0, *ends], ends, strict=False))]
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(want)
    n = len({r.sequence_id for r in got})
    assert_packed([(r.sequence_id, r.offset, r.length) for r in got], n)
    assert n <= math.ceil(1.002 * best_fit_decreasing([r.length for r in got]))
    out = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert len(out) == n
    for r in got:
        assert out[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids and zlib.crc32(r.ids) == r.ids_crc32
        assert (r.doc_id, r.piece, r.offset, r.length) in [tuple(d) for d in out[r.sequence_id].documents]
    empty = packing.pack(packing.pieces(docs.where("false"), definition, END_ID, with_ids=True))
    assert empty.count() == 0 and packing.sequences(empty).count() == 0


def test_query(spark, sf_dir):
    from lociframe.llm.queries import op13_packing

    got = op13_packing(spark, sf_dir).collect()
    assert_packed([(r.sequence_id, r.offset, r.length) for r in got], len({r.sequence_id for r in got}))
