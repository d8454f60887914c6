"""Runs against all periods and starts tried one by one."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lociframe.llm import periodic


def brute(w, shortest=6, exponent=4):
    """Every maximal stretch with its smallest period, long enough."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if j > i and len(s) >= max(shortest, exponent * q) and not any(all(s[k] == s[k + p] for k in range(len(s) - p)) for p in range(1, q)):
                out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice([1, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 4)):
            unit, at = [rng.randrange(letters + 1) for _ in range(rng.randint(1, 12))], rng.randint(0, len(w))
            w[at:at] = (unit * rng.randint(2, 9))[: rng.randint(1, 90)]
        yield w * rng.choice([1, 1, 1, 2, 5])


@pytest.mark.parametrize("key_words", [256, 2, 1])
def test_runs_of_sequences(monkeypatch, key_words):
    """Also with keys that are cut."""
    monkeypatch.setattr(periodic, "KEY_WORDS", key_words)
    for w in sequences(key_words, 400):
        for shortest, exponent in ((6, 4), (2, 3), (10, 5)):
            assert periodic.runs_of(np.array(w, np.int64), shortest, exponent) == brute(w, shortest, exponent), w


def test_long_sequences_stay_fast():
    """One word, one word with another in the middle, and a long period: no pass over the text for each distance."""
    assert periodic.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    w = np.zeros(200_001, np.int64)
    w[100_000] = 1
    assert periodic.runs_of(w) == [(0, 100_000, 1), (100_001, 100_000, 1)]
    assert periodic.runs_of(np.tile(np.arange(40_000), 4)) == [(0, 160_000, 40_000)]
    with pytest.raises(ValueError):
        periodic.runs_of(w, exponent=2)


def test_find_runs(spark):
    texts = [" ".join(f"w{x}" for x in w) for w in sequences(9, 120)] + [None, "", " \n ", "a", "A a A a A a A a", "é é " * 9, "x " * 20_000]
    rows = [(i if i % 5 else None, t, 1, "r", 2) for i, t in enumerate(texts)] + [(3, "b " * 6, 1, "r", 2), (3, "b " * 6, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, runs string, period long").repartition(3)
    want = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        runs = brute(w) if len(w) < 9000 else [(0, len(w), 1)]
        keep = [x for k, x in enumerate(w) if not any(s + q <= k < s + length for s, length, q in runs)]
        want.append(repr((i, len(w), runs, b" ".join(keep).decode())))
    got = periodic.find_runs(docs).collect()
    assert sorted(repr((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got) == sorted(want)
    assert periodic.find_runs(docs.where("false")).count() == 0


def test_query_by_brute_force(spark, sf_dir):
    from lociframe.llm.queries import op11_periodic_runs, table

    got = {r.doc_id: r for r in op11_periodic_runs(spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for r in docs:
        w = (r.text or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            planted += 1
        if len(w) > 600:
            continue
        runs = brute(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        keep = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs)]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        g = got[r.doc_id]
        assert (g.n_runs, g.start, g.length, g.period) == (len(runs), *(best or (None,) * 3))
        assert g.exponent_milli == (best and 1000 * best[1] // best[2])
        assert g.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest() and g.collapsed_sha256 == hashlib.sha256(b" ".join(keep)).hexdigest()
    assert planted > 5 and sum(g.n_runs > 0 for g in got.values()) > 5
