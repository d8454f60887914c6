"""Fill-in-the-middle against its definition, with marks, white space, nulls and rows that share a doc_id."""

import hashlib
import random
import re

import pytest

from lociframe.llm import fim

SPACE = " \t\n\x0b\x0c\r"


def units(text):
    """Units found character by character."""
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in SPACE:
            j += 1
        while j < len(text) and text[j] not in SPACE:
            j += 1
        out.append(text[i:j])
        i = j
    return out


def expected(doc_id, text, settings):
    text = text or ""
    u, h = units(text), hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(m in text for m in settings.marks) or h3 % 100 >= settings.rate:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    P, S, M = settings.marks
    form = "spm" if h4 % 100 < settings.suffix_first else "psm"
    return len(u), form, len(p), len(m), S + s + P + p + M + m if form == "spm" else P + p + S + s + M + m


@pytest.mark.parametrize("settings", [fim.Settings(), fim.Settings(seed="7", rate=100, suffix_first=30, prefix_mark="[pre]", suffix_mark="[suf]", middle_mark="[mid]")])
def test_transform_and_restore(spark, settings):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab<P>SM é \U0001f600\x1c" + SPACE, k=rng.randint(0, 40))) for _ in range(400)]
    texts += [None, "", " ", " \n", "a <P> b", "<S>", "x<M>", "a<", "P>b", "word " * 30_000, "é" * 100_000, "[pre] x", None]
    rows = [(i if i % 7 else None if i % 2 else 12, t, 1, "x", "y") for i, t in enumerate(texts)]
    rows += [(2**62 + 1, "a b c d", 1, "x", "y"), (-5, "a b c d", None, None, None), (-5, "a b c d", 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, form string, output string").repartition(3)
    made = fim.transform(docs, settings)
    got = made.withColumn("back", fim.restore(made.form, made.output, settings)).collect()
    found = sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got)
    assert found == sorted(repr((i, *expected(i, t, settings))) for i, t, *_ in rows)
    assert sorted(r.back.text for r in got) == sorted(t or "" for _, t, *_ in rows)
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.back.sha256 == hashlib.sha256(r.back.text.encode()).hexdigest()
    assert {"plain", "spm", "psm"} <= {r.form for r in got}
    assert fim.transform(docs.where("false"), settings).count() == 0


def test_marks_that_could_run_together_are_refused():
    for marks in (("<", "<", "x"), ("ab", "ba", "c"), ("aba", "x", "y"), ("", "x", "y")):
        with pytest.raises(ValueError):
            fim.Settings(prefix_mark=marks[0], suffix_mark=marks[1], middle_mark=marks[2])


def test_units_are_those_of_the_pattern():
    for t in ("", " ", "a", " a", "a ", "a  b\n", "\x0ba\x0c"):
        assert units(t) == re.findall(fim.UNIT, t)
