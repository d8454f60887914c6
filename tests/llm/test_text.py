import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lociframe.llm import text as tx

LOWER = bytes(tx._LOWER)


def plain(t):
    return (t or "").encode().translate(LOWER).split()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\x0b\x1c\xa0é日Z.", max_size=30)), max_size=8))
def test_words_and_shingles_are_pythons(texts):
    data, offsets = tx.flat(pa.array(texts, pa.string()))
    w = tx.words(data, offsets)
    assert w.counts.tolist() == [len(plain(t)) for t in texts]
    same = {}
    for i, t in enumerate(texts):
        for word, h in zip(plain(t), w.hashes[w.first[i] : w.first[i + 1]].tolist(), strict=True):
            assert same.setdefault(word, h) == h
    assert len(set(same.values())) == len(same)
    for t, found in zip(texts, tx.shingle_sets(w, 5), strict=True):
        ws = plain(t)
        assert len(found) == (len(set(zip(*(ws[k:] for k in range(5)), strict=False))) if len(ws) >= 5 else bool(ws))


def test_slices_cover_a_batch():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": ["a" * 10, None, "b" * 100, "", "c"]})
    cuts = list(tx.slices(batch, limit=20))
    assert sum(c.num_rows for c, _, _ in cuts) == 5 and sum(len(d) for _, d, _ in cuts) == 111


def test_license_words():
    data, offsets = tx.flat(pa.array(["CC-BY: é_ü, (x9)"]))
    w = tx.words(data, offsets, tx.ALNUM)
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)] == ["cc", "by", "é", "ü", "x9"]
    assert len(np.unique(w.hashes)) == 5
