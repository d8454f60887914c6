"""Each operator against plain Python on small tables with nulls, repeats, long and empty texts."""

import gzip
import hashlib
import math
import os
import random
import subprocess
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociframe.llm import components, decontaminate, exact_dedup, features, kneser_ney, licenses, minhash, mixing, quality, tokens, toxicity, warc
from lociframe.llm import text as tx
from lociframe.llm.queries import tokenizer_path
from lociframe.llm.scratch import filesystem, new_path, shared_dir

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, bucket long, component long"


def words(t):
    return (t or "").translate(LOW).encode().split()


def shingles(t, k=5):
    w = words(t)
    return set(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else ({tuple(w)} if w else set())


def make(spark, texts, sources=None, ids=None):
    """Documents with extra columns of names that operators use inside."""
    rows = [(i if ids is None else ids[k], t, "en", (sources or ["s"] * len(texts))[k], len(t or ""), "x", 1, 2, 3) for k, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(n)]
    for _ in range(60):  # near copies of all degrees, in chains
        w = rng.choice(texts).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[0].upper(), texts[0], None, "", " \n\t", "one", "ONE", "one two", " ".join(["long"] * 3000 + vocabulary * 10)]
    return texts


def test_exact_dedup(spark):
    texts = corpus()
    got = {r.doc_id: r for r in exact_dedup.exact_groups(make(spark, texts)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault((t or "").translate(LOW), []).append(i)
    assert len(got) == len(texts)
    for key, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(key.encode()).hexdigest()
    for limit in (0, 1 << 30):  # joined and broadcast
        assert exact_dedup.exact_groups(make(spark, texts), limit).where("kept").count() == len(groups)
    assert exact_dedup.keep_one(make(spark, texts)).count() == len(groups)
    kept = exact_dedup.keep_one(make(spark, ["a", "b", "A", "c", "C", "c"], ids=[5, 5, 9, None, None, 3])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, "c"), (5, "b"), (9, "A")]



def test_cache_of_pieces_is_bounded_in_bytes():
    with open(tokenizer_path(), encoding="utf-8") as f:
        definition = f.read()
    small, rng = tokens.Encoder(definition, cached=200_000), random.Random(2)
    small.kept.young, small.kept.old, small.kept.bytes = {}, {}, 0
    for k in range(30):
        texts = [" ".join("".join(rng.choices("abcdé\u4e2d", k=rng.randint(1, 12))) for _ in range(300)), "q" * 5000, f"a {'z' * 201} b"]
        assert list(small.batch(texts)) == [small.whole(t) for t in texts], k
        for kept in (small.kept.young, small.kept.old):
            assert sum(170 + 4 * len(p) + len(ids) for p, ids in kept.items()) < 200_000 + 900 * 250
            assert max(map(len, kept), default=0) <= tokens.LONGEST_KEPT
    small.kept.young, small.kept.old, small.kept.bytes = {}, {}, 0


def test_near_duplicates(spark):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    for settings in (minhash.Settings(), minhash.Settings(broadcast_rows=0, bucket=(2, 3), block=(9000, 9000), centres=2)):
        got = {r.doc_id: r for r in minhash.duplicate_groups(make(spark, texts), settings).collect()}
        assert len(got) == len(texts)
        for i in range(len(texts)):
            assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i), i
    assert minhash.keep_one(make(spark, texts)).count() == sum(find(i) == i for i in range(len(texts)))


def test_near_duplicates_of_rows_that_share_a_doc_id(spark):
    """One doc_id on two texts that others are near to, rows without doc_id, and equal rows."""
    text = lambda i, n=60: " ".join(f"v{i}x{j}" for j in range(n))
    rows = [(1, text(1)), (1, text(2)), (2, text(1) + " more"), (3, text(2) + " more"), (None, text(3)), (9, text(3) + " more"), (None, text(4)), (7, text(5)), (7, text(5))]
    got = minhash.duplicate_groups(make(spark, [t for _, t in rows], ids=[i for i, _ in rows])).collect()
    found = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got)
    assert found == [(0, 0, True), (0, 9, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (7, 7, True), (7, 7, True), (9, 9, True)]


def test_large_group_of_near_copies_makes_few_links(spark):
    """700 texts that differ from one in up to a seventh of their words, and outliers near to some of them only."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for k in range(700):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(70)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = make(spark, texts)
    s = minhash.Settings(bucket=(64, 64), block=(200_000, 200_000), centres=3)
    got = {r.doc_id: r.component_id for r in minhash.duplicate_groups(docs, s).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    classes = minhash.sketch(docs, s).withColumnRenamed("doc_id", "id").withColumn("node", F.col("id"))
    near = minhash.clusters(classes, s)
    assert minhash.links_of(docs, classes, near, s).count() < 4 * len(texts)


def test_pruning_table_keeps_what_is_similar():
    least = minhash.least_equal(minhash.Settings())
    rng = np.random.default_rng(0)
    equal = rng.random((20000, 256)) < 0.875
    for k, m in enumerate(least):
        assert (equal[:, : 64 * (k + 1)].sum(axis=1) >= m).mean() > 0.9995


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 470)] + [(500, k) for k in range(501, 560)] + [(600, 600), (1, None)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, todo = {}, sorted(near)
    for x in todo:
        if x not in want:
            stack = [x]
            while stack:
                y = stack.pop()
                if y not in want:
                    want[y] = x
                    stack += near[y]
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def page_rows():
    big = "<p>ü" + "x" * 3000
    return [(1, "http://a/ b", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", big + "!"), (8, "u\n", big), (None, "u", big)]


@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_warc(spark, archive_bytes):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(pages, new_path(spark, "warc"), archive_bytes=archive_bytes)
    assert archives.count() == (9 if archive_bytes == 1 else 1)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    for i, _, html in page_rows():
        data = (html or "").encode()
        keep = 8 if i in (1, 2) else None
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == ("revisit" if keep else "response", keep)
    assert got[1].url == "http://a/%20b"
    fs, at = filesystem(archives.first().path)
    with fs.open_input_stream(at) as f:
        raw = f.read()
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reader_finds_damage():
    import io

    record = warc._record(1, "u", b"hello" * 1000, None, "sha1:" + "A" * 32, 5000)
    with pytest.raises(ValueError, match="payload"):
        list(warc.records(io.BytesIO(record)))
    good = warc._record(1, "u", b"hello", None, warc._sha1(b"hello"), 5)
    assert [r["payload_bytes"] for r in warc.records(io.BytesIO(good + good))] == [5, 5]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-20])))


def test_pivot_conserves_mass_and_expectation():
    rng = np.random.default_rng(5)
    size, p = rng.integers(1, 500, 301).astype(float), rng.random(301)
    runs = np.array([mixing.pivot(p, size, np.random.default_rng(i)) for i in range(400)])
    assert (((runs > 0) & (runs < 1)).sum(axis=1) <= 1).all()
    assert np.allclose(runs @ size, p @ size)
    assert abs(runs.mean(axis=0) - p).max() < 0.15


@pytest.mark.parametrize("chunk", [4, 4096])
def test_mixing(spark, chunk):
    rng = random.Random(2)
    texts = ["w " * rng.randint(0, 30) for _ in range(400)] + [None, "", "\x0bA\xa0b c"]
    sources = [rng.choice(["b", "a", "é", None, "a"]) for _ in texts]
    docs = make(spark, texts, sources)
    rows = mixing.mix_sources(docs, chunk=chunk, fan_in=3).collect()
    assert len(rows) == len(texts)
    sizes = [len((t or "").encode().split()) for t in texts]
    order = sorted({s for s in sources if s}) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    own = {s: sum(n for n, x in zip(sizes, sources, strict=True) if x == s) for s in order}
    target, free, left = {}, set(order), 1.5 * sum(sizes)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * own[s] + 1e-9]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * own[s]
            left -= target[s]
            free.remove(s)
    taken = Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == sizes[r.doc_id] and r.source_size == own[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 15 for s in order)
    again = mixing.mix_sources(docs.repartition(3), chunk=chunk, fan_in=3).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_tokens(spark):
    from tokenizers import Tokenizer

    texts = corpus(n=150) + ["a  b\n\n c\r\n\td's it'll  ", "x\xa0y\x85z ", "<|endoftext|> end", "日本 語 12 3"]
    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    ids = [9 * i for i in range(len(texts))]
    docs = make(spark, texts, ids=ids)
    folder = new_path(spark, "tokens")
    with open(path, encoding="utf-8") as f:
        manifest = tokens.write_shards(docs, folder, f.read(), 2, shards=3)
    got = {r.doc_id: r for r in tokens.read_shards(manifest).collect()}
    start = 0
    for i, text in zip(ids, texts, strict=True):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[i].ids == want and got[i].n_tokens == len(want) and got[i].start == start
        assert got[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    found = [tokens.Shard(r.path).find(ids[3]) for r in manifest.collect()]
    assert [x.tolist() for f in found for x in f] == [got[ids[3]].ids]
    assert tokens.round_trip(make(spark, []), path).count() == 0
    assert tokens.round_trip(make(spark, ["a", "b"], ids=[None, None]), path).count() == 2


def test_cut_texts_get_the_tokenizers_ids():
    """Random texts of words, marks, white space of all kinds and added tokens, as cut and as the tokenizer has them."""
    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as f:
        definition = f.read()
    rng, whole, cut = random.Random(5), Tokenizer.from_str(definition), tokens.Encoder(definition)
    parts = ["word", "Été", "don't", "I'll", "x1", "42", ".", "...", "—", "日本", "\u0301", "<|endoftext|>", "<|end", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\xa0", "\x85", "\u2003", "\x1f", "ß", "×", "_", "'s", "🙂"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(2500)] + ["a\n\n<|endoftext|>b", " <|endoftext|> ", ""]
    for t, got in zip(texts, cut.batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    said = __import__("json").loads(definition)
    assert tokens.whole_texts(definition).search("plain") is None
    assert tokens.whole_texts(__import__("json").dumps(said | {"normalizer": {"type": "Lowercase"}})).search("plain")


def test_encoder_keeps_to_one_thread():
    """Workers share an executor's cores, so threads of a worker's own only take CPU from the others."""
    code = (
        "import os, sys; from lociframe.llm import tokens; from lociframe.llm.queries import tokenizer_path\n"
        "made = tokens.Encoder(open(tokenizer_path(), encoding='utf-8').read()); before = len(os.listdir('/proc/self/task'))\n"
        "texts = [' '.join(f'w{i}x sñ{i} {i}.' for i in range(k, k + 500)) for k in range(0, 5000, 500)]\n"
        "assert list(made.batch(texts)) == [made.whole(t) for t in texts]\n"
        "sys.exit(len(os.listdir('/proc/self/task')) - before)\n"
    )
    unset = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], env=unset).returncode == 0


def test_runs_go_to_the_model_as_the_tokenizer_splits_them():
    with open(tokenizer_path(), encoding="utf-8") as f:
        made = tokens.Encoder(f.read())
    rng, signs = random.Random(3), "aB zéÑɏɐ×÷ÿƻǃ0129²½٣ж中'’\"!~`_-.,@#\n\t\r\x0b\x0c  \x00\x7f́😀ªµİ"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(3000)] + [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1" for c in range(0x300)]
    for text, got in zip(texts, made.batch(texts), strict=True):
        assert got == made.whole(text), repr(text)


def test_new_words_of_a_batch_go_to_the_model_together():
    """Over words seen for the first time, calls of the model are a small part of the words; repeats bring none."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        made = tokens.Encoder(f.read())
    calls, model, rng = [], made.model, random.Random(11)

    class Counted:
        def tokenize(self, run):
            calls.append(run)
            return model.tokenize(run)

    made.model = Counted()
    texts = ["".join(" " + "".join(rng.choices("qzxjéÿőA", k=12)) for _ in range(200)) for _ in range(5)]
    assert list(made.batch(texts)) == [made.whole(t) for t in texts]
    assert 0 < len(calls) <= 50
    calls.clear()
    assert list(made.batch(texts[::-1])) == [made.whole(t) for t in texts[::-1]] and not calls


def test_texts_of_a_batch_are_cut_apart():
    """Texts that end in and begin with white space, letters or marks of any length, empty ones and ones encoded whole between them."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        definition = f.read()
    made, rng = tokens.Encoder(definition), random.Random(12)
    ends = ["", " ", "  ", "\n", " \n", "\n ", "a", "é", "ɏ", "ɐ", "×", "1", ".", "'", "'s", "中", "🙂", "\xa0", "<|endoftext|>", "\x00"]
    texts = [a + m + b for a in ends for m in ("", "x", " y1", "don't") for b in ends]
    for n in (1, 2, 7, len(texts)):
        rng.shuffle(texts)
        for k in range(0, len(texts), n):
            some = texts[k : k + n]
            assert list(made.batch(some)) == [made.whole(t) for t in some], some


def test_words_go_alone_where_a_model_joins_them():
    with open(tokenizer_path(), encoding="utf-8") as f:
        said = __import__("json").loads(f.read())
    model, letters = said["model"], tokens.Encoder(__import__("json").dumps(said)).letters
    assert tokens.apart(__import__("json").dumps(said), letters) is not None
    joined = model | {"vocab": model["vocab"] | {"eĠt": max(model["vocab"].values()) + 2}, "merges": [["e", "Ġt"], *model["merges"]]}
    definition = __import__("json").dumps(said | {"model": joined})
    assert tokens.apart(definition, letters) is None
    made, text = tokens.Encoder(definition), "the tree the tea bee tie toe the"
    assert list(made.batch([text])) == [made.whole(text)]


def test_dictionary_is_there_for_any_table(spark):
    with open(tokenizer_path(), encoding="utf-8") as f:
        definition = f.read()
    one = tokens.train_dictionary(make(spark, ["a few words of one text"]), definition, 2, 2)
    assert len(one) >= 8 and tokens.train_dictionary(make(spark, []), definition, 2, 2) == b""
    many = tokens.train_dictionary(make(spark, corpus(n=300)), definition, 2, 2)
    assert many[:4] == bytes.fromhex("37a430ec")  # a trained one
    long = tokens._spread(np.arange(40_000, dtype="<u2"))
    assert len(long) == tokens.SAMPLE_SLICES * tokens.SLICE_BYTES and long.endswith(np.uint16(39_999).tobytes())
    docs = make(spark, ["same"] * 40 + [None, "x"], ids=[7] * 20 + [None] * 22)
    assert tokens.round_trip(docs, tokenizer_path()).count() == 42


def test_counting_leaves_only_the_model(spark):
    """Shuffle files and tables of blobs are gone once the arrays are written."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    fs, at = filesystem(shared_dir(spark) + "/lociframe")
    fs.create_dir(at)
    tables, files = set(os.listdir(at)), shuffled()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, None)
    model = kneser_ney.fit(make(spark, corpus()))
    assert spark.conf.get(key, None) == setting
    made = {x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - tables}
    assert made and not made & {"pairs", "triples", "pair-stats"}, made
    for _ in range(100):  # files are removed in the background
        if not shuffled() - files:
            break
        time.sleep(0.1)
    assert not shuffled() - files
    assert kneser_ney.score(make(spark, ["one two"]), model).count() == 1


def test_licenses(spark):
    texts = [
        "All rights reserved. CC-BY\nall Rights\nReserved", None, "", "text\nReleased under the MIT License!\nmore", "released under some mit license", "cc by cc by", "by cc", "license version 2 0 licensed under the apache",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0.", "Released under the Apache License", "this is licensed under the gnu general public license version 2",
        # wrapped as notices are
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy",
    ]
    docs = make(spark, texts)
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.vocabulary(docs)).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (8, 3, 0, 5, "cc-by,reserved")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0)
    assert got[3].labels == "mit" and got[3].score == 1 and [b.start for b in got[3].blocks] == [1]
    assert got[4].labels == "mit" and abs(got[4].score - 0.8) < 1e-12
    assert got[5].n_base == 2 and got[6].n_base == 0 and got[7].labels == "apache-2.0"
    assert [got[i].labels for i in range(8, 13)] == ["cc-by,cc-by-nc-4.0", "cc-by,cc-by-sa-4.0", "cc-by,cc-by-4.0", "", "gpl"]
    assert [got[i].labels for i in (13, 14)] == ["bsd", "mpl-2.0"]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_license_join_equals_brute_force(spark, threshold):
    """All windows at all places where a word of the template stands, by sets."""
    rng = random.Random(4)
    pool = licenses.tokens_of(licenses.TEMPLATES) + ["x", "y"]
    texts = ["\n".join(" ".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(12)) for _ in range(25)]
    for _ in range(35):  # statements with words lost and put in
        w = rng.choices(pool, k=30)
        for t in rng.sample(licenses.TEMPLATES, 3):
            own = [x for x in t.text.split() if rng.random() > 0.1]
            own.insert(rng.randint(0, len(own)), "x")
            w[rng.randrange(30) : 0] = own
        texts.append(" ".join(w))
    docs, low = make(spark, texts), 0
    rows = {r.doc_id: r for r in licenses.scan(docs, licenses.vocabulary(docs, threshold=threshold)).collect()}
    for i, text in enumerate(texts):
        want = {}
        for t in licenses.TEMPLATES:
            w, ts = text.split(), set(t.tokens)
            for at in range(len(w)):
                if w[at] not in ts:
                    continue
                block = set(w[at : at + t.window])
                share = len(block & ts) / len(ts)
                if len(block & ts) >= max(1, math.ceil(threshold * len(ts) - 1e-9)) and set(t.needs.split()) <= block and not block & set(t.lacks.split()):
                    want[t.label] = max(want.get(t.label, 0), share)
        got = {}
        for b in rows[i].blocks:
            got[b.label] = max(got.get(b.label, 0), b.share)
        assert {k: round(x, 9) for k, x in got.items()} == {k: round(x, 9) for k, x in want.items()}
        assert abs(rows[i].score - max(want.values(), default=0)) < 1e-9
        low += len(want)
    assert low > 30


def similarity(a, b):
    x, y = Counter(zip(*(a[k:] for k in range(min(5, len(b)))), strict=False)), Counter(zip(*(b[k:] for k in range(min(5, len(b)))), strict=False))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_decontamination(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(12, 40))) for _ in range(12)] + ["just three words", None, ""]
    texts = []
    for _ in range(80):
        t = rng.choices(vocabulary, k=rng.randint(3, 120))
        if rng.random() < 0.7:
            w = rng.choice(items[:12]).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edited"
            at = rng.randint(0, len(t))
            t[at:at] = w[: rng.choice([len(w), len(w), len(w) - 3])]
        texts.append(" ".join(t).upper())
    texts += [items[0], items[1][: len(items[1]) * 9 // 10], "it is JUST three words here", "just three", None, ""]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (16 << 20, 300):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(make(spark, texts), benchmark, decontaminate.Settings(block_bytes=block)).collect()}
        want = {}
        for i, t in enumerate(texts):
            for j, item in enumerate(items):
                a, b = words(t), words(item)
                n = min(len(a), len(b))
                if b and n >= min(5, len(b)):
                    best = max(similarity(a[s : s + n], b) for s in range(len(a) - n + 1))
                    if best >= 0.75:
                        want[i, j] = best
        assert set(got) == set(want)
        assert all(abs(got[k].similarity - want[k]) < 1e-12 for k in want)
    kept = decontaminate.drop_contaminated(make(spark, texts), benchmark)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}


@pytest.mark.parametrize("n_items", [1, 40, 9000])
def test_block_index_alone_gives_all_pairs_within_the_radius(n_items):
    rng = np.random.default_rng(n_items)
    items = rng.integers(0, 1 << 16, (n_items, decontaminate.BLOCKS), dtype=np.uint16)
    windows = items[rng.integers(0, n_items, 60)].copy()
    for k, w in enumerate(windows):  # k bits turned
        for bit in rng.permutation(128)[:k]:
            w[bit // 16] ^= np.uint16(1 << (bit % 16))
    far = np.array([[int(np.bitwise_count(w ^ i).sum()) for i in items] for w in windows]) if n_items < 100 else np.bitwise_count(windows[:, None] ^ items[None]).sum(axis=2, dtype=np.int64)
    for radius in (7, 40):
        w, i = decontaminate.BlockIndex(items, radius).pairs(windows)
        assert list(zip(w.tolist(), i.tolist(), strict=True)) == [tuple(x) for x in np.argwhere(far <= radius).tolist()]
    assert decontaminate.BlockIndex(items, 40).pairs(windows[:0])[0].size == 0


@pytest.mark.parametrize("n", [21, 35, 70, 140, 280])
def test_decontamination_of_windows_that_repeat_a_shingle(spark, n):
    """Windows at 0.75 exactly, cut passages followed by a run, and items with runs of their own."""
    rng = random.Random(n)
    items = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n + 4)) for _ in range(8)]
    items += [" ".join(["="] * (n // 7) + t.split()[: n + 4 - n // 7]) for t in items[:4]]
    texts = []
    for item in items:
        w = item.split()
        for cut in (n // 7, n // 7 + 1):
            texts.append(" ".join(["before"] * 9 + w[: len(w) - cut] + ["="] * cut + [f"x{rng.randrange(10**6)}" for _ in range(30)]))
            texts.append(" ".join([f"x{rng.randrange(10**6)}" for _ in range(30)] + ["="] * cut + w[cut:]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(make(spark, texts), benchmark).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            a, b = words(t), words(item)
            best = max(similarity(a[s : s + len(b)], b) for s in range(len(a) - len(b) + 1))
            if best >= 0.75:
                want[i, j] = best
    assert len(want) >= 12 and got == want


def test_language_model(spark):
    texts = corpus(n=80)
    train = texts[::2]
    model = kneser_ney.count(make(spark, train), new_path(spark, "lm"), word_parts=5, pairs_in_part=500)
    got = {r.doc_id: r for r in kneser_ney.score(make(spark, texts), model).collect()}
    one, two = Counter(), Counter()
    for t in train:
        w = [*words(t), "END"]
        one.update(w)
        two.update(zip(["START", *w[:-1]], w, strict=True))
    n, v = sum(one.values()), len(one)
    assert (model.n_tokens, model.n_types, model.n_pairs) == (n, v, len(two))
    before = Counter(b for _, b in two)
    after, follow = Counter(), {}
    for (a, _), c in two.items():
        after[a] += c
        follow.setdefault(a, [0, 0, 0])[min(c, 3) - 1] += 1
    counts = lambda xs: [sum(c == k for c in xs) for k in (1, 2, 3, 4)]
    d, e = kneser_ney.discounts(counts(two.values())), kneser_ney.discounts(counts(before.values()))
    rest = sum(e[min(c, 3) - 1] for c in before.values()) / len(two)

    def alone(b):
        c = before[b]
        return (c - (e[min(c, 3) - 1] if c else 0)) / len(two) + rest / (v + 1)

    def pair(a, b):
        if not after[a]:
            return alone(b)
        c = two[a, b]
        return (c - (d[min(c, 3) - 1] if c else 0) + sum(x * y for x, y in zip(d, follow[a], strict=True)) * alone(b)) / after[a]

    for i, t in enumerate(texts):
        w = [*words(t), "END"]
        assert (got[i].n_tokens, got[i].n_known) == (len(w), sum(x in one for x in w))
        assert abs(got[i].base_score - sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6
        assert abs(got[i].score - sum(math.log10(pair(a, b)) for a, b in zip(["START", *w[:-1]], w, strict=True))) < 1e-6
    assert abs(sum(pair(words(train[0])[0], b) for b in one) + pair(words(train[0])[0], "never") - 1) < 1e-9


def test_language_model_of_order_3(spark):
    texts = corpus(n=80) + ["a b c a b d"] * 3 + [" ".join(["a b"] + [f"f{i}"]) for i in range(300)]
    train = texts[::2]
    fitted = kneser_ney.fit(make(spark, train))
    model = kneser_ney.count(make(spark, train), new_path(spark, "lm"), word_parts=5, pairs_in_part=500, order=3)
    assert fitted.triples is not None and sum(n for _, n in fitted.triples) == sum(n for _, n in model.triples)
    raw, three = Counter(), Counter()
    for t in train:
        w = ["START", *words(t), "END"]
        raw.update(zip(w, w[1:], strict=False))
        three.update(zip(w, w[1:], w[2:], strict=False))
    two = Counter((b, c) for _, b, c in three) + Counter({k: n for k, n in raw.items() if k[0] == "START"})
    one = Counter(b for _, b in raw)
    assert set(two) == set(raw) and sum(n for _, n in model.triples) == len(three)
    counts = lambda xs: [sum(c == k for c in xs) for k in (1, 2, 3, 4)]
    d1, d2, d3 = (kneser_ney.discounts(counts(x.values())) for x in (one, two, three))
    cut = lambda d, c: d[min(c, 3) - 1] if c else 0
    total, gone = Counter(), Counter()
    for table, d in ((two, d2), (three, d3)):
        for k, c in table.items():
            total[k[:-1]] += c
            gone[k[:-1]] += cut(d, c)
    rest = sum(cut(d1, c) for c in one.values()) / len(raw)

    def p(*k):
        if len(k) == 1:
            return (one[k[0]] - cut(d1, one[k[0]])) / len(raw) + rest / (len(one) + 1)
        table, d = (two, d2) if len(k) == 2 else (three, d3)
        lower = p(*k[1:])
        return (table[k] - cut(d, table[k]) + gone[k[:-1]] * lower) / total[k[:-1]] if total[k[:-1]] else lower

    got = {r.doc_id: r for r in kneser_ney.score(make(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        w = ["START", *words(t), "END"]
        want = sum(math.log10(p(*w[max(0, j - 2) : j + 1])) for j in range(1, len(w)))
        assert abs(got[i].score - want) < 1e-6
    assert abs(sum(p("a", "b", x) for x in one) + p("a", "b", "never") - 1) < 1e-9


def test_language_model_maps_a_bounded_number_of_files(spark):
    texts = corpus(n=20) + ["a b c a b d"] * 3
    few = kneser_ney.count(make(spark, texts), new_path(spark, "lm"), word_parts=5, pairs_in_part=500, order=3)
    assert few.n_tokens > 2 * kneser_ney.MOST_PARTS
    model = kneser_ney.count(make(spark, texts), new_path(spark, "lm"), word_parts=5, pairs_in_part=1, order=3)
    opened = len(os.listdir("/proc/self/fd"))
    scorer = kneser_ney.Scorer(model)
    assert scorer and len(os.listdir("/proc/self/fd")) - opened < 100  # 20,000 are what a process may have
    assert len(model.pairs) == len(model.triples) == kneser_ney.MOST_PARTS
    one, other = ({r.doc_id: r.score for r in kneser_ney.score(make(spark, texts), m).collect()} for m in (few, model))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-9 for k in one)


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_of_parts_beyond_what_a_task_holds(spark, order):
    texts = corpus(n=80) + ["a b c a b d"] * 3 + [f"a b f{i}" for i in range(600)]
    train = make(spark, texts[::2]).repartition(4)
    whole = kneser_ney.count(train, new_path(spark, "lm"), word_parts=2, pairs_in_part=500, order=order)
    pieces = kneser_ney.count(train, new_path(spark, "lm"), word_parts=2, pairs_in_part=500, order=order, at_once=40)
    assert max(n for _, n in pieces.pairs) > 80
    for x in ("n_tokens", "n_types", "n_pairs", "discounts", "word_discounts", "triple_discounts"):
        assert getattr(whole, x) == getattr(pieces, x)
    one, other = ({r.doc_id: r.score for r in kneser_ney.score(make(spark, texts), m).collect()} for m in (whole, pieces))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-9 for k in one)


@pytest.mark.parametrize("mixed", [False, True])
def test_merged_blobs(mixed):
    rng = np.random.default_rng(3)
    want, blobs = Counter(), []
    for _ in range(40):
        keys = np.unique(tx.mix(rng.integers(0, 3000, 200).astype(np.uint64)))
        n = rng.integers(1, 9, len(keys))
        blobs.append(kneser_ney.pack(keys, n))
        want.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    pieces = list(kneser_ney.merged(iter(blobs), mixed, 300))
    keys, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
    assert len(pieces) > 3 and max(len(k) for k, _ in pieces) < 600 and (keys[1:] > keys[:-1]).all()
    assert dict(zip((kneser_ney.unmix(keys) if mixed else keys).tolist(), n.tolist(), strict=True)) == want
    assert not list(kneser_ney.merged(iter([]), mixed))


def test_language_model_without_training_rows(spark):
    model = kneser_ney.fit(make(spark, []))
    rows = kneser_ney.score(make(spark, ["a b", None]), model).collect()
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in rows)


def labelled(spark, n=600):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(200)]
    texts, toxic, good = [], [], []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randint(5, 60))
        toxic.append(i % 5 == 0)
        good.append(i % 4 != 0)
        if toxic[-1]:
            w += rng.choices(["horrid", "vilest", "rotten"], k=3)
        if not good[-1]:
            w = [x + rng.choice(["***", "!!"]) for x in w]
        rng.shuffle(w)
        texts.append(" ".join(w))
    docs = make(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(g), int(t)) for i, (g, t) in enumerate(zip(good, toxic, strict=True))], "doc_id long, quality int, toxic int")
    return docs, labels, toxic, good


def sparse(texts, hashing):
    """Rows of features, and each row as a dictionary."""
    bounds, index, values = rows = hashing(*tx.flat(pa.array(texts)))
    return rows, [dict(zip(index[a:b].tolist(), values[a:b].tolist(), strict=True)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_features_are_those_of_a_loop():
    hashing = features.Hashing(bits=12, prefixes=(2,))
    texts = ["ab abc ab", "", "xyz", "ab ! AB-abc"]
    rows, found = sparse(texts, hashing)
    assert [len(x) for x in found] == [3, 0, 2, 3]  # words, and beginnings of longer ones
    for text, x in zip(texts, found, strict=True):
        n = Counter(w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split())
        n.update(Counter(w[:2] + "_" for w in n.elements() if len(w) > 2))
        assert sorted(x.values()) == pytest.approx(sorted(math.log1p(c) * len(n) ** -0.25 for c in n.values()))
    at = np.array([3, 0, 0, 1])
    assert [a.tolist() for a in features.take(rows, at, block=2)] == [a.tolist() for a in features.take(rows, at)]
    assert features.take(rows, at)[2].tolist() == [v for i in at for v in list(found[i].values())]


def test_positive_unlabelled_training_is_that_of_a_plain_loop():
    rng = random.Random(3)
    words_ = [f"w{i}" for i in range(12)]
    toxic_texts = [" ".join(rng.choices(words_, k=4) + ["bad"] * 2) for _ in range(8)]
    free_texts = [" ".join(rng.choices(words_, k=6) + rng.choice([[], ["bad"]])) for _ in range(20)]
    s = toxicity.Settings(epochs=6, batch=8, rate=0.9, least_texts=10, hashing=features.Hashing(bits=10))
    (toxic_rows, toxic), (free_rows, free) = sparse(toxic_texts, s.hashing), sparse(free_texts, s.hashing)
    prior = 0.45
    draw = np.random.default_rng(s.seed)
    w, bias, squares = dict.fromkeys({f for x in toxic + free for f in x}, 0.0), math.log(prior / (1 - prior)), {}
    texts = Counter(f for x in toxic + free for f in x)
    soft, sig = (lambda z: math.log1p(math.exp(z))), (lambda z: 1 / (1 + math.exp(-z)))
    turned = 0
    for _ in range(s.epochs):
        for at in np.array_split(draw.permutation(20), 2):
            a = [toxic[i] for i in draw.choice(8, 2, replace=False)]
            u = [free[i] for i in at]
            za, zu = ([bias + sum(w[f] * v for f, v in x.items()) for x in xs] for xs in (a, u))
            if sum(map(soft, zu)) / len(u) - prior * sum(map(soft, za)) / len(a) >= 0:
                ga, gu = [prior * (2 * 0 + sig(z) - 1 - sig(z)) / len(a) for z in za], [sig(z) / len(u) for z in zu]
            else:
                turned += 1
                ga, gu = [prior * sig(z) / len(a) for z in za], [-sig(z) / len(u) for z in zu]
            step = {f: s.l2 * v for f, v in w.items()}
            for g, x in zip(ga + gu, a + u, strict=True):
                for f, v in x.items():
                    step[f] += g * v
            step[None] = sum(ga) + sum(gu)
            for f, g in step.items():
                if f is not None and texts[f] < min(s.least_texts, 28 / 100):
                    continue
                squares[f] = squares.get(f, 1e-3) + g * g
                change = s.rate * g / math.sqrt(squares[f])
                if f is None:
                    bias -= change
                else:
                    w[f] -= change
    got, got_bias = toxicity.nn_pu(toxic_rows, free_rows, prior, s)
    assert turned and got_bias == pytest.approx(bias, abs=1e-9)
    assert all(got[f] == pytest.approx(v, abs=1e-9) for f, v in w.items()) and np.count_nonzero(got) <= len(w)


def test_ftrl_is_that_of_a_plain_loop():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["good", "fine", "poor", "junk", "plain"], k=6)) for _ in range(20)]
    y = [float("good" in t) for t in texts]
    s = quality.Settings(epochs=4, l1=0.05, hashing=features.Hashing(bits=10, bigrams=True))
    rows, xs = sparse(texts, s.hashing)
    z, n = Counter(), Counter()

    def weight(f):
        l1, l2 = (0.0, 0.0) if f is None else (s.l1, s.l2)
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((s.beta + math.sqrt(n[f])) / s.alpha + l2)

    draw = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in draw.permutation(20):
            x = xs[i] | {None: 1.0}
            w = {f: weight(f) for f in x}
            error = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items()))) - y[i]
            for f, v in x.items():
                g = error * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / s.alpha * w[f]
                n[f] += g * g
    got, bias = quality.ftrl(rows, np.array(y), s)
    assert bias == pytest.approx(weight(None), abs=1e-9)
    assert all(got[f] == pytest.approx(weight(f), abs=1e-9) for f in {f for x in xs for f in x})


def test_pivot_is_that_of_a_plain_loop():
    rng = np.random.default_rng(8)
    size, p = rng.integers(1, 90, 37).astype(float), rng.random(37)
    p[::9] = 1.0
    draw, want = np.random.default_rng(2), p.tolist()
    open_ = [i for i, x in enumerate(want) if 0 < x < 1]
    while len(open_) > 1:
        n, rest = len(open_) // 2, []
        for k, r in enumerate(draw.random(n)):
            i, j = open_[2 * k], open_[2 * k + 1]
            to_i, to_j = min((1 - want[i]) * size[i], want[j] * size[j]), min(want[i] * size[i], (1 - want[j]) * size[j])
            gain, lose, moved = (i, j, to_i) if r * (to_i + to_j) < to_j else (j, i, to_j)
            want[gain] += moved / size[gain]
            want[lose] -= moved / size[lose]
            rest += [x for x in (i, j) if 1e-9 < want[x] < 1 - 1e-9]
        open_ = rest + open_[2 * n :]
    got = mixing.pivot(p, size, np.random.default_rng(2))
    assert np.allclose(got, want, atol=1e-9) and abs(got @ size - p @ size) < 1e-6


def test_toxicity(spark):
    docs, labels, toxic, _ = labelled(spark)
    may = "doc_id % 4 <> 2"
    model = toxicity.train(docs.where(may), labels.where(may))
    assert abs(model.prior - 0.2) < 0.05
    got = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(600) if i % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == toxic[i] for i in held]) > 0.95
    few = toxicity.train(docs.where(may), labels.where(may).where("doc_id % 3 = 0"))  # most documents are without a label
    scored = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), few).collect()}
    assert np.mean([(scored[i] >= 0.3) == toxic[i] for i in held]) > 0.9 and not np.allclose(few.weights, model.weights)
    short = toxicity.train(docs.where(may), labels.where(may), toxicity.Settings(longest=1))  # no text to learn from
    assert not short.weights.any()
    none = toxicity.train(docs, labels.where("false"))
    assert none.prior == 0 and toxicity.score(docs.select("doc_id", "text"), none).where("abs(score - 0.018) < 0.001").count() == 602
    twice = toxicity.train(docs.unionByName(docs).where(may), labels.where(may))  # rows that share a doc_id count once
    assert np.allclose(twice.weights, model.weights)


def test_quality(spark):
    docs, labels, _, good = labelled(spark)
    may = "doc_id % 3 <> 1"
    model = quality.train(docs.where(may), labels.where(may))
    got = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    held = [i for i in range(600) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == good[i] for i in held]) > 0.97
    assert quality.score(docs.select("doc_id", "text"), quality.train(docs, labels.where("false"))).where("score = 0.5").count() == 602


def test_empty_tables(spark):
    empty = make(spark, [])
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_groups(empty).count() == 0
    assert minhash.duplicate_groups(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert licenses.scan(empty, licenses.vocabulary(empty)).count() == 0
    assert decontaminate.matches(empty, benchmark).count() == 0
    assert decontaminate.matches(make(spark, ["a b c d e f"]), benchmark.where("false")).count() == 0
    assert toxicity.score(empty.select("doc_id", "text"), toxicity.train(empty, labels)).count() == 0
    assert quality.score(empty.select("doc_id", "text"), quality.train(empty, labels)).count() == 0
