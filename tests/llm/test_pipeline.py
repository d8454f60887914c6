import os

import duckdb
import pytest

import __spark_entry__ as entry

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    from lociframe.llm import decontaminate, minhash, queries
    from lociframe.llm.scratch import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near-dedup", "decontamination", "mixing", "token ids"]
    columns, before = docs.columns, docs.count()
    docs = materialize(stages["toxicity"](spark, docs, sf_dir), "t")
    assert docs.columns == columns and 0 < docs.count() < before
    deduped = materialize(stages["near-dedup"](spark, docs, sf_dir), "t")
    assert deduped.columns == columns and minhash.duplicate_groups(deduped).where("not kept").count() == 0
    clean = materialize(stages["decontamination"](spark, deduped, sf_dir), "t")
    assert clean.columns == columns and decontaminate.matches(clean, queries.table(spark, sf_dir, "benchmark")).count() == 0
    mixed = materialize(stages["mixing"](spark, clean, sf_dir), "t")
    assert mixed.columns == columns
    words = lambda df: df.selectExpr("sum(size(filter(split(text, '[ \\t\\n\\r]+'), x -> x <> '')))").first()[0]
    assert abs(words(mixed) / words(clean) - 1.5) < 0.1
    out = stages["token ids"](spark, mixed, sf_dir).collect()
    assert len(out) == mixed.count()
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_stages_tell_rows_apart_by_more_than_doc_id(spark, sf_dir):
    """Rows without doc_id and rows that share one are linked, dropped and copied like others."""
    from lociframe.llm.queries import table

    stages = dict(corpus_pipeline.STAGES)
    passage = max((r.text for r in table(spark, sf_dir, "benchmark").collect() if r.text), key=lambda t: len(t.split()))
    text = lambda i, n=30: " ".join(f"v{i}x{j}" for j in range(n))
    make = lambda rows: spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())
    # equal rows, copies without doc_id, and one doc_id on two different texts
    docs = make([(5, text(1), "a"), (5, text(1), "a"), (None, text(1), "a"), (None, text(2), "a"), (None, text(2), "a"), (7, text(3), "a"), (7, text(4), "a"), (3, text(5), "a"), (9, text(5), "a")])
    assert found(stages["near-dedup"](spark, docs, sf_dir)) == [(False, 3, text(5)), (False, 5, text(1)), (False, 7, text(3)), (False, 7, text(4)), (True, 0, text(2))]
    docs = make([(None, f"{text(1)} {passage}", "a"), (None, text(2), "a"), (4, f"{text(3)} {passage}", "a"), (4, text(3), "a")])
    assert found(stages["decontamination"](spark, docs, sf_dir)) == [(False, 4, text(3)), (True, 0, text(2))]
    docs = make([(None if i % 3 == 0 else i // 4, text(i, 10 + i), "ab"[i % 2]) for i in range(60)])
    sizes, mixed = {text(i, 10 + i): 10 + i for i in range(60)}, [r.text for r in stages["mixing"](spark, docs, sf_dir).collect()]
    assert max(mixed.count(t) for t in sizes) <= 2 and all(t in sizes for t in mixed)
    assert abs(sum(map(sizes.get, mixed)) / sum(sizes.values()) - 1.5) < 0.05


def test_rows_of_files_have_the_same_numbers_in_each_scan(spark, tmp_path):
    from lociframe.llm.scratch import ROW, numbered_file_rows

    path = str(tmp_path / "docs")
    spark.range(500).selectExpr("id as doc_id", "cast(id % 7 as string) as text").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    one, two = numbered_file_rows(docs, "rows"), numbered_file_rows(docs.repartition(3), "rows")
    assert one.columns == ["doc_id", "text", ROW] and one.select(ROW).distinct().count() == 500
    assert sorted(one.collect()) == sorted(numbered_file_rows(docs, "rows").collect())
    assert two.select(ROW).distinct().count() == 500 and numbered_file_rows(one, "rows") is one


CLASHING = "score double, kept_text string, copies long, copy string, row string, node long, team long, component long, id long, label string, digest string, size long, n long, `a.b` string, `c``d` string"


@pytest.mark.parametrize("written", [False, True])
def test_stages_with_nulls_empty_tables_and_clashing_columns(spark, sf_dir, tmp_path, written):
    """All columns null in some row, an empty and a long text, rows that repeat, and names that operators use inside."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "one two three four five six", "en", "a", 7), (1, "one two three four five six", "en", "a", 7), (None, None, None, None, None), (2, "", None, "b", 0), (3, long, "en", None, 9), (None, "seven eight nine ten eleven twelve", "en", "a", 1)]
    extra = (0.5, "k", 7, "c", "r", 1, 2, 3, 4, "l", "d", 5, 6, "ab", "cd")
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    docs = spark.createDataFrame([r + (extra if i % 2 else (None,) * len(extra)) for i, r in enumerate(rows)], schema)
    if written:  # rows of files are told apart in another way
        docs.repartition(2).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    stages = dict(corpus_pipeline.STAGES)
    kept = {"toxicity": 6, "near-dedup": 6, "decontamination": 6}
    for name in ("toxicity", "near-dedup", "decontamination", "mixing"):
        got = stages[name](spark, docs, sf_dir)
        found = sorted(map(repr, got.collect()))
        assert got.columns == docs.columns and set(found) <= set(map(repr, docs.collect())), name
        if name == "near-dedup":
            assert len(found) == 5  # of the two equal rows one
        elif name in kept:
            assert len(found) == kept[name], name
        assert stages[name](spark, docs.where("false"), sf_dir).count() == 0, name
    out = stages["token ids"](spark, docs, sf_dir).collect()
    assert len(out) == 6 and sorted(r.n_tokens for r in out)[:2] == [1, 1]
    assert stages["token ids"](spark, docs.where("false"), sf_dir).count() == 0


@pytest.mark.parametrize("name", ["op2_warc", "op3_exact_dedup", "op8_licenses"])
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    frame = entry.queries()[name](spark, sf_dir)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    key = lambda r, cols: repr([round(r[cols.index(c)], 9) if isinstance(r[cols.index(c)], float) else r[cols.index(c)] for c in sorted(cols)])
    assert sorted(key(tuple(r), frame.columns) for r in frame.collect()) == sorted(key(r, names) for r in found.fetchall())
