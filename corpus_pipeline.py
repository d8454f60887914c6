"""A corpus from documents to token shards: each stage takes all rows that the one before kept.

The stages but the last return the columns of documents; the last returns one row for each
document of the written shards. A stage's documents are a table read from Parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import decontaminate, minhash, mixing, tokens, toxicity
from lociframe.llm.queries import END_ID, remainder, table, tokenizer_path
from lociframe.llm.scratch import ROW, columns, materialize, numbered_file_rows, plain, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below 0.3.

    Each row is scored by its own text (null: empty), with or without doc_id, and keeps all of
    its columns, whatever their names. An empty table stays empty.
    """
    may = remainder(4) != 2
    model = toxicity.train(docs.where(may), table(spark, sf_dir, "labels").where(may))
    scored = toxicity.score(docs.select(F.struct(*columns(docs)).alias("row"), "text"), model)
    return scored.where("score < 0.3").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id, null last.

    Rows without doc_id, equal rows and different texts under one doc_id are in groups like
    others. Rows without words are near to nothing and stay.
    """
    small_batches(spark)
    return minhash.keep_one(numbered_file_rows(docs, "rows"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark, with or without a doc_id; a null text holds none. Of rows with one doc_id only those that hold a passage go."""
    return decontaminate.drop_contaminated(numbered_file_rows(docs, "rows"), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; copies are rows of their own with all columns of the row.

    Rows without doc_id or that share one are copied each by its own number. Rows without
    words are not taken. A null source is a source. An empty table stays empty.
    """
    small_batches(spark)
    rows = numbered_file_rows(docs, "rows")
    counted = materialize(mixing.mix_sources(rows, carry=(ROW,)).where("copies > 0").select(ROW, "copies"), "copies")
    small = F.broadcast(counted) if counted.count() <= 1_000_000 else counted  # two numbers a row
    kept = rows.select(F.struct(*columns(plain(docs))).alias("row"), ROW).join(small, ROW)
    return kept.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: doc_id, start, n_tokens, ids_crc32. A null text has the end id alone; rows without doc_id come first."""
    small_batches(spark)
    return tokens.round_trip(plain(docs), tokenizer_path(), END_ID, cached=44 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("token ids", write_tokens),
]

#: Learned scores and random rounding have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
