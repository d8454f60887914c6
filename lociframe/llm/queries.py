"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import decontaminate, exact_dedup, fim, kneser_ney, licenses, minhash, mixing, packing, periodic, quality, tokens, toxicity, warc
from lociframe.llm.scratch import materialize, small_batches

#: Name of the tokenizer file of op6 and of the pipeline.
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo ``n``; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    may = remainder(4) != 2
    model = toxicity.train(docs.where(may), labels.where(may))
    scored = toxicity.score(docs.withColumn("held_out", remainder(4) == 2), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicate_groups(table(spark, sf_dir, "documents"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    may = remainder(3) != 1
    model = quality.train(docs.where(may), labels.where(may))
    scored = quality.score(docs.withColumn("held_out", remainder(3) == 1), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.vocabulary(docs)).drop("blocks")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.fit(docs.where(remainder(5) != 1))
    scored = kneser_ney.score(docs, model).withColumn("held_out", remainder(5) == 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def repeated_part(doc_id: int | None, n: int) -> np.ndarray | None:
    """For each tenth document by the hash of its doc_id, from which word each of its ``n`` words is taken: a part is repeated to the end."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return np.append(np.arange(first), first + np.arange(n - first) % period)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), source=repeated_part)
    one, other = (lambda a, b: a["length"] * b["period"]), (lambda a, b: b["length"] * a["period"])
    order = lambda a, b: (
        F.when(one(a, b) > other(a, b), -1).when(one(a, b) < other(a, b), 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
        .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
    )
    best = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    back = made.withColumn("back", fim.restore(F.col("form"), F.col("output")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("back.sha256").alias("restored_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path(), encoding="utf-8") as f:
        definition = f.read()
    settings = packing.Settings()
    found = materialize(packing.pieces(table(spark, sf_dir, "documents"), definition, END_ID, settings.capacity), "pieces")
    return packing.pack(found, settings).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_toxicity, op2_warc, op3_exact_dedup, op4_mixing, op5_minhash, op6_token_ids, op7_quality, op8_licenses, op9_decontaminate, op10_lm, op11_periodic_runs, op12_fill_in_middle, op13_packing, pipeline)
    return {f.__name__: f for f in ops}


_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < keep THEN keep END AS refers_to
FROM m
"""

OP3 = f"""
WITH d AS (SELECT doc_id, sha256({_LOW.format('text')}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOW.format('text')}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def _licenses_sql() -> str:
    words = "regexp_extract_all(%s, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    quote = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
    phrases = ", ".join(f"({quote(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"({quote(t.tokens)}, {quote(t.needs.split())}::VARCHAR[], {quote(t.lacks.split())}::VARCHAR[], {t.window}, '{t.label}')" for t in licenses.TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, {_LOW.format('text')} AS t FROM documents),
w AS (SELECT doc_id, {words % 't'} AS ws FROM d),
phrases(ps, label) AS (VALUES {phrases}),
hits AS (
  SELECT doc_id, label, unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = ps[1] AND ws[i:i + len(ps) - 1] = ps)) - 1 AS place FROM w, phrases
),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS ls FROM hits GROUP BY doc_id
),
templates(ts, needs, lacks, size, label) AS (VALUES {templates}),
starts AS (
  SELECT doc_id, label, ts, needs, lacks, size, ws, unnest(list_filter(range(1, len(ws) + 1), lambda i: list_contains(ts, ws[i]))) AS i FROM w, templates WHERE list_has_any(ws, ts)
),
blocks AS (SELECT doc_id, label, ts, needs, lacks, list_distinct(ws[i:i + size - 1]) AS b FROM starts),
met AS (
  SELECT doc_id, label, len(list_intersect(b, ts)) / len(ts) AS share FROM blocks
  WHERE len(list_intersect(b, ts)) >= ceil(0.8 * len(ts) - 1e-9) AND list_has_all(b, needs) AND NOT list_has_any(b, lacks)
),
more AS (SELECT doc_id, list(DISTINCT label) AS ms, max(share) AS score FROM met GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(ls, []), coalesce(ms, [])))), ','), '') AS labels,
       coalesce(score, 0.0) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


OP12 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, list_transform(regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+'), lambda x: length(x)) AS sizes,
         list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS hs FROM d
), c AS (
  SELECT doc_id, t, len(sizes) AS n, sizes, hs, least(hs[1] % (len(sizes) + 1), hs[2] % (len(sizes) + 1)) AS a, greatest(hs[1] % (len(sizes) + 1), hs[2] % (len(sizes) + 1)) AS b FROM u
), f AS (
  SELECT doc_id, t, n, CAST(coalesce(list_sum(sizes[1:a]), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(sizes[a + 1:b]), 0) AS BIGINT) AS m,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 50 THEN 'plain' WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c
), o AS (
  SELECT *, '<P>' || substr(t, 1, p) AS x, '<M>' || substr(t, p + 1, m) AS y, '<S>' || substr(t, p + m + 1) AS z FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN z || x || y ELSE x || z || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2, "op3_exact_dedup": OP3, "op5_minhash": OP5, "op8_licenses": _licenses_sql(), "op12_fill_in_middle": OP12}
