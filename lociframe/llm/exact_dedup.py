"""Exact deduplication with a two-pass Bloom filter, in DataFrame operations only.

Pass one sets two cells of a blocked Bloom filter for each row's hash and keeps the cells
that were set more than once. Pass two tests each row against these: a row of which one
cell was set once only has no equal, and passes straight through. Only the others shuffle,
by their whole SHA-256, which decides.

The filter has 16 cells a row in blocks of 32,768 cells (4 KB), so its size is known before
it is used: up to ``broadcast_bytes`` it is broadcast, beyond that the narrow rows (id and
digest, never texts) are joined with it by block.

Defined cases: null text counts as empty. Equal texts with the same doc_id twice all count
in ``group_size`` and are all kept where that doc_id is the largest. A null doc_id never is
the largest unless the whole group has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.scratch import ROW, columns, materialize, numbered, plain
from lociframe.llm.text import lower_ascii

CELLS_IN_BLOCK = 32_768
BROADCAST_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def _cells(digest: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block (from 1) of a digest, and its two cells in the block (from 0)."""
    h = F.xxhash64(digest)
    first = F.pmod(F.shiftrightunsigned(h, 32), F.lit(CELLS_IN_BLOCK))
    second = F.pmod(F.shiftrightunsigned(h, 47), F.lit(CELLS_IN_BLOCK))
    return F.pmod(F.xxhash64(h), F.lit(blocks)) + 1, first, F.when(second == first, F.pmod(first + 1, F.lit(CELLS_IN_BLOCK))).otherwise(second)


def _is_set(cell: str) -> Column:
    byte = F.expr(f"cast(conv(hex(substring(bitmap, cast({cell} div 8 as int) + 1, 1)), 16, 10) as int)")
    return byte.bitwiseAND(F.expr(f"shiftleft(1, cast({cell} % 8 as int))")) != 0


def repeated_cells(rows: DataFrame, blocks: int) -> DataFrame:
    """The second filter: (block, bitmap) of the cells that more than one row has set."""
    block, first, second = _cells(F.col("digest"), blocks)
    cells = rows.select(block.alias("block"), F.explode(F.array(first, second)).alias("cell"))
    # counted as one number: cell ids travel, rows don't
    again = cells.select((F.col("block") * CELLS_IN_BLOCK + F.col("cell")).alias("cell")).groupBy("cell").count().where("count > 1")
    return again.groupBy(F.floor(F.col("cell") / CELLS_IN_BLOCK).alias("block")).agg(
        F.bitmap_construct_agg(F.pmod("cell", F.lit(CELLS_IN_BLOCK))).alias("bitmap")
    )


def exact_groups(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "digests")
    blocks = max(1, -(-16 * rows.count() // CELLS_IN_BLOCK))
    filters = materialize(repeated_cells(rows, blocks), "bloom")
    block, first, second = _cells(F.col("digest"), blocks)
    tested = rows.withColumns({"block": block, "first": first, "second": second})
    tested = tested.join(F.broadcast(filters) if blocks * CELLS_IN_BLOCK // 8 <= broadcast_bytes else filters, "block", "left")
    maybe = F.coalesce(_is_set("first") & _is_set("second"), F.lit(False))
    tested = tested.select("doc_id", "digest", maybe.alias("maybe"))

    again = tested.where("maybe").select("doc_id", "digest")
    groups = again.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = materialize(groups, "groups")
    small = groups.count() * 128 <= broadcast_bytes
    joined = again.join(F.broadcast(groups) if small else groups, "digest", "left")
    alone = tested.where("not maybe").select("digest", "doc_id", F.lit(None).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(size > 1, F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.unionByName(alone).select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the largest doc_id, null last.

    Rows are told apart by numbers of their own: of rows that share a doc_id only those whose text is equal to another go.
    """
    rows = numbered(docs, "rows")
    groups = exact_groups(rows.select(F.col(ROW).alias("doc_id"), "text")).where("group_size > 1")
    groups = groups.select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("class")).join(rows.select(ROW, "doc_id"), ROW)
    groups = materialize(groups, "group-members")
    best = groups.groupBy("class").agg(F.max(F.struct("doc_id", ROW))[ROW].alias("best"))
    best = materialize(best, "best")
    best = F.broadcast(best) if best.count() * 64 <= BROADCAST_BYTES else best
    dropped = materialize(groups.join(best, "class").where(F.col(ROW) != F.col("best")).select(ROW), "dropped")
    return rows.join(dropped, ROW, "left_anti").select(*columns(plain(docs)))
