"""Exact dedup by two passes of Bloom filtering. Native.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Of equal texts the row
with the most code points before that stays, then the one with the smallest doc_id (null last), then the first row.

How. Each text is read once and leaves a digest row (id, length, SHA-256, 64-bit hash); texts are never shuffled. A
filter has ``CELLS`` cells for each row. A pass adds every hash to its cell and keeps the cells hit at least twice, as
words of 64 bits in blocks of ``BLOCK`` words; rows whose cell was hit once are told from all others and pass straight through. A second pass
with another hash function does so again for what is left, so of the rows without a copy about one in seventy goes on. A repeated
hash hits its cell at least twice in both passes: no copy is ever missed. Only the rows that both filters suspect are
shuffled, grouped by their SHA-256, which decides. What a pass itself moves are counts of cells, one for each cell that a task has hit.

Filters are broadcast, so their size is bounded: rows are cut into slices by hash, each of about ``SLICE`` rows, whose
filter has 2 * ``CELLS`` * ``SLICE`` cells at most (16 MB as registered). The number of slices follows the number of rows. Digests are sorted by
hash in each file, so that a slice reads its own row groups.

A group of copies of any size is a partial aggregate in each task; its rows are then joined with the one row that stays, where Spark
splits a large partition.

Cases: null texts and texts of white space equal the empty text; very long texts are hashed whole; repeated rows are copies of each other;
null ids come last and are a document each; columns besides doc_id and text are kept by :func:`dedup_documents`, whatever their
names, and ignored by :func:`exact_dedup`; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACES = " \t\n\x0b\x0c\r"
#: Cells of a filter for each row.
CELLS = 8
#: Rows of a slice, and 64-bit words in a block of a filter.
SLICE, BLOCK = 8_000_000, 1024
LAST = 2**63 - 1


def digests(d: DataFrame) -> DataFrame:
    """``rid, doc_id, points`` (code points of the whole text), ``sha`` (of what is left without white space) and ``h``."""
    text = F.coalesce("text", F.lit(""))
    rows = d.select("rid", "doc_id", F.length(text).cast("long").alias("points"), F.sha2(F.translate(text, SPACES, ""), 256).alias("sha"))
    return C.table(rows.withColumn("h", F.xxhash64("sha")).sortWithinPartitions("h"), "digests")


def _suspects(rows: DataFrame, cells: int, salt: int) -> DataFrame:
    """``rows`` with ``suspect``: false if no other row hits the cell of its ``h``. ``cells``: a power of two, 64 * BLOCK at least.

    The filter has ``cells`` bits at most and is broadcast."""
    cell = F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(cells))
    hit = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).where("n > 1")
    bit = F.expr("shiftleft(1L, CAST(cell % 64 AS INT))")
    words = hit.groupBy(F.expr(f"cell DIV {64 * BLOCK}").alias("block"), F.expr(f"CAST(cell DIV 64 % {BLOCK} AS INT)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    block = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m")).select("block", F.expr(f"transform(sequence(0, {BLOCK - 1}), i -> coalesce(m[i], 0L))").alias("bitmap"))
    probed = rows.withColumn("cell", cell).withColumn("block", F.expr(f"cell DIV {64 * BLOCK}")).join(F.broadcast(block), "block", "left")
    seen = F.expr(f"coalesce(shiftrightunsigned(bitmap[CAST(cell DIV 64 % {BLOCK} AS INT)], CAST(cell % 64 AS INT)) & 1L, 0L) = 1L")
    return probed.select(*rows.columns, seen.alias("suspect"))


def marked(rows: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """:func:`digests` with ``suspect``: false only where no other row has the hash."""
    n = rows.count()
    slices = max(1, -(-n // slice_rows))
    cells = max(64 * BLOCK, 1 << (CELLS * max(1, -(-n // slices)) - 1).bit_length())
    out = []
    for s in range(slices):
        low, high = -(2**63) + s * 2**64 // slices, -(2**63) + (s + 1) * 2**64 // slices - 1
        part = rows.where((F.col("h") >= F.lit(low)) & (F.col("h") <= F.lit(high))) if slices > 1 else rows
        once = C.table(_suspects(part, cells, 1), "first-pass")
        left = once.where("suspect").drop("suspect")
        out.append(C.table(_suspects(left, cells, 2).unionByName(once.where("NOT suspect")), "marked"))
        C.drop(once)
    return reduce(DataFrame.unionByName, out)


def exact_groups(d: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """For documents with ``rid``: ``rid, doc_id, sha, keep_id, group_size, kept``."""
    rows = digests(d)
    told = marked(rows, slice_rows)
    best = F.struct((-F.col("points")).alias("p"), F.coalesce("doc_id", F.lit(LAST)).alias("o"), "rid", "doc_id")
    suspects = told.where("suspect")
    heads = suspects.groupBy("sha").agg(F.min(best).alias("x"), F.count("*").alias("group_size"))
    heads = heads.select("sha", F.col("x.doc_id").alias("keep_id"), F.col("x.rid").alias("keep_rid"), "group_size")
    grouped = suspects.join(heads, "sha").select("rid", "doc_id", "sha", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"))
    alone = told.where("NOT suspect").select("rid", "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def exact_dedup(docs: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """Per document, dropped ones too: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    return exact_groups(C.keyed(docs), slice_rows).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that equal one that stays; what stays is not shuffled by its text, only the ids that go."""
    d, back = C.carried(docs)
    d = C.keyed(d, *C.others(d))
    gone = exact_groups(d).where("NOT kept").select("rid")
    return d.join(gone, "rid", "left_anti").select(*back)


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, length(text) AS points, sha256(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS sha FROM n)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
 doc_id = first_value(doc_id) OVER w AS kept, sha AS text_sha256
FROM s WINDOW w AS (PARTITION BY sha ORDER BY points DESC, doc_id)
"""
