"""Line dedup by content-defined chunks of lines: chunks that repeat anywhere in the table are removed but for their first
place. Native.

Boundaries come from a rolling hash over two neighbouring lines. A chunk opens at a line if the hash of it and the next
line is divisible by ``EVERY``, and closes at the first line from there on for which other digits of the hash
of the line before and itself are (a text's first and last lines always open and close one). Another opens behind each closing line, so that
no line between the first opening and the last closing one is left out. So a chunk has two
lines or more, 1 + ``EVERY`` on average within a long text, and hangs on nothing but its own lines: text put in before or behind a passage
shifts no boundary within it. What a repeated passage loses are the lines before its first opening and behind its last closing one,
``EVERY`` - 1 lines at each end on average, none where it begins or ends a text; so passages of two or three lines in foreign surroundings often stay.

Hashes (64 bits) only choose candidates. The lines of chunks whose hash repeats are fetched and grouped by their bytes;
equal bytes decide. The first place is that of the smallest doc_id (null last), then the first in the text. A chunk that
overlaps its own first place (a line three times in a row) is no repeat of it. So each distinct line keeps a place; but
where two repeated passages share a line in the first place of one of them, that line stays only in its own first place.

Texts are shuffled once, to meet the places of their candidates, and those that lose lines once more; untouched texts
are not. Sides that hold places alone are hashed, texts are never sorted.

Cases: a null text stays null; empty texts, single lines and chunks without a word stay; repeated rows are repeats of
each other (the first stays); ids may be null or repeated; columns besides doc_id and text are kept by
:func:`dedup_documents`, whatever their names, and ignored by :func:`line_dedup`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: One in so many lines opens a chunk, and one in so many closes one.
EVERY = 2
WORD = r"[^\\x20\\x09-\\x0D]"
#: First line, last line and hash of each chunk with a word. Lambdas bind lines, hashes and ends once.
CHUNKS = f"""
transform(array(split(text, '\\n')), ls -> transform(array(transform(filter(sequence(0, size(ls) - 1), i -> i < size(ls) - 1), i -> xxhash64(ls[i], ls[i + 1]))), r ->
 transform(array(filter(sequence(0, size(r) - 1), e -> size(r) > 0 AND (e = size(r) - 1 OR pmod(shiftright(r[e], 16), {EVERY}) = 0))), ends ->
  transform(filter(transform(
    flatten(transform(ends, (e, k) -> transform(filter(sequence(if(k = 0, 0, ends[greatest(k - 1, 0)] + 1), e), i -> i = 0 OR pmod(r[i], {EVERY}) = 0 OR coalesce(pmod(shiftright(get(r, i - 2), 16), {EVERY}) = 0, false)), i -> struct(i, e + 1 AS j)))),
    c -> struct(c.i, c.j, array_join(slice(ls, c.i + 1, c.j - c.i + 1), '\\n') AS body)), c -> c.body RLIKE '{WORD}'),
   c -> struct(c.i, c.j, xxhash64(c.body) AS h)))[0])[0])[0]
"""


def line_dedup(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, text``, ``removed`` (the first line, from 0, of each removed stretch), ``n_removed_lines``
    and ``text_before``."""
    return _dedup(C.keyed(docs))


def _dedup(d: DataFrame) -> DataFrame:
    """:func:`line_dedup` for documents with ``rid``; columns named by :func:`.common.carried` are kept."""
    rest = C.others(d)
    # explode_outer of an array that a projection of its own has made: no filter on its size computes it again
    each = d.where("contains(text, '\n')").select("rid", F.expr(CHUNKS).alias("chunks")).select("rid", F.explode_outer("chunks").alias("x"))
    each = C.table(each.where("x IS NOT NULL").select("rid", "x.*"), "chunks")
    again = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    asked = each.join(again, "h").groupBy("rid").agg(F.collect_list(F.struct("i", "j", "h")).alias("asked"))
    # places are small beside texts: they are the hashed side, and texts stream past them
    met = C.table(d.join(asked.hint("shuffle_hash"), "rid", "left"), "texts")
    C.drop(each)
    del each, again, asked  # else their shuffles stay
    C.release(d.sparkSession)

    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "rid", "x.i", "x.j").alias("at")
    bodies = met.where("asked IS NOT NULL").select("rid", "doc_id", F.split("text", "\n").alias("lines"), F.explode("asked").alias("x"))
    bodies = C.table(bodies.select("x.h", F.expr("array_join(slice(lines, x.i + 1, x.j - x.i + 1), '\n')").alias("body"), place), "bodies")
    first = bodies.groupBy("h", "body").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "body", "first")
    gone = bodies.join(first, ["h", "body"]).where("at.rid <> first.rid OR at.i > first.j")
    gone = C.table(gone.groupBy(F.col("at.rid").alias("rid")).agg(F.collect_list(F.struct("at.i", "at.j")).alias("cut")), "gone")
    C.drop(bodies)

    same = met.where("asked IS NULL").select("doc_id", "text", *rest, F.array().cast("array<int>").alias("gone"))
    cut = F.expr("array_sort(array_distinct(flatten(transform(coalesce(cut, array()), x -> sequence(x.i, x.j)))))").alias("gone")
    some = met.where("asked IS NOT NULL").join(gone.hint("shuffle_hash"), "rid", "left").select("doc_id", "text", *rest, cut)
    out = some.unionByName(same).withColumn("lines", F.when(F.size("gone") > 0, F.split("text", "\n")))
    return out.select(
        "doc_id",
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')")).alias("text"),
        *rest,
        F.expr("array_except(gone, transform(gone, i -> i + 1))").alias("removed"),
        F.size("gone").cast("long").alias("n_removed_lines"),
        F.col("text").alias("text_before"),
    )


def dedup_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts (and n_chars, if there) after line dedup; a text of which no word is left goes."""
    d, back = C.carried(docs)
    r = _dedup(C.keyed(d, *C.others(d))).where(F.col("n_removed_lines").eqNullSafe(0) | F.col("text").rlike(C.NOT_SPACE))
    if "n_chars" in docs.columns:
        n = f"carried{docs.columns.index('n_chars')}"
        r = r.withColumn(n, F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col(n)))
    return r.select(*back)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    r = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lines = F.when(F.col("text_before").isNull(), 0).otherwise(F.length("text_before") - F.length(F.translate("text_before", "\n", "")) + 1)
    return r.select("doc_id", lines.cast("long").alias("n_lines"), "n_removed_lines", F.size("removed").cast("long").alias("n_removed_chunks"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
