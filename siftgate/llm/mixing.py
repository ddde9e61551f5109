"""Mixing sources to target weights by systematic sampling.

Targets: each source's share of all words by weight, at most ``limit`` times its own words; what that leaves over is
shared again by weight. The final targets are a water level: sources sorted by size over weight are capped one
after the other until the level of the rest lies below their caps.

Sampling: each document of a source expects target / size copies. Expected copies are summed up along the source,
one offset (from the seed and the source's name) is added, and a document is taken once for each whole number its
interval crosses. The sum along a source is its rate times the document's number, and numbers come from counts
per bucket, prefix sums over the buckets and a rank within each: no task sees a whole source. Buckets follow
document size, so that the words taken stay near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix-1"
#: Rows that a part of a source is meant to hold, 256 parts of a bin at least.
PART = 1_000_000


def _unit(text: Column) -> Column:
    """A number in [0, 1) from md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def targets(sizes: DataFrame, weights=WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``; sources by code point, null last. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("weight", w).withColumn("cap", limit * F.col("source_size").cast("double"))
    by = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(every))
    # the level if all sources before this one are capped; it holds from the first source that it does not cap
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    s = s.withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the number of words of its text."""
    return docs.withColumn("size", F.size(C.words(F.col("text"))).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of ``docs(doc_id, source, size)``: how often the mix takes the
    row (0: not at all).

    A null source is a source of its own, null texts have no words. A source without words gets target 0 and no
    copies. Repeated rows count each; null ids come first; other columns are left out but for those that
    :func:`.common.carried` has renamed; an empty table gives no rows. Sources are few: one row each goes through
    one task. Reruns give the same rows, as order and offsets depend on ids, sizes and the seed alone.
    """
    d = docs.select("doc_id", "source", "size", *C.others(docs))
    # bins by the bits of the size, each cut by id in as many parts as hold about PART rows of the table: none holds a
    # large part of a big source, and none grows with the table
    n = d.select(F.count("*").alias("n")).first()["n"]
    digits = max(2, len(f"{n // PART:x}"))
    d = d.withColumn("bin", F.length(F.bin("size"))).withColumn("cut", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, digits))
    d = d.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    cells = C.table(d.groupBy("name", "source", "bin", "cut").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "cells")
    t = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, limit)
    t = t.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    # prefix sums in two steps: of the bins of a source (one row each), and of the cuts of a bin
    bins = cells.groupBy("name", "bin").agg(F.sum("n").alias("n"))
    sofar = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("name", "bin", sofar(["name"], "bin").alias("base"))
    cells = cells.select("name", "bin", "cut", sofar(["name", "bin"], "cut").alias("inner")).join(bins, ["name", "bin"])
    cells = cells.select("name", "bin", "cut", (F.col("base") + F.col("inner")).alias("before")).join(t, "name")
    rank = F.row_number().over(Window.partitionBy("name", "bin", "cut").orderBy("size", F.col("doc_id").asc_nulls_first()))
    d = d.withColumn("rank", rank).join(cells, ["name", "bin", "cut"])
    number = F.col("before") + F.col("rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat(F.lit(f"{seed}|"), "name"))
    crossed = F.floor(number * rate + offset) - F.floor((number - 1) * rate + offset)
    return d.select("doc_id", "source", "size", *C.others(docs), "source_size", "target", F.least(crossed.cast("int"), F.lit(int(limit))).alias("copies"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs(doc_id, text, source)`` as often as it is taken, with all of its columns."""
    d, back = C.carried(docs)
    d = d.withColumn("size", F.size(C.words(F.col("text"))).cast("long")).withColumn("carriedtext", F.col("text"))
    source = back[docs.columns.index("source")]
    m = mix(d.withColumn("source", source), weights, limit, seed).where("copies > 0").withColumn("text", F.col("carriedtext"))
    return m.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*back)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    d = sized(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "size")
    m = mix(d)
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
