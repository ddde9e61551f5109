"""Numbers along an order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits of a hash that share a task.
DIGITS = 3


def numbered(df: DataFrame, hashed: Column, tie: str) -> DataFrame:
    """``df`` with ``item``, its place (from 1) in the order of a hex hash (ties by ``tie``): places within each range of hashes
    behind the sum of the ranges before."""
    d = df.withColumn("hash", hashed).withColumn("head", F.substring("hash", 1, DIGITS))
    n = d.groupBy("head").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 16^DIGITS rows
    inner = F.row_number().over(Window.partitionBy("head").orderBy("hash", tie))
    return d.withColumn("inner", inner).join(n.select("head", before.alias("before")), "head").withColumn("item", (F.col("before") + F.col("inner")).cast("int")).drop("head", "hash", "inner", "before")


#: Ranges of values that are numbered apart.
RANGES = 256


def indexed(df: DataFrame, by: str, within: str | None = None) -> DataFrame:
    """``df`` with ``index``, its place (from 0) in ascending order of ``by``, a numeric column without null, distinct (``within``:
    among the rows that share that column). Places within each range of values stand behind the sum of the ranges before;
    ranges are cut at approximate quantiles."""
    edges = df.approxQuantile(by, [i / RANGES for i in range(1, RANGES)], 0.001)
    key = [within] if within else []
    d = df.withColumn("range", F.size(F.filter(F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>"), lambda e: e <= F.col(by))))
    n = d.groupBy(*key, "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # RANGES rows
    inner = F.row_number().over(Window.partitionBy(*key, "range").orderBy(by))
    n = n.select(*[F.col(k).alias("of") for k in key], F.col("range").alias("upto"), before.alias("before"))
    j = (F.col("range") == F.col("upto")) & (F.col(within).eqNullSafe(F.col("of")) if within else F.lit(True))
    return d.withColumn("inner", inner).join(n, j).withColumn("index", F.col("before") + F.col("inner") - 1).drop("range", "inner", "before", "upto", "of")


def placed(df: DataFrame, within: str, part: Column, *by: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the place (from 1) of each row among those of its ``within`` in the order of ``part``, a whole number, then
    ``by``: rows are sorted within a part only, behind the sum of the parts before. Parts are few beside the rows."""
    d = df.withColumn("part", part)
    n = d.groupBy(within, "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy(within, "part").orderBy(*by))
    return d.withColumn(name, inner).join(n.select(within, "part", before.alias("before")), [within, "part"]).withColumn(name, F.col(name) + F.col("before")).drop("part", "before")
