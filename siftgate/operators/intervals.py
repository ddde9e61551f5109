"""Points within intervals, as an equality join on bins, and sums over what lies ahead of a point: no product of the two tables is formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of a bin that share a task; bins with more are split.
SPLIT = 100_000


def within(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, split: int = SPLIT) -> DataFrame:
    """All pairs of a point and an interval with ``start <= at < end`` (whole numbers; rows with nulls and empty intervals meet nothing). Columns
    of the two tables differ in name.

    Bins are as wide as the intervals' mean length, so an interval lies in about two of them; one much longer than that lies in as many
    as it spans. Points of a crowded bin are dealt over as many parts as they fill, and the bin's intervals are copied to each part: the
    counts of bins, a small table, tell both sides how many there are."""
    mean = intervals.where(F.col(end) > F.col(start)).agg(F.avg(F.col(end) - F.col(start))).first()[0]
    width = max(1, int(mean or 1))
    p = points.where(F.col(at).isNotNull()).withColumn("bin", F.floor(F.col(at) / width).cast("long"))
    parts = p.groupBy("bin").agg(F.ceil(F.count("*") / F.lit(split)).cast("int").alias("parts"))
    p = p.join(parts, "bin").withColumn("part", F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), F.col("parts")).cast("int")).drop("parts")
    i = intervals.where(F.col(end) > F.col(start)).withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor((F.col(end) - 1) / width).cast("long"))))
    i = i.join(parts, "bin").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return p.join(i, ["bin", "part"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("bin", "part")


def ahead(points: DataFrame, at: str, asks: Column, key: str, width: int, bins: int, sums: dict[str, Column]) -> DataFrame:
    """``key`` and ``sums`` of the points from each asking point on (``asks``; itself and its equals included) to, not including, ``bins * width`` later
    (whole numbers; a point without a place meets nothing). Rows of one key are summed together.

    No pair is formed: what lies ahead is the rest of the point's own bin, whole bins, and the start of the last one. Bins are narrow; a
    task sorts those it holds."""
    names = [*sums]
    p = points.where(F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"), F.coalesce(asks, F.lit(False)).alias("_asks"), *[x.alias(k) for k, x in sums.items()])
    p = p.withColumn("_bin", F.floor(F.col("_at") / width).cast("long"))
    rest = Window.partitionBy("_bin").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = p.select("_key", "_asks", *[F.sum(k).over(rest).alias(k) for k in names]).where("_asks").drop("_asks")
    whole = p.groupBy("_bin").agg(*[F.sum(k).alias(k) for k in names])  # a row for each bin
    before = whole.withColumn("_bin", F.explode(F.array(*[F.col("_bin") - i for i in range(1, bins)]))).groupBy("_bin").agg(*[F.sum(k).alias(k) for k in names])
    between = p.where("_asks").select("_key", "_bin").join(before, "_bin").drop("_bin")
    ends = p.where("_asks").select("_key", (F.col("_at") + bins * width).alias("_at"), (F.col("_bin") + bins).alias("_bin"))
    start = Window.partitionBy("_bin").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    last = p.drop("_key", "_asks").unionByName(ends.withColumn("_end", F.lit(True)), allowMissingColumns=True)
    last = last.select("_key", "_end", *[F.sum(k).over(start).alias(k) for k in names]).where("_end").drop("_end")
    return own.unionByName(between).unionByName(last).groupBy(F.col("_key").alias(key)).agg(*[F.sum(k).alias(k) for k in names])
