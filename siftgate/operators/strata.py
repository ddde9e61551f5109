"""Strata by deciles, and matching within a caliper."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scoring
from .pairs import between

STEPS = [i / 10 for i in range(11)]


def deciles(df: DataFrame, feature: str, closed: bool = False) -> DataFrame:
    """Rows with ``stratum`` 0 to 9. Edges are interpolated percentiles of all rows; half open with the last closed, or
    (closed) both ends belong, so that a row on an edge counts in two strata."""
    edges = df.agg(F.percentile(feature, F.array(*map(F.lit, STEPS))).alias("edges"))  # one row
    f = F.col(feature)

    def inside(i):
        lo, hi = F.get("edges", i), F.get("edges", i + 1)
        return f.between(lo, hi) if closed else (f >= lo) & ((f < hi) | ((i == 9) & (f <= hi)))

    return df.crossJoin(F.broadcast(edges)).withColumn("stratum", F.explode(F.filter(F.sequence(F.lit(0), F.lit(9)), inside))).drop("edges")


def stratified_auroc(df: DataFrame, feature: str, score: str, positive, closed: bool = False, least: int = 1) -> DataFrame:
    """``strata, auroc``: mean of the strata's, weighted by their rows; strata with fewer than ``least`` of a class don't count."""
    return pooled(deciles(df, feature, closed), score, positive, least=least)


def percentiles(counts: DataFrame, value: str, n: str, shares: list[float], step: float = 1 / 1024) -> list[float]:
    """Interpolated percentiles of values that are counted (``n`` rows each, values distinct). Places are found within ranges of values behind the
    sums of the ranges before; what comes to the driver is two values for each share."""
    part = F.floor(F.col(value) / step).alias("part")
    c = counts.select(F.col(value).alias("x"), F.col(n).alias("n"), part).persist()
    total = c.agg(F.sum("n")).first()[0]
    if not total:
        return []
    sums = c.groupBy("part").agg(F.sum("n").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    inner = F.sum("n").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = [(total - 1) * p for p in shares]
    ends = sorted({f(p) for p in at for f in (math.floor, math.ceil)})
    j = c.withColumn("upto", inner).join(sums.select("part", before.alias("before")), "part")
    upto = F.col("before") + F.col("upto")
    got = j.select("x", F.explode(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: (e < upto) & (e >= upto - F.col("n")))).alias("e")).collect()
    of = {r["e"]: r["x"] for r in got}
    c.unpersist()
    return between(of, at)


def pooled(counts: DataFrame, score: str, positive, weight=None, least: int = 1) -> DataFrame:
    """``strata, auroc`` of rows with ``stratum``: the mean of the strata's, weighted by their rows; strata with fewer than ``least`` of a class
    don't count."""
    a = scoring.auroc(counts, ["stratum"], score, positive, weight=weight).where((F.col("n_pos") >= least) & (F.col("n_neg") >= least))
    n = F.col("n_pos") + F.col("n_neg")
    return a.agg(F.count("*").alias("strata"), F.try_divide(F.sum(n * F.col("auroc")), F.sum(n)).alias("auroc"))


def caliper_pairs(df: DataFrame, cell: str, feature: str, positive: str, order: str, width: float = 0.05) -> DataFrame:
    """``cell, a, b, gap``: greedy one-to-one matches within each cell. Both classes are walked in the order of the
    feature (ties by ``order``); heads within ``width`` of each other match, otherwise the lower head is passed over.

    The walk depends on every match before it, hence a task for each cell: cells are bounded audit samples."""

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([feature, order])
        hits, rest = rows[rows[positive]], rows[~rows[positive]]
        x, y = hits[feature].tolist(), rest[feature].tolist()
        took, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            gap = x[i] - y[j]
            if abs(gap) <= width:
                took.append((i, j, abs(gap)))
            i, j = i + (gap <= width), j + (gap >= -width)
        a, b = hits[order].to_numpy()[[t[0] for t in took]], rest[order].to_numpy()[[t[1] for t in took]]
        return pd.DataFrame({"cell": rows[cell].iloc[0], "a": a, "b": b, "gap": [t[2] for t in took]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    d = df.where(F.col(feature).isNotNull() & F.col(positive).isNotNull() & F.col(order).isNotNull() & F.col(cell).isNotNull()).select(cell, feature, positive, order)
    return d.groupBy(cell).applyInPandas(match, f"cell {kinds[cell]}, a {kinds[order]}, b {kinds[order]}, gap double")


#: Below so many matches a caliper AUROC is not defined.
LEAST_MATCHES = 30


def caliper_auroc(df: DataFrame, cell: str, feature: str, score: str, positive: str, order: str, width: float = 0.05) -> DataFrame:
    """``matched, auroc`` over the matched rows alone; null below ``LEAST_MATCHES`` matches."""
    m = caliper_pairs(df, cell, feature, positive, order, width)
    both = m.select("cell", F.explode(F.array("a", "b")).alias(order))
    kept = df.join(both.withColumnRenamed("cell", cell), [cell, order], "left_semi")
    a = scoring.auroc(kept, [], score, F.col(positive))
    return matched_auroc(a)


def matched_auroc(a: DataFrame) -> DataFrame:
    """``matched, auroc`` from :func:`.scoring.auroc` of matched rows; null below ``LEAST_MATCHES`` matches."""
    return a.select(F.coalesce("n_pos", F.lit(0)).alias("matched"), F.when(F.col("n_pos") >= LEAST_MATCHES, F.col("auroc")).alias("auroc"))
