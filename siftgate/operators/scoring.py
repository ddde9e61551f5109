"""Rank statistics, gates, agreement. Ranks are counted per distinct score: no pairs are formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959964


#: Cells of a score range in which ranks are counted apart.
CELLS = 64
#: Sums of products of counts, which outgrow a bigint from some 90,000 vectors (all their pairs) on, and the counts that are multiplied.
WIDE, COUNT = "decimal(38,0)", "decimal(19,0)"


def narrowed(df: DataFrame, *sums: str) -> DataFrame:
    """``df``, whose few rows are computed here, with the ``sums`` as bigint, the type that SQL has them in; where one of them has no place in a
    bigint (and SQL's cast fails), all stay ``WIDE``."""
    df = df.persist()
    top = df.agg(F.max(F.greatest(F.lit(0).cast(WIDE), *map(F.abs, map(F.col, sums)))).alias("top")).first()["top"]
    return df if top is not None and top >= 1 << 63 else df.withColumns({c: F.col(c).cast("long") for c in sums})


def rank_counts(df: DataFrame, by: list[str], score: str, positive: Column, weight: Column | None = None) -> DataFrame:
    """``by, n_pos, n_neg, u2``: u2 is twice the number of (positive, negative) pairs with the positive score lower, ties as half;
    with a ``weight`` rows count by it. Of whole numbers u2 is exact and ``WIDE``.

    Scores are counted first; ranges of scores (``CELLS`` to a unit) then sum up apart, beside the sums of the ranges
    above them. So no task sorts all scores."""
    number = F.count_if if weight is None else lambda x: F.sum(F.when(x, weight).otherwise(F.lit(0)))
    cells = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(number(positive).alias("p"), number(~positive).alias("q"))
    exact = dict(cells.dtypes)["p"] == "bigint"
    count = lambda x: x.cast(COUNT) if exact else x
    total = lambda x: F.sum(x).cast(WIDE) if exact else F.sum(x)
    cells = cells.withColumn("range", F.floor(F.col(score) * CELLS))
    above = Window.partitionBy(*by, "range").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("higher", F.coalesce(F.sum("q").over(above), F.lit(0)))
    # within a range: wins over its own negatives, and positives that also win over all of the ranges above
    sums = cells.groupBy(*by, "range").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), total(count(F.col("p")) * count(2 * F.col("higher") + F.col("q"))).alias("u"))
    over = Window.partitionBy(*by).orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("u", F.col("u") + count(2 * F.col("p")) * count(F.coalesce(F.sum("q").over(over), F.lit(0))))
    return sums.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), total(F.col("u")).alias("u2"))


def auroc(df: DataFrame, by: list[str], score: str, positive: Column, lower: bool = True, weight: Column | None = None) -> DataFrame:
    """:func:`rank_counts` and ``auroc``; null where a class is empty. lower: the positive class is expected to score lower."""
    r = rank_counts(df, by, score, positive, weight)
    exact = dict(r.dtypes)["u2"] == WIDE
    count = lambda x: x.cast(COUNT) if exact else x
    total = count(2 * F.col("n_pos")) * count(F.col("n_neg"))
    u = F.col("u2") if lower else total - F.col("u2")
    r = r.withColumn("u2", u.cast(WIDE) if exact else u)
    return r.withColumn("auroc", F.try_divide(F.col("u2").cast("double"), total.cast("double")))


def gate_rates(df: DataFrame, by: list[str], score: str, positive: Column, thresholds: list[float], weight: Column | None = None) -> DataFrame:
    """Rates of a gate that fires below a threshold: tpr, tnr, balanced accuracy. One pass: no row is repeated."""
    w = F.lit(1) if weight is None else weight
    rate = lambda of, x: F.try_divide(F.sum(F.when(of, w * x)), F.sum(F.when(of & x.isNotNull(), w)))
    fires = [(F.col(score) < F.lit(t)).cast("long") for t in thresholds]
    rates = [F.struct(F.lit(t).alias("threshold"), rate(positive, f).alias("tpr"), rate(~positive, 1 - f).alias("tnr")) for t, f in zip(thresholds, fires, strict=True)]
    r = df.groupBy(*by).agg(F.array(*rates).alias("rates")).select(*by, F.explode("rates").alias("x")).select(*by, "x.*")
    return r.withColumn("balanced", (F.col("tpr") + F.col("tnr")) / 2)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """``n, agreement, kappa`` of two raters; null ratings don't count; kappa is 1 where chance agreement is."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = d.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("k"))
    every = Window.partitionBy()
    cells = cells.withColumn("ra", F.sum("k").over(Window.partitionBy("a"))).withColumn("n", F.sum("k").over(every))
    ma = cells.groupBy("a").agg(F.sum("k").alias("na"))
    mb = cells.groupBy("b").agg(F.sum("k").alias("nb"))
    chance = ma.join(mb, ma.a == mb.b).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("pe"))
    o = cells.agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("k"))), F.lit(0)).alias("same")).crossJoin(chance)
    po, pe = F.col("same") / F.col("n"), F.col("pe") / (F.col("n") * F.col("n"))
    return o.select("n", po.alias("agreement"), F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    p, z2 = k / n, Z * Z
    mid, half = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)
