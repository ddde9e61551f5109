"""Threshold search and curve fits over a few bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_curve(df: DataFrame, score: str, positive: Column, grid: list[float], weight: Column | None = None) -> DataFrame:
    """``threshold, balanced`` of a gate that fires below each of an increasing grid: rows are counted once per score
    (by ``weight``, if given)."""
    number = F.count_if if weight is None else lambda x: F.sum(F.when(x, weight).otherwise(F.lit(0)))
    each = df.groupBy(score).agg(number(positive).alias("p"), number(~positive).alias("q"))
    step = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col(score)))  # fires for thresholds from this step on
    c = each.withColumn("step", step).groupBy("step").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    grid_rows = df.sparkSession.createDataFrame(list(enumerate(grid)), "i int, threshold double")
    t = grid_rows.join(c, F.col("step") <= F.col("i"), "left").groupBy("i", "threshold").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("q"), F.lit(0)).alias("fp"))
    total = c.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return t.crossJoin(total).select("threshold", ((F.col("tp") / F.col("n_pos") + 1 - F.col("fp") / F.col("n_neg")) / 2).alias("balanced"))


def isotonic(df: DataFrame, x: str, y: str) -> DataFrame:
    """Non-increasing fit by the min-max identity over the bins (a handful), which meet within one row: what they come from stands in the plan once."""
    a = df.select(F.col(x).alias("i"), F.col(y).alias("yi"))
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumn("s", F.sum("yi").over(w)).withColumn("k", F.row_number().over(Window.orderBy("i")))
    bins = a.agg(F.array_sort(F.collect_list(F.struct("k", "i", "yi", "s"))).alias("bins"))

    def top(k: Column, i: Column) -> Column:
        means = F.transform(F.filter("bins", lambda j: j["k"] >= k), lambda j: (j["s"] - i["s"] + i["yi"]) / (j["k"] - i["k"] + 1))
        return F.array_max(means)

    def fitted(a: Column) -> Column:
        return F.array_min(F.transform(F.filter("bins", lambda i: i["k"] <= a["k"]), lambda i: top(a["k"], i)))

    each = F.explode(F.transform("bins", lambda a: F.struct(a["i"].alias("i"), a["yi"].alias("yi"), fitted(a).alias("fitted")))).alias("a")
    return bins.select(each).select(F.col("a.i").alias(x), F.col("a.yi").alias(y), "a.fitted")


def power_law(df: DataFrame, x: str, y: str, base: float = 64.0) -> DataFrame:
    """``n, exponent, scale`` of y = scale (base / x) ^ exponent in logs; null below three positive bins."""
    p = df.where(F.col(y) > 0).select(F.log(y).alias("ly"), F.log(F.lit(base) / F.col(x)).alias("lx"))
    r = p.agg(F.count("*").alias("n"), F.regr_slope("ly", "lx").alias("k"), F.regr_intercept("ly", "lx").alias("c"))
    ok = F.col("n") >= 3
    return r.select("n", F.when(ok, F.round("k", 5)).alias("exponent"), F.when(ok, F.round(F.exp("c"), 5)).alias("scale"))


def level_crossing(knots: DataFrame, x: str, y: str, levels: list[float], steps: int = 60) -> DataFrame:
    """``level, code, crossing``: where a monotone cubic through the knots (over log2 x) first falls to a level.

    Codes: 0 crossing inside, 1 at or below the level from the first knot on, 2 never, 3 a knot is missing. Slopes are the
    harmonic means of the secants on both sides (0 where they disagree), the secant itself at the ends. Knots are few."""
    w = Window.orderBy("x")
    k = knots.select(F.log2(F.col(x).cast("double")).alias("x"), F.col(y).alias("y"))
    k = k.withColumn("right", (F.lead("y").over(w) - F.col("y")) / (F.lead("x").over(w) - F.col("x"))).withColumn("left", F.lag("right").over(w))
    mean = F.when(F.col("left") * F.col("right") > 0, 2 * F.col("left") * F.col("right") / (F.col("left") + F.col("right"))).otherwise(F.lit(0.0))
    k = k.withColumn("m", F.when(F.col("left").isNull(), F.col("right")).when(F.col("right").isNull(), F.col("left")).otherwise(mean))
    k = k.withColumn("pre", F.lag(F.struct("x", "y", "m")).over(w))
    grid = F.explode(F.array(*map(F.lit, levels))).alias("level")
    each = k.select(grid, "*").groupBy("level").agg(F.min_by("y", "x").alias("first"), F.count_if(F.col("y").isNull()).alias("missing"), F.min(F.when(F.col("pre").isNotNull() & (F.col("y") <= F.col("level")), F.struct("x", "y", "m", "pre"))).alias("r"))
    code = F.when(F.col("missing") > 0, 3).when(F.col("first") <= F.col("level"), 1).when(F.col("r").isNull(), 2).otherwise(0)
    l, r, h = F.col("r.pre"), F.col("r"), F.col("r.x") - F.col("r.pre.x")

    def value(at: Column) -> Column:
        t = (at - l["x"]) / h
        return (2 * t * t * t - 3 * t * t + 1) * l["y"] + h * (t * t * t - 2 * t * t + t) * l["m"] + (3 * t * t - 2 * t * t * t) * r["y"] + h * (t * t * t - t * t) * r["m"]

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        over = value(mid) > F.col("level")
        return F.struct(F.when(over, mid).otherwise(s["lo"]).alias("lo"), F.when(over, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(l["x"].alias("lo"), r["x"].alias("hi")), halve, lambda s: F.pow(F.lit(2.0), s["hi"]))
    return each.withColumn("code", code).select("level", "code", F.when(F.col("code") == 0, found).alias("crossing"))


def correlation(df: DataFrame, by: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Correlations per group; null below three rows or without spread."""
    some = lambda x, y: (F.count("*") >= 3) & (F.stddev(x) > 0) & (F.stddev(y) > 0)
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.when(some(x, y), F.corr(x, y)).alias(k) for k, (x, y) in pairs.items()])


def logistic(df: DataFrame, features: list[str], positive: str, penalty: float = 1e-4):
    """Logistic model of standardized features, with an L2 penalty on their weights, by MLlib: the optimum that gradient
    descent on this loss comes to. Returns the model and a function that adds ``fitted`` to a frame."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip")
    rows = v.transform(df.withColumn("_y", F.col(positive).cast("double"))).select("_v", "_y")
    model = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=penalty, elasticNetParam=0.0, maxIter=200, tol=1e-10, standardization=True).fit(rows)
    z = F.lit(float(model.intercept))
    for c, k in zip(features, model.coefficients.toArray().tolist(), strict=True):
        z = z + F.col(c) * F.lit(k)
    return model, lambda d: d.withColumn("fitted", 1 / (1 + F.exp(-z)))
