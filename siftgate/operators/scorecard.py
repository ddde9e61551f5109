"""Bars and verdicts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release


def _row(name: str, statistic: str, low: float | None = None, high: float | None = None) -> Column:
    s = F.round(F.col(statistic).cast("double"), 6)
    inside = F.lit(True)
    if low is not None:
        inside = inside & (s >= low)
    if high is not None:
        inside = inside & (s <= high)
    return F.struct(F.lit(name).alias("bar"), s.alias("statistic"), F.when(s.isNull() | F.isnan(s), "vacuous").when(inside, "pass").otherwise("fail").alias("verdict"))


def bar(df: DataFrame, name: str, statistic: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """One row ``bar, statistic, verdict``: pass within the bounds, fail outside; vacuous where there is no statistic."""
    return bars(df, (name, statistic, low, high))


def bars(df: DataFrame, *of: tuple) -> DataFrame:
    """A row for each :func:`bar` (its arguments) of one frame, which is computed once."""
    return df.select(F.explode(F.array(*[_row(*x) for x in of])).alias("b")).select("b.*")


def scorecard(bars: Iterable[DataFrame]) -> DataFrame:
    """The rows of all bars. Bars are computed in turn and let go, so that the driver holds one bar's plan and broadcasts at a time, and the disk
    one bar's shuffles."""
    rows = []
    for b in bars:
        spark = b.sparkSession
        rows += b.collect()  # a row for each bar
        del b
        release(spark)
    return spark.createDataFrame(rows, "bar string, statistic double, verdict string")
