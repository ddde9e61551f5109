"""Distances of pairs of unit vectors in four models of hyperbolic space: whether they agree, and rank pairs as the cosine does. Pairs are counted by
cosine and measured in the tasks that form them; none is a row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pairs

#: Digits of cosines and of the distances that are ranked; ranges of cosines to a unit that are put in order apart.
DIGITS, PLACES, RANGES = 6, 8, 256
#: Pairs are kept apart by their rounded distance where it lies so near (in its last place) to where rounding changes. A distance that differs from the
#: ball's by less is rounded alike everywhere else.
GUARD = 1e-4
R = math.tanh(1.0)
K = 2 * R / (1 + R * R)
GROUPS = "k long, dist long, n long, first struct<a:long,b:long>, last struct<a:long,b:long>, total double, apart double"


def models(c: Column) -> dict[str, Column]:
    """The distances that depend on the cosine alone."""
    return {
        "ball": F.acosh(1 + 4 * R * R * (1 - c) / (1 - R * R) ** 2),
        "lorentz": F.acosh(F.greatest(F.lit(1.0), math.cosh(1) ** 2 - math.sinh(1) ** 2 * c)),
        "klein": F.acosh(F.greatest(F.lit(1.0), (1 - K**2 * c) / (1 - K**2))),
    }


def _half_space(guard: float):
    """The half space's distances depend on the last components as well: of a task their sum and greatest difference from the ball's, and the groups of
    pairs near to where rounding changes, by cosine and rounded distance, with the first and last pair of each."""
    top = 10**DIGITS
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    pair = lambda p: None if p is None else {"a": p[0], "b": p[1]}

    def go(batches):
        ball = np.arccosh(1 + 4 * R * R * (1 - np.arange(-top - 1, top + 1) / top) / (1 - R * R) ** 2)
        units = ball * 10.0**PLACES
        near = np.abs(units - np.floor(units) - 0.5) <= guard
        groups: dict = {}
        total = apart = 0.0
        for x, y, own in pairs._meetings(batches):
            left, right = np.argsort(x["vec_id"]), np.argsort(y["vec_id"])
            a, b, u, v = x["vec_id"][left], y["vec_id"][right], x["v"][left], y["v"][right]
            qa, qb = (1 + R * R + 2 * R * w[:, -1] for w in (u, v))
            ha, hb = (2 * (R * w[:, -1] + 1) / q - 1 for w, q in ((u, qa), (v, qb)))
            step = max(1, pairs.CHUNK // max(1, len(right)))
            for i in range(0, len(left), step):
                at = slice(i, i + step)
                k = pairs.whole(u[at] @ v.T, DIGITS)
                d = np.arccosh(1 + (8 * R * R * (1 - k / 10.0**DIGITS) / (qa[at, None] * qb)) / (2 * ha[at, None] * hb))
                if own:
                    where = np.flatnonzero(a[at, None] < b)
                    k, d = k.ravel()[where], d.ravel()[where]
                else:
                    where, k, d = None, k.ravel(), d.ravel()
                if not len(k):
                    continue
                place = np.clip(k + top + 1, 0, len(ball) - 1)
                total += float(d.sum())
                apart = max(apart, float(np.abs(d - ball[place]).max()))
                some = np.flatnonzero(near[place])
                rows, columns = np.divmod(some if where is None else where[some], len(right))
                far = pairs.whole(d[some], PLACES)
                for key, p in zip(zip(k[some].tolist(), far.tolist()), zip(a[at][rows].tolist(), b[columns].tolist())):
                    g = groups.setdefault(key, [0, p, p])
                    g[0], g[1], g[2] = g[0] + 1, min(g[1], p), max(g[2], p)
        rows = [(k, far, *g, None, None) for (k, far), g in groups.items()] + [(None, None, None, None, None, total, apart)]
        for i in range(0, len(rows), 10_000):
            c = list(zip(*rows[i : i + 10_000]))
            yield pa.RecordBatch.from_pydict({"k": pa.array(c[0], pa.int64()), "dist": pa.array(c[1], pa.int64()), "n": pa.array(c[2], pa.int64()), "first": pa.array([pair(p) for p in c[3]], kind), "last": pa.array([pair(p) for p in c[4]], kind), "total": pa.array(c[5], pa.float64()), "apart": pa.array(c[6], pa.float64())})

    return go


def in_order(d: DataFrame) -> DataFrame:
    """``model, rank_identical`` of groups ``model, k, dist, first, last``: whether pairs in the order of cosine and ids are in that of falling distance and
    ids. They are if each group, in the order of cosine and falling distance, comes before the next: by distance, or by the ids of its last pair where
    cosine or distance is the same. Groups are put in order by ranges, whose ends are then compared."""
    row = F.struct("k", (-F.col("dist")).alias("down"), "first", "last")
    g = d.withColumn("part", F.floor(F.col("k") * RANGES / 10**DIGITS)).withColumn("row", row)

    def before(x: Column, y: Column) -> Column:
        ids = F.coalesce(x["last"] < y["first"], F.lit(False))
        return F.when(x["k"] == y["k"], ids).otherwise((x["down"] < y["down"]) | ((x["down"] == y["down"]) & ids))

    g = g.withColumn("prior", F.lag("row").over(Window.partitionBy("model", "part").orderBy("k", F.desc("dist"))))
    inner = F.coalesce(before(F.col("prior"), F.col("row")), F.lit(True))
    order = F.struct("k", (-F.col("dist")).alias("down"))
    parts = g.groupBy("model", "part").agg(F.bool_and(inner).alias("inner"), F.min_by("row", order).alias("head"), F.max_by("row", order).alias("tail"))
    ahead = F.lag("tail").over(Window.partitionBy("model").orderBy("part"))  # a row for each range
    parts = parts.withColumn("ahead", ahead)
    return parts.groupBy("model").agg(F.bool_and(F.col("inner") & F.coalesce(before(F.col("ahead"), F.col("head")), F.lit(True))).alias("rank_identical"))


def compared(vectors: DataFrame, guard: float = GUARD) -> DataFrame:
    """``model, n, mean, apart, rank_identical`` over all pairs a < b of unit ``vectors(vec_id, label, v)``: the mean distance, the greatest difference from
    the ball's, and whether pairs ranked by falling distance (eight places, ties by ids) stand as ranked by cosine (six places, ties by ids).

    Neighbouring cosines' distances are some 38 of the last place apart or more, so only pairs of one cosine can be rounded apart, in the half space."""
    counts = pairs.score_counts(vectors.withColumn("key", F.lit(0)), DIGITS).groupBy("score").agg(F.sum("n").alias("n")).persist()  # a row for each cosine
    dealt = pairs.dealt(vectors.select("vec_id", "label", "v"))
    measured = dealt.mapInArrow(_half_space(guard), GROUPS).persist()  # few cosines lie near to where rounding changes
    total, apart = measured.agg(F.sum("total"), F.max("apart")).first()
    if apart is not None and apart * 10.0**PLACES >= guard and guard < 0.5:
        measured.unpersist()
        return compared(vectors, 0.5)
    groups = measured.where("k IS NOT NULL").groupBy("k", "dist").agg(F.min("first").alias("first"), F.max("last").alias("last")).persist()
    k, unit = F.rint(F.col("score") * 10**DIGITS).cast("long"), F.lit(10.0**PLACES)
    far = models(F.col("score"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), x.alias("far")) for m, x in far.items()])).alias("x")
    flat = counts.select(k.alias("k"), "n", far["ball"].alias("ball"), each).select("k", "n", "ball", "x.*")
    whole = lambda x: F.rint(F.round(x, PLACES) * unit).cast("long")
    none = F.lit(None).cast("struct<a:bigint,b:bigint>")
    rows = flat.select("model", "k", whole(F.col("far")).alias("dist"), none.alias("first"), none.alias("last"))
    half = rows.where("model = 'ball'").join(groups.select("k").distinct(), "k", "left_anti").select("k", "dist", "first", "last").unionByName(groups)
    rows = rows.unionByName(half.select(F.lit("halfspace").alias("model"), "k", "dist", "first", "last"))
    sums = flat.groupBy("model").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("far")) / F.sum("n")).alias("mean"), F.max(F.abs(F.col("far") - F.col("ball"))).alias("apart"))
    own = counts.agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("halfspace").alias("model"), "n", (F.lit(total) / F.col("n")).alias("mean"), F.lit(apart).alias("apart"))
    return sums.unionByName(own).join(in_order(rows), "model")
