"""Queries of geometry, intervals, transfer and the bars that rest on them. Those of pandas walks have no SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import hyperbolic, pairs, resample, scoring
from . import oracle as O
from .queries import SEED, cells, embedded, labelled_pairs, median_gap_bootstrap

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Up to so many vectors the least cosine is exact, beyond it is that of the vectors with the lowest hashes.
EXACT = 6_000
GATES = (0.5, 0.7, 0.9)
TOLERANCE = 1e-9


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_UNIT = "u AS (SELECT vec_id, label, list_transform(v, lambda x: x / (CASE WHEN list_dot_product(v, v) = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) END)) AS v FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings))"


@query(f"""WITH {_UNIT}, p AS (SELECT i, v[i] AS x FROM (SELECT v, unnest(range(1, len(v) + 1)) AS i FROM u)), m AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM p GROUP BY i)),
a AS (SELECT acos(greatest(-1, least(1, list_dot_product(v, m) / sqrt(list_dot_product(m, m))))) AS t FROM u, m), s AS (SELECT count(*) AS n, max(t) AS top, quantile_cont(t, 0.99) AS p99, quantile_cont(t, 0.9) AS p90, median(t) AS med FROM a),
k AS (SELECT * FROM u QUALIFY row_number() OVER (ORDER BY md5('20260805|' || vec_id), vec_id) <= {EXACT}), c AS (SELECT min(list_dot_product(x.v, y.v)) AS least FROM k x JOIN k y ON x.vec_id < y.vec_id)
SELECT n, round(degrees(top), 3) AS max_degrees, round(degrees(p99), 3) AS p99_degrees, round(degrees(p90), 3) AS p90_degrees, round(degrees(med), 3) AS median_degrees, round(cos(2 * top), 5) AS hard_floor, round(cos(2 * p99), 5) AS practical_floor, round(least, 5) AS least_cosine, n > {EXACT} AS sampled,
 top <= pi() / 2 AS in_scope, top <= pi() / 2 AND least >= cos(2 * top) - 1e-9 AS bound_holds, gate, top <= pi() / 2 AND cos(2 * top) > gate AS hard_vacuous, top <= pi() / 2 AND cos(2 * p99) > gate AS practical_vacuous FROM s, c, unnest([0.5, 0.7, 0.9]::DOUBLE[]) g(gate)""")
def cone_report(spark, d):
    """Angles to the mean direction, the floors they put under any cosine, the least cosine seen, whether it respects the hard
    floor, and the gates that a floor makes vacuous (only where all vectors lie within a right angle of the mean). ``sampled``: the least
    cosine is that of ``EXACT`` vectors, as the audit has it beyond that number."""
    e = embedded(spark, d).withColumn("v", V.unit(F.col("v")))
    mean = e.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select(V.unit(F.transform("s", lambda x: x["m"])).alias("m"))
    a = e.crossJoin(F.broadcast(mean)).select(V.angle(V.dot(F.col("v"), F.col("m"))).alias("t"))  # one row
    s = a.agg(F.count("*").alias("n"), F.max("t").alias("top"), *[F.percentile("t", q).alias(k) for k, q in (("p99", 0.99), ("p90", 0.9), ("med", 0.5))])
    few = e.orderBy(F.md5(F.concat_ws("|", F.lit(SEED), "vec_id")), "vec_id").limit(EXACT)
    c = pairs.all_pairs(few).agg(F.min("dot").alias("least"))
    hard, practical, scope = F.cos(2 * F.col("top")), F.cos(2 * F.col("p99")), F.col("top") <= math.pi / 2
    r = s.crossJoin(c).withColumn("gate", F.explode(F.array(*map(F.lit, GATES))))
    deg = lambda c, n: F.round(F.degrees(c), 3).alias(f"{n}_degrees")
    return r.select("n", deg("top", "max"), deg("p99", "p99"), deg("p90", "p90"), deg("med", "median"), F.round(hard, 5).alias("hard_floor"), F.round(practical, 5).alias("practical_floor"), F.round("least", 5).alias("least_cosine"), (F.col("n") > EXACT).alias("sampled"), scope.alias("in_scope"), (scope & (F.col("least") >= hard - TOLERANCE)).alias("bound_holds"), "gate", (scope & (hard > F.col("gate"))).alias("hard_vacuous"), (scope & (practical > F.col("gate"))).alias("practical_vacuous"))


def cap(theta: float, n: int, dims: int, seed: int, spark: SparkSession) -> DataFrame:
    """``vec_id, label, v``: unit vectors within ``theta`` of the first axis, and last a pair at the cap's opposite ends."""
    draws = spark.range(n).select(F.col("id").alias("vec_id"), (F.rand(seed) * theta).alias("t"), F.array(*[F.randn(seed + i) for i in range(1, dims)]).alias("g"))
    side = V.unit(F.col("g"))
    v = draws.select("vec_id", F.concat(F.array(F.cos("t")), F.transform(side, lambda x: x * F.sin("t"))).alias("v"))
    tight = [(n + k, [math.cos(theta), s * math.sin(theta), *[0.0] * (dims - 2)]) for k, s in enumerate((1.0, -1.0))]
    return v.unionByName(spark.createDataFrame(tight, "vec_id long, v array<double>")).select("vec_id", F.lit(0).alias("label"), "v")


@query("SELECT unnest([0.3, 0.6]::DOUBLE[]) AS theta, 502::BIGINT AS n, unnest([round(cos(0.6), 9), round(cos(1.2), 9)]) AS least_cosine, unnest([round(cos(0.6), 9), round(cos(1.2), 9)]) AS floor, true AS bound_holds")
def cap_sampling(spark, d):
    """Drawn vectors of two caps: the least cosine is the floor cos(2 theta), which the pair at opposite ends reaches."""
    rows = None
    for theta in (0.3, 0.6):
        c = cap(theta, 500, 16, 7, spark)
        r = pairs.all_pairs(c).agg(F.min("dot").alias("least")).crossJoin(c.agg(F.count("*").alias("n")))
        r = r.select(F.lit(theta).alias("theta"), "n", F.round("least", 9).alias("least_cosine"), F.round(F.lit(math.cos(2 * theta)), 9).alias("floor"), (F.col("least") >= math.cos(2 * theta) - TOLERANCE).alias("bound_holds"))
        rows = r if rows is None else rows.unionByName(r)
    return rows


@query(f"""WITH {O.VP}, l AS (SELECT vec_id, embedding[len(embedding)]::DOUBLE AS z FROM embeddings), p AS (SELECT vec_id_a, vec_id_b, cos, x.z AS za, y.z AS zb FROM vp JOIN l x ON x.vec_id = vec_id_a JOIN l y ON y.vec_id = vec_id_b),
q AS (SELECT *, tanh(1.0::DOUBLE) AS r, 1 + tanh(1.0::DOUBLE) ^ 2 + 2 * tanh(1.0::DOUBLE) * za AS qa, 1 + tanh(1.0::DOUBLE) ^ 2 + 2 * tanh(1.0::DOUBLE) * zb AS qb FROM p),
d AS (SELECT vec_id_a, vec_id_b, cos, acosh(1 + 4 * r * r * (1 - cos) / (1 - r * r) ^ 2) AS ball, acosh(greatest(1, cosh(1.0::DOUBLE) ^ 2 - sinh(1.0::DOUBLE) ^ 2 * cos)) AS lorentz,
 acosh(greatest(1, (1 - (2 * r / (1 + r * r)) ^ 2 * cos) / (1 - (2 * r / (1 + r * r)) ^ 2))) AS klein, acosh(1 + (8 * r * r * (1 - cos) / (qa * qb)) / (2 * (2 * (r * za + 1) / qa - 1) * (2 * (r * zb + 1) / qb - 1))) AS halfspace FROM q),
m AS (SELECT model, cos, vec_id_a, vec_id_b, ball, dist FROM d, LATERAL (SELECT unnest(['ball', 'lorentz', 'klein', 'halfspace']) AS model, unnest([ball, lorentz, klein, halfspace]) AS dist)),
k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY cos, vec_id_a, vec_id_b) AS rc, row_number() OVER (PARTITION BY model ORDER BY round(dist, 8) DESC, vec_id_a, vec_id_b) AS rd FROM m)
SELECT model, count(*) AS n, round(avg(dist), 6) AS mean, max(abs(dist - ball)) <= 1e-8 AS agrees, bool_and(rc = rd) AS rank_identical FROM k GROUP BY model""")
def hyperbolic_models(spark, d):
    """Distances of unit vectors mapped to four models of hyperbolic space: they agree, and rank pairs as the cosine does."""
    m = hyperbolic.compared(embedded(spark, d))
    return m.select("model", "n", F.round("mean", 6).alias("mean"), (F.col("apart") <= 1e-8).alias("agrees"), "rank_identical")


@query(f"""WITH {O.CELLS}, x AS (SELECT position, score, pair = 'flip' AS flip FROM ce WHERE pair IN ('flip', 'faithful') AND bin <= 512), {O.ranked('x', 'score', 'flip', 'position')},
a AS (SELECT position, u2 / (2.0 * n_pos * n_neg) AS a FROM r) SELECT round(max(CASE WHEN position = 'early' THEN a END), 6) AS early, round(max(CASE WHEN position = 'middle' THEN a END), 6) AS middle, round(max(CASE WHEN position = 'late' THEN a END), 6) AS late,
 round(max(CASE WHEN position = 'early' THEN a END) - max(CASE WHEN position = 'late' THEN a END), 6) AS delta, max(CASE WHEN position = 'early' THEN a END) - max(CASE WHEN position = 'late' THEN a END) >= 0.05 AS hit FROM a""")
def position_effect(spark, d):
    """How well changes are told from paraphrases at early and late positions, bins up to 512 pooled."""
    c = cells(spark, d).where("pair IN ('flip', 'faithful') AND bin <= 512")
    a = scoring.auroc(c, ["position"], "score", F.col("pair") == "flip")
    at = lambda p: F.max(F.when(F.col("position") == p, F.col("auroc")))
    r = a.agg(at("early").alias("e"), at("middle").alias("m"), at("late").alias("l"))
    return r.select(F.round("e", 6).alias("early"), F.round("m", 6).alias("middle"), F.round("l", 6).alias("late"), F.round(F.col("e") - F.col("l"), 6).alias("delta"), (F.col("e") - F.col("l") >= 0.05).alias("hit"))


@query(f"""WITH {O.CELLS}, t AS (SELECT bin, t AS threshold, avg(CASE WHEN pair = 'flip' THEN (score >= t)::INT END) AS miss, avg(CASE WHEN pair = 'faithful' THEN (score < t)::INT END) AS blocked FROM ce, unnest([0.7, 0.8, 0.9]::DOUBLE[]) u(t) GROUP BY bin, t)
SELECT threshold, bin, round(miss, 9) AS miss, round(blocked, 9) AS blocked, round(max(miss) OVER w - min(miss) OVER w, 9) AS miss_range, min(CASE WHEN miss >= 0.95 AND blocked <= 0.05 THEN bin END) OVER w AS degenerate_from FROM t WINDOW w AS (PARTITION BY threshold)""")
def error_directions(spark, d):
    """Changes that a gate lets pass and paraphrases that it blocks, per bin; from which bin on it lets everything pass."""
    c = cells(spark, d).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.7, 0.8, 0.9)))))
    over = F.col("score") >= F.col("threshold")
    t = c.groupBy("threshold", "bin").agg(F.avg(F.when(F.col("pair") == "flip", over.cast("int"))).alias("miss"), F.avg(F.when(F.col("pair") == "faithful", (~over).cast("int"))).alias("blocked"))
    w = Window.partitionBy("threshold")
    return t.select("threshold", "bin", F.round("miss", 9).alias("miss"), F.round("blocked", 9).alias("blocked"), F.round(F.max("miss").over(w) - F.min("miss").over(w), 9).alias("miss_range"), F.min(F.when((F.col("miss") >= 0.95) & (F.col("blocked") <= 0.05), F.col("bin"))).over(w).alias("degenerate_from"))


@query(f"""WITH {O.LP}, x AS (SELECT doc_id, quality = 1 AS pos, round(jaccard, 9) AS x FROM lp), {O.draws('x', 'doc_id')}, s AS (SELECT rep, x, sum(CASE WHEN pos THEN w ELSE 0 END) AS p, sum(CASE WHEN pos THEN 0 ELSE w END) AS q FROM x JOIN dd USING (doc_id) GROUP BY rep, x),
h AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY rep ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM s), a AS (SELECT rep, sum(p * (2 * h + q))::DOUBLE / nullif(2.0 * sum(p)::DOUBLE * sum(q)::DOUBLE, 0) AS a FROM h GROUP BY rep), {O.ranked('x', 'x', 'pos')}
SELECT any_value(n_pos + n_neg) AS n, round(any_value(u2 / (2.0 * n_pos * n_neg)), 9) AS point, round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high FROM a, r""")
def anchor_bootstrap_auroc(spark, d):
    x = labelled_pairs(spark, d).select("doc_id", (F.col("quality") == 1).alias("pos"), F.round("jaccard", 9).alias("x")).persist()  # three numbers a document
    return resample.unit_auroc(x, "doc_id", "pos", "x", resample.BOOTSTRAPS, SEED)


@query(f"SELECT point, low, high, CASE WHEN low > 0 THEN 'higher' WHEN high < 0 THEN 'lower' ELSE 'unresolved' END AS orientation FROM ({O.SQL['median_gap_bootstrap']})")
def orientation(spark, d):
    """Which class has the larger overlap, as far as the interval of the medians' difference tells."""
    side = F.when(F.col("low") > 0, "higher").when(F.col("high") < 0, "lower").otherwise("unresolved")
    return median_gap_bootstrap(spark, d).select("point", "low", "high", side.alias("orientation"))


@query(None)
def caliper_bootstrap(spark, d):
    """Interval of the caliper AUROC, matched by length anew for each replicate."""
    x = labelled_pairs(spark, d).select("doc_id", (F.col("quality") == 1).alias("pos"), (T.ws_count(F.col("a")) / 1000).alias("f"), F.round("jaccard", 9).alias("x"))
    return resample.caliper_interval(x, "doc_id", "pos", "f", "x", resample.BOOTSTRAPS, SEED)


def flips(spark, d) -> DataFrame:
    """Change of each cell; kept, as replicates read it several times (a row for each anchor, domain, bin and position)."""
    return cells(spark, d).where("pair = 'flip'").select("item_id", "lang", "bin", (1 - F.col("score")).alias("y")).persist()


@query(None)
def crossing_interval(spark, d):
    """Lengths at which the mean change falls to a level, with intervals over items."""
    return resample.crossing_intervals(resample.drawn_curves(flips(spark, d), "item_id", "lang", "bin", "y", resample.BOOTSTRAPS, SEED), "lang", [0.05, 0.1, 0.2, 0.3])


@query(None)
def held_out_transfer(spark, d):
    """Languages against the fitted curve of English, over the same draws of items."""
    return resample.transfer_band(resample.drawn_curves(flips(spark, d), "item_id", "lang", "bin", "y", resample.BOOTSTRAPS, SEED), "lang", "en")
