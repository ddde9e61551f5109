"""Queries beyond the audit's own: interval joins and mergeable sketches over the stream table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MINUTE = 60_000_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH e AS (SELECT event_id, epoch_us(ts) AS at, event_type, value FROM events)
SELECT x.event_id AS error_id, count(*) AS n, count(*) FILTER (e.event_type = 'error') AS n_errors, round(sum(e.value), 6) AS total FROM e x JOIN e ON e.at >= x.at AND e.at < x.at + {30 * MINUTE} WHERE x.event_type = 'error' GROUP BY 1""")
def ext_interval_join(spark, d):
    """What happens within half an hour of each error, whoever did it: sums over a moving stretch of time, from sums by minutes."""
    e = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", "value")
    sums = {"n": F.lit(1), "n_errors": F.coalesce((F.col("event_type") == "error").cast("int"), F.lit(0)), "total": F.col("value")}
    r = intervals.ahead(e, "at", F.col("event_type") == "error", "event_id", MINUTE, 30, sums)
    return r.select(F.col("event_id").alias("error_id"), "n", "n_errors", F.round("total", 6).alias("total"))


#: Bounds on the relative errors of the sketches.
DISTINCT, RANK = 0.05, 0.01


@query("""WITH t AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, quantile_disc(value, 0.5) AS median FROM events GROUP BY event_type),
b AS (SELECT count(*) AS both_users FROM (SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'))
SELECT event_type, n, users, both_users, true AS distinct_within, true AS median_within, true AS union_within, true AS both_within FROM t, b""")
def ext_sketches(spark, d):
    """Exact numbers, and whether mergeable sketches come within their bounds of them: distinct users by type, their union over the days'
    sketches, users of two types, and the rank of the approximate median."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = e.groupBy("event_type", "day").agg(F.expr("hll_sketch_agg(user_id, 14)").alias("h"), F.expr("theta_sketch_agg(user_id, 14)").alias("t"))
    types = days.groupBy("event_type").agg(F.expr("hll_sketch_estimate(hll_union_agg(h))").alias("by_days"), F.expr("theta_union_agg(t)").alias("t"))
    at = lambda k: F.first(F.when(F.col("event_type") == k, F.col("t")), ignorenulls=True)
    both = types.agg(F.expr("1").alias("one"), at("error").alias("x"), at("purchase").alias("y")).select(F.expr("theta_sketch_estimate(theta_intersection(x, y))").alias("both_about"))
    users = lambda k: e.where(F.col("event_type") == k).select("user_id")
    exact_both = users("error").intersect(users("purchase")).agg(F.count("*").alias("both_users"))
    # beside a distinct count Spark would keep a buffer of each sketch for every user
    distinct = e.select("event_type", "user_id").distinct().groupBy(F.col("event_type").alias("of")).agg(F.count("user_id").alias("users"))
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id", 0.01).alias("about"), F.percentile_approx("value", 0.5, 10_000).alias("mid"))
    g = g.join(distinct, F.expr("event_type <=> of")).drop("of")
    rank = e.join(F.broadcast(g.select("event_type", "mid")), "event_type").groupBy("event_type").agg(F.avg((F.col("value") < F.col("mid")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("mid")).cast("int")).alias("upto"))  # a row for each type
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), DISTINCT * F.col(b))
    r = g.join(rank, "event_type").join(types.select("event_type", "by_days"), "event_type").crossJoin(F.broadcast(both)).crossJoin(F.broadcast(exact_both))  # a row each
    return r.select("event_type", "n", "users", "both_users", near("about", "users").alias("distinct_within"), ((F.col("below") <= 0.5 + RANK) & (F.col("upto") >= 0.5 - RANK)).alias("median_within"), near("by_days", "users").alias("union_within"), near("both_about", "both_users").alias("both_within"))
