import random

import pytest
from pyspark.sql import functions as F

from siftgate.operators import intervals
from siftgate.plans import extended


@pytest.mark.parametrize("split", [3, 100_000])
def test_pairs_equal_the_inequality_join(spark, split):
    rnd = random.Random(2)
    points = [(i, rnd.choice((rnd.randrange(-500, 2000), 77))) for i in range(300)] + [(900, None)]
    spans = [(i, s, s + rnd.choice((0, 1, 5, 40, 700))) for i, s in enumerate(rnd.randrange(-600, 2000) for _ in range(120))] + [(900, 5, None), (901, None, 5), (902, 9, 3)]
    got = intervals.within(spark.createDataFrame(points, "p long, at long"), "at", spark.createDataFrame(spans, "i long, s long, e long"), "s", "e", split)
    rows = [(r.p, r.i) for r in got.collect()]
    want = {(p, i) for p, at in points for i, s, e in spans if None not in (at, s, e) and s <= at < e}
    assert set(rows) == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_tables(spark):
    p, i = spark.createDataFrame([(1, 2)], "p long, at long"), spark.createDataFrame([(1, 0, 5)], "i long, s long, e long")
    assert intervals.within(p, "at", i.where("false"), "s", "e").count() == 0 and intervals.within(p.where("false"), "at", i, "s", "e").count() == 0


def test_sums_ahead_equal_plain_sums(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice((None, *range(-70, 400))), rnd.random() < 0.3, rnd.choice((None, 1.0, 2.5))) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, at long, asks boolean, v double")
    got = {r.k: (r.n, r.v) for r in intervals.ahead(df, "at", F.col("asks"), "k", 10, 3, {"n": F.lit(1), "v": F.col("v")}).collect()}
    want = {}
    for k, at, asks, _ in rows:
        if asks and at is not None:
            own = [v for _, a, _, v in rows if a is not None and at <= a < at + 30]
            want[k] = (len(own), sum(v for v in own if v is not None) if any(v is not None for v in own) else None)
    assert got == want


def test_interval_join_and_sketches_form_no_pairs_and_no_buffers_a_user(spark, sf):
    plan = lambda q: extended.QUERIES[q](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "start" not in plan("ext_interval_join") and "Join" in plan("ext_interval_join")
    assert "Expand" not in plan("ext_sketches") and "count(distinct" not in plan("ext_sketches")
