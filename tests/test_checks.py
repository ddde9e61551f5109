"""Checks that compare two sides fail where the sides differ."""

import random

from pyspark.sql import functions as F

from siftgate.operators import order
from siftgate.plans import audit


def test_compared_metrics_disagree(spark):
    df = spark.createDataFrame([("x", 10, 10, 5.0, 5.4), ("y", 10, 11, 5.0, None)], "k string, a long, b long, c double, d double")
    got = {(r.k, r.metric): r.agrees for r in audit.compared(df, ["k"], {"n": ("a", "b"), "s": ("c", "d")}, 0.5).collect()}
    assert got == {("x", "n"): True, ("x", "s"): True, ("y", "n"): False, ("y", "s"): False}


def test_sets_lack_members_of_each_other(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "doc_id long") for x in ((1, 2, 3), (3, 4)))
    assert tuple(audit.set_check(a, b).first()) == (3, 2, 2, 1)
    assert tuple(audit.set_check(a, a).first()) == (3, 3, 0, 0)


def test_places_by_parts_equal_a_sort(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("ab"), round(rnd.gauss(0, 2), 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, x double")
    got = {r.i: r.place for r in order.placed(df, "g", F.floor(F.col("x") * 3), F.col("x"), F.col("i"), name="place").collect()}
    for g in "ab":
        own = sorted((x, i) for i, k, x in rows if k == g)
        assert all(got[i] == n for n, (_, i) in enumerate(own, 1))
    ids = {r["i"]: r["index"] for r in order.indexed(df, "i", "g").collect()}
    for g in "ab":
        assert [ids[i] for i, k, _ in rows if k == g] == list(range(sum(k == g for _, k, _ in rows)))


def test_two_sources_hold_the_labelled_pairs_too(spark, sf):
    got = {r.metric: r for r in audit.two_source_check(spark, sf).where("lang = 'all pairs'").collect()}
    assert set(got) == {"n_pairs", "mean_jaccard", "median_jaccard", "range_jaccard"} and all(r.agrees for r in got.values())
    assert got["n_pairs"].ours == audit.labelled_pairs(spark, sf).count() > 0
