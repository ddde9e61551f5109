"""Counts of pairs equal counting the pairs one by one, in one block and in many."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgate.operators import pairs, strata


def _vectors(spark, n=150):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in np.round(rng.normal(size=3), 1)]) for i in rng.permutation(3 * n)[:n]]
    return rows, spark.createDataFrame(rows, "vec_id long, label int, v array<double>")


def _plain(rows, places, score):
    return [(a, b, round(score(np.array(a[2]), np.array(b[2])), places)) for a in rows for b in rows if a[0] < b[0]]


@pytest.mark.parametrize("block", [None, 1000, 31])
def test_score_counts_equal_pairs(spark, block):
    rows, df = _vectors(spark)
    for of, score in (("dot", lambda x, y: float(x @ y)), ("gap", lambda x, y: float(abs(x[0] - y[0])))):
        got = {(r.key, r.score, r.same): r.n for r in pairs.score_counts(df.withColumn("key", F.col("vec_id") % 2), 4, of=of, block=block).collect()}
        assert got == dict(Counter((a[0] % 2, s, a[1] == b[1]) for a, b, s in _plain(rows, 4, score)))


@pytest.mark.parametrize("closed", [True, False])
def test_strata_of_counts_equal_strata_of_pairs(spark, closed):
    rows, df = _vectors(spark, 90)
    plain = [(float(g), float(s), a[1] == b[1]) for (a, b, s), (_, _, g) in zip(_plain(rows, 6, lambda x, y: float(x @ y)), _plain(rows, 6, lambda x, y: float(abs(x[0] - y[0]))), strict=True)]
    gaps = spark.createDataFrame(list(Counter(g for g, _, _ in plain).items()), "gap double, n long")
    edges = strata.percentiles(gaps, "gap", "n", strata.STEPS)
    assert np.allclose(edges, np.percentile([g for g, _, _ in plain], [100 * p for p in strata.STEPS]))
    want = strata.deciles(spark.createDataFrame(plain, "feature double, score double, same boolean"), "feature", closed).groupBy("stratum", "score", "same").count()
    got = pairs.score_counts(df.withColumn("key", F.lit(0)), 6, edges=edges, closed=closed, block=40)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("block", [1000, 31])
def test_row_counts_equal_pairs(spark, block):
    rows, df = _vectors(spark)
    want = {}
    for a, b, s in _plain(rows, 4, lambda x, y: float(x @ y)):
        want.setdefault((a[0], a[1], a[1] == b[1]), []).append(s)
    got = {(r.vec_id, r.label, r.same): (r.n, round(r.total, 4), r.most) for r in pairs.row_counts(df, 4, block).collect()}
    assert got == {k: (len(s), round(sum(s), 4), max(s)) for k, s in want.items()}


def test_scores_far_apart_and_few_vectors(spark):
    df = spark.createDataFrame([(1, 0, [1e6]), (2, 0, [1e6]), (3, 1, [-1e-7])], "vec_id long, label int, v array<double>").withColumn("key", F.lit(0))
    assert {tuple(r) for r in pairs.score_counts(df, 6).collect()} == {(0, 1e12, True, 1), (0, -0.1, False, 2)}
    assert pairs.score_counts(df.limit(1), 6).count() == 0 and pairs.score_counts(df.where("false"), 6).count() == 0


def test_ties_are_rounded_half_up():
    assert pairs.whole(np.array([[0.5, -0.5, 2.5], [0.0000005, -0.0000004, 1.5]]), 0).tolist() == [[1, -1, 3], [0, 0, 2]]
    assert pairs.whole(np.array([1.0000005, 0.1234565, -0.1234565]), 6).tolist() == [1000001, 123457, -123457]
