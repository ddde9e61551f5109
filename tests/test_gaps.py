"""Strata of gaps without forming the gaps, beside every pair's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgate.operators import pairs, strata
from siftgate.plans import queries


def frame(spark, x):
    return spark.createDataFrame([(i, i % 3, [float(a), 0.5]) for i, a in enumerate(x)], "vec_id long, label int, v array<double>")


@pytest.mark.parametrize("x", [np.random.default_rng(1).normal(size=200) / 8, np.round(np.random.default_rng(2).normal(size=150), 1), [0.25] * 20, [0.0, 0.0000005, -0.0000005, 0.1234565, 1e-300], [3.0, -7.5]])
def test_percentiles_equal_those_of_all_gaps(spark, x):
    x = np.array(x)
    i, j = np.triu_indices(len(x), 1)
    gaps = pairs.whole(np.abs(x[i] - x[j]), 6) / 1e6
    assert np.allclose(pairs.gap_percentiles(frame(spark, x), strata.STEPS), np.percentile(gaps, [100 * p for p in strata.STEPS]), rtol=0, atol=1e-12)
    assert pairs.gap_percentiles(frame(spark, x).limit(1), strata.STEPS) == [] == pairs.gap_percentiles(frame(spark, x).limit(0), strata.STEPS)


def test_ranges_of_gaps_equal_their_rounding():
    for k in (1, 7, 123457, 250000, 10**6, 3 * 10**6 + 1):
        g = pairs.least_gap(k)
        assert pairs.whole(np.array([g, np.nextafter(g, 0)]), 6).tolist() == [k, k - 1]
    edges = [0.0, 0.1, 0.1, 0.25, 0.3000005, 1.0]
    f = np.array([0, 0.05, 0.0999995, 0.1, 0.1000004, 0.2499994, 0.25, 0.3, 0.300001, 1.0])
    rounded = pairs.whole(f, 6) / 1e6
    for closed in (False, True):
        for s, (low, high) in enumerate(pairs.strata_of(edges, closed)):
            lo, hi = edges[s], edges[s + 1]
            want = (rounded >= lo) & (rounded <= hi if closed or s == 4 else rounded < hi)
            assert ((f >= low) & (f < high)).tolist() == want.tolist()


@pytest.mark.parametrize("scale,most", [(1.0, 50), (1e4, 50), (1.0, 1 << 31)])
def test_strata_of_squares_equal_pairs(spark, monkeypatch, scale, most):
    monkeypatch.setattr(pairs, "SQUARE", 7)
    monkeypatch.setattr(pairs, "MOST", most)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(120, 3)) / 4, 2)
    v[:, 1:] *= scale  # scores that have no places in a table
    df = spark.createDataFrame([(int(i), int(i) % 4, [float(a) for a in x]) for i, x in zip(rng.permutation(400), v)], "vec_id long, label int, v array<double>").withColumn("key", F.lit(0))
    edges = pairs.gap_percentiles(df, strata.STEPS)
    for closed in (False, True):
        want = strata.deciles(queries.pairs_of(df), "feature", closed).groupBy("stratum", "cos", "same").count()
        got = pairs.score_counts(df, 6, edges=edges, closed=closed, block=50)
        assert {(r.key, round(r.score, 6), r.same, r.n) for r in got.collect()} == {(r.stratum, round(r.cos, 6), r.same, r["count"]) for r in want.collect()}


def test_the_query_counts_no_gaps(spark, sf, monkeypatch):
    monkeypatch.setattr(strata, "percentiles", None)
    assert queries.QUERIES["stratified_auroc_open"](spark, sf).first().strata == 10
