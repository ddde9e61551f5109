import random

import numpy as np
from pyspark.sql import functions as F

from siftgate.operators import hyperbolic, pairs
from siftgate.plans import inference

SIDE = "model string, k long, dist long, first struct<a:long,b:long>, last struct<a:long,b:long>"


def test_groups_are_in_order_as_their_pairs_are(spark):
    rnd, rows, want = random.Random(7), [], {}
    for m in range(200):
        kept, at = [], []
        for _ in range(rnd.randrange(1, 7)):
            k = rnd.randrange(3) * 5000
            at.append((k, -k // 5000 + rnd.choice([0, 0, 0, 1]), (rnd.randrange(3), rnd.randrange(3))))
        at = sorted(set(at))
        want[str(m)] = sorted(at, key=lambda p: (p[0], p[2])) == sorted(at, key=lambda p: (-p[1], p[2])) if len({p[2] for p in at}) == len(at) else None
        for k, d in {(k, d) for k, d, _ in at}:
            ids = [p for x, y, p in at if (x, y) == (k, d)]
            kept.append((str(m), k, d, min(ids), max(ids)))
        rows += kept
    got = {r.model: r.rank_identical for r in hyperbolic.in_order(spark.createDataFrame(rows, SIDE)).collect()}
    want = {m: w for m, w in want.items() if w is not None}
    assert {m: got[m] for m in want} == want and {*want.values()} == {True, False}


def test_pairs_are_kept_apart_alike_at_any_guard(spark):
    v = np.random.default_rng(3).normal(size=(120, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[60:70] = v[:10]
    e = spark.createDataFrame([(5 * i, i % 3, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, v array<double>")
    few, all_ = ({r.model: (r.n, round(r.mean, 9), r.apart <= 1e-8, r.rank_identical) for r in hyperbolic.compared(e, g).collect()} for g in (hyperbolic.GUARD, 0.5))
    assert few == all_ and {n for n, *_ in few.values()} == {120 * 119 // 2}
    assert hyperbolic.compared(e.limit(0)).collect() == []


def test_the_query_forms_no_rows_of_pairs(spark, sf, monkeypatch):
    monkeypatch.setattr(pairs, "all_pairs", None)
    assert inference.QUERIES["hyperbolic_models"](spark, sf).where(F.col("rank_identical")).count() == 4
