import math

import numpy as np
from pyspark.sql import functions as F

from siftgate.operators import diff, fit, passages, resample, scorecard, strata


def test_caliper_pairs_match_a_plain_walk(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), i, float(f), bool(p)) for i, (c, f, p) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 60, 300) / 100, rng.random(300) < 0.4, strict=True))]
    got = strata.caliper_pairs(spark.createDataFrame(rows, "c int, k int, f double, p boolean"), "c", "f", "p", "k").collect()
    want = set()
    for c in range(4):
        a = sorted((f, k) for cc, k, f, p in rows if cc == c and p)
        b = sorted((f, k) for cc, k, f, p in rows if cc == c and not p)
        while a and b:
            gap = a[0][0] - b[0][0]
            if abs(gap) <= 0.05:
                want.add((c, a.pop(0)[1], b.pop(0)[1]))
            elif gap > 0:
                b.pop(0)
            else:
                a.pop(0)
    assert {(r.cell, r.a, r.b) for r in got} == want and len(got) == len(want) > 30
    assert len({r.a for r in got} | {r.b for r in got}) == 2 * len(got)


def test_caliper_auroc_needs_matches(spark):
    df = spark.createDataFrame([(1, 1, 0.5, True, 0.1), (1, 2, 0.5, False, 0.2), (2, 3, None, True, 0.3)], "c int, k int, f double, p boolean, s double")
    r = strata.caliper_auroc(df, "c", "f", "s", "p", "k").first()
    assert r.matched == 1 and r.auroc is None
    assert strata.caliper_auroc(df.limit(0), "c", "f", "s", "p", "k").first().matched == 0


def test_logistic_reaches_the_optimum_of_gradient_descent(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2)) * [3, 0.5] + [1, -2]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [0.7, -1.5] - 3)))).astype(float)
    model, scored = fit.logistic(spark.createDataFrame([(float(a), float(b), bool(t)) for (a, b), t in zip(x, y, strict=True)], "a double, b double, t boolean"), ["a", "b"], "t")
    sd = x.std(0, ddof=1)  # the library's scale
    z, w, b = (x - x.mean(0)) / sd, np.zeros(2), 0.0
    for _ in range(5000):
        g = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - 0.5 * (z.T @ g / len(y) + 1e-4 * w), b - 0.5 * g.mean()
    assert np.allclose(model.coefficients.toArray() * sd, w, atol=2e-3)
    p = scored(spark.createDataFrame([(1.0, -2.0)], "a double, b double")).first().fitted
    assert math.isclose(p, 1 / (1 + math.exp(-(((np.array([1.0, -2.0]) - x.mean(0)) / sd) @ w + b))), abs_tol=2e-3)


def test_level_crossing_codes_and_place(spark):
    knots = spark.createDataFrame([(2, 0.8), (4, 0.4), (8, 0.0)], "bin int, y double")
    got = {r.level: (r.code, r.crossing) for r in fit.level_crossing(knots, "bin", "y", [0.9, 0.6, 0.4, -0.1]).collect()}
    assert got[0.9] == (1, None) and got[-0.1] == (2, None)
    assert got[0.6][0] == 0 and math.isclose(got[0.6][1], 2**1.5, rel_tol=1e-9)  # a straight line over log2
    assert math.isclose(got[0.4][1], 4.0, rel_tol=1e-9)
    assert {r.code for r in fit.level_crossing(spark.createDataFrame([(2, None), (4, 0.1)], "bin int, y double"), "bin", "y", [0.5]).collect()} == {3}


def test_changed_slots(spark):
    df = spark.createDataFrame([("A b. C d. E f.", "A b. X y. E f."), ("A b.", "A b."), ("", "A b. C d."), (None, "A b.")], "a string, b string")
    assert [r[0] for r in df.select(diff.changed_slots(F.col("a"), F.col("b"))).collect()] == [1, 0, 2, None]


def test_native_window_shifts_what_a_side_lacks(spark):
    words = [f"w{i}" for i in range(30)]
    body = " ".join(["A", "key.", *words])
    r = passages.native_windows(spark.createDataFrame([(1, 2, body, "a KEY.", "key.")], "item_id int, doc_id int, body string, item string, payload string"), [13]).collect()
    assert {(x.position, x.n_before, x.n_after) for x in r} == {("early", 0, 9), ("middle", 1, 8), ("late", 1, 8)}
    assert next(x.text for x in r if x.position == "late") == " ".join(["A", "key.", *words[:8]])
    none = passages.native_windows(spark.createDataFrame([(1, 2, "too short key.", "short key.", "key.")], "item_id int, doc_id int, body string, item string, payload string"), [13]).first()
    assert none.n_before is None and none.text is None


def test_median_gap_is_a_median_of_repeated_draws(spark):
    df = spark.createDataFrame([(i, i % 2 == 0, float(i % 7)) for i in range(40)], "u int, p boolean, x double")
    r = resample.median_gap(df, "u", "p", "x", reps=20, seed="s", low=1, high=20).first()
    assert r.low <= r.point <= r.high


def test_scorecard_verdicts(spark):
    df = spark.createDataFrame([(0.5,)], "x double")
    none = spark.createDataFrame([(None,)], "x double")
    got = scorecard.scorecard([scorecard.bar(df, "a", "x", low=0.4), scorecard.bar(df, "b", "x", high=0.4), scorecard.bar(none, "c", "x", low=0.0)]).collect()
    assert [r.verdict for r in got] == ["pass", "fail", "vacuous"]


def test_bars_are_computed_in_turn(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def bars():
        for i in range(3):
            assert seen.value == i  # the bars before are done
            yield scorecard.bar(spark.range(1).select(F.lit(0.5).alias("x")).mapInArrow(counting, "x double"), str(i), "x", low=0.4)

    assert [(r.bar, r.verdict) for r in scorecard.scorecard(bars()).collect()] == [(str(i), "pass") for i in range(3)]


def test_isotonic_computes_its_bins_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(2, 0.8), (4, 0.9), (8, 0.1)], "bin int, y double").repartition(1).mapInArrow(counting, "bin int, y double")
    got = {r.bin: r.fitted for r in fit.isotonic(df, "bin", "y").collect()}
    assert math.isclose(got[2], 0.85) and math.isclose(got[4], 0.85) and got[8] == 0.1
    assert seen.value == 3


def test_isotonic_holds_its_source_once(spark):
    fits = fit.isotonic(spark.range(2, 9, 2).select(F.col("id").alias("bin"), (1 / F.col("id")).alias("y")), "bin", "y")
    assert fits._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    empty = fit.isotonic(spark.createDataFrame([], "bin int, y double"), "bin", "y")
    assert empty.columns == ["bin", "y", "fitted"] and empty.collect() == []


def test_bars_of_one_frame_compute_it_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    one = spark.range(1).select(F.lit(0.5).alias("x")).mapInArrow(counting, "x double")
    got = scorecard.scorecard([scorecard.bars(one, ("a", "x", 0.4), ("b", "x", None, 0.4), ("c", "x", 0.5, 0.5))]).collect()
    assert [tuple(r) for r in got] == [("a", 0.5, "pass"), ("b", 0.5, "fail"), ("c", 0.5, "pass")] and seen.value == 1
