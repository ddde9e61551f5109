import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgate.functions import text as T
from siftgate.operators import fit, integrity, pairs, resample, scoring
from siftgate.plans import inference

SEED = "s"


def draws(rep, n):
    return [int(int(hashlib.md5(f"{SEED}|{rep}|{i}".encode()).hexdigest()[:8], 16) / 2**32 * n) for i in range(n)]


def auroc(pos, neg):
    return sum((p < q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def units():
    rnd = random.Random(4)
    return [(i, rnd.random() < 0.5, round(rnd.random(), 3), round(rnd.random(), 1)) for i in range(120)]


def test_unit_bootstrap_equals_plain_resampling(spark, units):
    df = spark.createDataFrame(units, "u long, pos boolean, f double, s double")
    got = resample.unit_auroc(df, "u", "pos", "s", 40, SEED).first()
    a = []
    for rep in range(1, 41):
        x = [units[i] for i in draws(rep, len(units))]
        a.append(auroc([r[3] for r in x if r[1]], [r[3] for r in x if not r[1]]))
    assert got.n == 120 and abs(got.point - auroc([r[3] for r in units if r[1]], [r[3] for r in units if not r[1]])) < 1e-9
    assert abs(got.low - np.percentile(a, 2.5)) < 2e-6 and abs(got.high - np.percentile(a, 97.5)) < 2e-6


def test_caliper_is_matched_anew(spark, units):
    df = spark.createDataFrame(units, "u long, pos boolean, f double, s double")
    got = resample.caliper_interval(df, "u", "pos", "f", "s", 30, SEED).first()
    a = []
    for rep in range(1, 31):
        x = sorted((units[i] for i in draws(rep, len(units))), key=lambda r: r[2])
        p, q = [r for r in x if r[1]], [r for r in x if not r[1]]
        i = j = 0
        m = []
        while i < len(p) and j < len(q):
            d = p[i][2] - q[j][2]
            if abs(d) <= 0.05:
                m.append((p[i], q[j]))
                i, j = i + 1, j + 1
            elif d > 0.05:
                j += 1
            else:
                i += 1
        if len(m) >= 30:
            a.append(auroc([x[3] for x, _ in m], [y[3] for _, y in m]))
    # equal features may be walked in another order: the interval moves little
    assert got.n_defined == len(a) and abs(got.low - np.percentile(a, 2.5)) < 0.03 and abs(got.high - np.percentile(a, 97.5)) < 0.03


def test_curves_crossings_and_transfer(spark):
    rnd = random.Random(2)
    bins = [64, 128, 256, 512]
    rows = [(u, g, b, 1.0 / (b / 64) ** (0.8 if g == "en" else 0.8 + 0.6 * (g == "fr")) + rnd.gauss(0, 0.02)) for u in range(30) for g in ("en", "de", "fr") for b in bins]
    c = resample.drawn_curves(spark.createDataFrame(rows, "u long, g string, b int, y double"), "u", "g", "b", "y", 60, SEED).persist()
    mean = {(g, b): np.mean([r[3] for r in rows if r[1:3] == (g, b)]) for g in ("en", "de", "fr") for b in bins}
    assert all(abs(y - mean[(r.g, b)]) < 1e-9 for r in c.where("rep = 0").collect() for b, y in zip(r.xs, r.ys))
    one = c.where("rep = 3 AND g = 'de'").first()
    h = draws(3, 30)
    assert all(abs(y - np.mean([rows_y for i in h for rows_y in [r[3] for r in rows if r[0] == i and r[1] == "de" and r[2] == b]])) < 1e-9 for b, y in zip(one.xs, one.ys))
    x = {(r.g, r.level): r for r in resample.crossing_intervals(c, "g", [0.5, 0.05, 2.0]).collect()}
    assert x["en", 0.5].low < x["en", 0.5].point < x["en", 0.5].high and x["fr", 0.5].high < x["en", 0.5].low
    assert (x["en", 2.0].point_code, x["en", 2.0].high_code, x["en", 2.0].left_censored) == (1, 1, 1.0)
    assert (x["en", 0.05].point_code, x["en", 0.05].low_code, x["en", 0.05].right_censored) == (2, 2, 1.0)
    band = {(r.g, r.x): r.inside for r in resample.transfer_band(c, "g", "en").collect()}
    assert not any(band["fr", b] for b in bins[1:]) and sum(band["de", b] for b in bins) >= 3
    c.unpersist()


def pooled(y):
    """Non-increasing fit by pooling neighbours."""
    out = []
    for v in y:
        out.append([v, 1])
        while len(out) > 1 and out[-2][0] < out[-1][0]:
            (p, m), (q, n) = out[-2], out.pop()
            out[-1] = [(p * m + q * n) / (m + n), m + n]
    return [v for v, n in out for _ in range(n)]


def test_fits_and_crossings_of_many_curves(spark):
    rnd = np.random.default_rng(4)
    y = np.concatenate([[[3.0, 1, 2, 0], [1, 1, 1, 1], [0, 1, 2, 3]], rnd.normal(size=(50, 4)), [[1, np.nan, 0, 0]]])
    assert np.allclose(resample.isotonic_fits(y)[:-1], [pooled(v) for v in y[:-1]]) and np.isnan(resample.isotonic_fits(y)[-1]).any()
    v, code = resample.crossings(np.array([64, 128, 256]), np.array([[1.0, 0.5, 0.0]]), 0.5)
    assert code.tolist() == [0] and abs(v[0] - 128) < 1e-6
    assert resample.crossings(np.array([64, 128]), np.array([[0.4, 0.1], [0.9, 0.8], [0.9, np.nan]]), 0.5)[1].tolist() == [1, 2, 3]
    # the same rule as the one for a single curve
    bins = [64, 128, 256, 512]
    for i, curve in enumerate(resample.isotonic_fits(rnd.random((6, 4)))):
        one = {r.level: r for r in fit.level_crossing(spark.createDataFrame(list(zip(bins, curve.tolist())), "b int, y double"), "b", "y", [0.3, 0.5, 0.7]).collect()}
        for level, r in one.items():
            at, code = resample.crossings(np.array(bins), curve[None], level)
            assert code[0] == r.code and (r.crossing is None or abs(at[0] - r.crossing) < 1e-6), (i, level)


def test_intervals_of_curves_run_the_counts_of_the_reference(spark, sf, monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    def stop(*a):
        seen.append([x for x in a if isinstance(x, int)][-1])
        raise Stop

    for f in ("drawn_curves", "caliper_interval", "unit_auroc"):
        monkeypatch.setattr(resample, f, stop)
    for q in ("crossing_interval", "held_out_transfer", "caliper_bootstrap", "anchor_bootstrap_auroc"):
        with pytest.raises(Stop):
            inference.QUERIES[q](spark, sf)
    assert seen == [10_000] * 4


@pytest.mark.parametrize("block", [4, 50])
def test_pairs_by_blocks(spark, block):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(30, 6))
    df = spark.createDataFrame([(int(i * 37 % 101), i % 3, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, v array<double>")
    got = {(r.vec_id_a, r.vec_id_b): r for r in pairs.all_pairs(df, block).collect()}
    rows = {r.vec_id: r for r in df.collect()}
    assert set(got) == {(a, b) for a in rows for b in rows if a < b}
    for (a, b), r in got.items():
        assert abs(r.dot - np.dot(rows[a].v, rows[b].v)) < 1e-12 and (r.label_a, r.label_b) == (rows[a].label, rows[b].label) and abs(r.gap - abs(rows[a].v[0] - rows[b].v[0])) < 1e-12
    assert pairs.all_pairs(df.where("false")).count() == 0 and pairs.all_pairs(df.limit(1)).count() == 0


def test_ranks_by_ranges_equal_pairs(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("ab"), rnd.random() < 0.4, rnd.choice([-3.5, 0.0, 0.015625, rnd.gauss(0, 1), rnd.gauss(0, 40)])) for _ in range(400)] + [("c", True, 1.0), ("a", True, None)]
    df = spark.createDataFrame(rows, "k string, pos boolean, s double")
    for r in scoring.auroc(df, ["k"], "s", F.col("pos")).collect():
        p, q = ([s for k, y, s in rows if k == r.k and y == want and s is not None] for want in (True, False))
        assert (r.n_pos, r.n_neg) == (len(p), len(q)) and (r.auroc is None if not q else abs(r.auroc - auroc(p, q)) < 1e-12)


def test_spans_of_edited_sentences(spark):
    cases = [(["a", "b", "c"], ["a", "x", "c"]), (["a", "b"], ["a", "b", "c"]), (["a", "b", "c"], ["a", "c"]), (["a"], ["a"]), ([], ["a"]), (["a", "b", "c"], ["x", "y", "z"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = {r.i: (tuple(r.c) if r.c else None) for r in df.select("i", T.changed_span(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {0: ("b", "x", True), 1: ("b", "c", False), 2: ("b", "a c", False), 3: None, 4: ("", "a", False), 5: ("a b c", "x y z", False)}


def test_closed_vocabulary_and_resume_guard(spark):
    df = spark.createDataFrame([("yes",), ("no",), (None,)], "x string")
    assert [r[0] for r in df.select(T.closed_map(F.col("x"), {"yes": "keep", "no": None})).collect()] == ["keep", None, None]
    with pytest.raises(Exception, match="unknown label"):
        df.select(T.closed_map(F.col("x"), {"yes": "keep"})).collect()
    todo = spark.createDataFrame([(1, "c1"), (2, "c1")], "id long, config string")
    done = lambda c: spark.createDataFrame([(1, c)], "id long, config string")
    assert [r.id for r in integrity.resume(todo, done("c1"), "id", "config").collect()] == [2]
    with pytest.raises(Exception, match="another configuration"):
        integrity.resume(todo, done("c2"), "id", "config").collect()


def test_short_items_have_an_anchor(spark):
    df = spark.createDataFrame([("one three",), ("single",), ("a longest b",), ("",)], "x string")
    assert [r[0] for r in df.select(T.longest_inner(T.ws_tokens(F.col("x")))).collect()] == ["three", "single", "longest", ""]
