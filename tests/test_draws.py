import hashlib

import random

import pytest

from siftgate.operators import draws, resample


def test_md5_of_arrays_is_md5():
    heads, tails = ["20260805|7|", "20260805|9|", "é|234567890"], ["0", "5", "x"]
    for h, t in ((heads[:2], tails), (heads[:2], ["1234567", "7654321"]), (["a" * 40], ["b" * 15]), ([""], ["abc"])):
        got = draws.md5(draws.letters(h), draws.letters(t))
        for i, x in enumerate(h):
            for j, y in enumerate(t):
                assert "".join(f"{w[i, j]:08x}" for w in got) == hashlib.md5((x + y).encode()).hexdigest()


def test_places_equal_single_hashes():
    for n in (1, 7, 101, 9000):
        for rep, at in draws.places("s", range(8, 13), n):
            assert at.tolist() == [int(int(hashlib.md5(f"s|{rep}|{i}".encode()).hexdigest()[:8], 16) / 2**32 * n) for i in range(n)]
    assert [r for r, _ in draws.places("s", range(8, 13), 5)] == [8, 9, 10, 11, 12]


def test_no_draw_is_shuffled(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "u long, x double")
    plan = draws.replicated(df, "u", 500, "s", lambda c: lambda at: (float(c["x"][at].sum()),), "m double")
    assert plan.rdd.getNumPartitions() > 1
    got = {r.rep: r.m for r in plan.collect()}
    assert len(got) == 500 and got[3] == sum(at.sum() for _, at in draws.places("s", range(3, 4), 50))


@pytest.mark.parametrize("band", [6.0, 0.05])
def test_permutation_with_shares_and_missed_bands(spark, monkeypatch, band):
    monkeypatch.setattr(resample, "SHARE", 16)
    monkeypatch.setattr(resample, "BAND", band)
    rnd = random.Random(5)
    rows = [(i * 37, rnd.random() < 0.7, round(rnd.random(), 6)) for i in range(90)]
    n, k, v = len(rows), sum(p for _, p, _ in rows), {u: round(x * 1e6) for u, _, x in rows}
    far = lambda t: abs(t * n - sum(v.values()) * k)
    lowest = lambda rep: sorted((hashlib.md5(f"s|{rep}|{u}".encode()).hexdigest(), u) for u in v)[:k]
    hits = sum(far(sum(v[u] for _, u in lowest(rep))) >= far(sum(v[u] for u, p, _ in rows if p)) for rep in range(1, 121))
    got = resample.permutation(spark.createDataFrame(rows, "u int, p boolean, x double"), "u", "p", "x", 120, "s").first()
    assert (got.n_pos, got.hits) == (k, hits)


def test_missing_values_are_drawn_but_not_counted(spark):
    rows = [(i, i % 2 == 0, None if i % 5 == 0 else float(i)) for i in range(21)]
    df = spark.createDataFrame(rows, "u int, p boolean, x double")
    assert resample.mean_interval(df, "u", "x", 20, "s").first().low is not None
    assert resample.unit_auroc(df, "u", "p", "x", 20, "s").first().n == sum(x is not None for *_, x in rows)
    r = resample.median_gap(df, "u", "p", "x", reps=20, seed="s", low=1, high=20).first()
    assert r.low <= r.point <= r.high
