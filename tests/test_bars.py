import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from siftgate.operators import bars, resample
from siftgate.plans import bars as queries

REPS, SEED = 700, "s"


def _draws(rep, n):
    return [int(int(hashlib.md5(f"{SEED}|{rep}|{i}".encode()).hexdigest()[:8], 16) / 2**32 * n) for i in range(n)]


def _auroc(rows):
    p, q = ([s for pair, s in rows if pair == k] for k in ("flip", "faithful"))
    return sum((a < b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q)) if p and q else math.nan


def _cells(spark, tell, n=9):
    """tell: how far flips lie below paraphrases at a bin, for a configuration and language."""
    rnd = random.Random(4)
    rows = []
    for config, _, window in bars.CONFIGS:
        for lang in ("en", "de"):
            for b in (64, 128, 256, 512, 1024):
                if window is None or b <= window:
                    for i in range(n):
                        for position in ("early", "middle", "late"):
                            for pair in ("flip", "faithful", "scope"):
                                far = tell(config, lang, b)
                                s = 1 - far * (pair == "flip") - (0.01 * rnd.random() if far else 0)
                                rows.append((config, window, 100 + i, lang, b, position, pair, round(s, 4)))
    return rows, spark.createDataFrame(rows, "config string, window int, item_id long, lang string, bin int, position string, pair string, score double")


def test_replicates_equal_plain_resampling(spark):
    rows, df = _cells(spark, lambda c, lang, b: 0.008 if c == "jaccard" else 0.3 / b)
    w = bars.weights(df, "item_id", REPS, SEED)
    got = {(r.config, r.bin, r.rep): r.auroc for r in bars.replicate_aurocs(df.where("lang = 'en'"), ["config", "bin"], "item_id", w).collect()}
    for config, b in (("jaccard", 64), ("content", 1024), ("jaccard_512", 512)):
        own = {i: [(pair, s) for c, _, u, lang, bb, _, pair, s in rows if (c, lang, bb, u) == (config, "en", b, 100 + i)] for i in range(9)}
        for rep in (0, 1, 7, 499, 500, 501, 700):
            units = range(9) if rep == 0 else _draws(rep, 9)
            assert abs(got[config, b, rep] - _auroc([x for i in units for x in own[i]])) < 1e-12
    a = [got["content", 64, r] for r in range(1, REPS + 1)]
    r = {(x.config, x.bin): x for x in bars.bounds(bars.replicate_aurocs(df.where("lang = 'en'"), ["config", "bin"], "item_id", w), ["config", "bin"]).collect()}["content", 64]
    assert abs(r.low - np.percentile(a, 2.5)) < 1e-4 and abs(r.high - np.percentile(a, 97.5)) < 1e-4 and abs(r.point - got["content", 64, 0]) < 1e-12


def test_exponents_are_refitted_for_each_replicate(spark):
    rnd = random.Random(2)
    rows = [(i, c, b, (0.5 if c == "jaccard" else 0.3) * (64 / b) ** (1.0 if c == "jaccard" else 0.6) * (1 + 0.1 * rnd.random())) for i in range(12) for c in ("jaccard", "content") for b in (64, 128, 256, 512)]
    rows += [(i, "few", b, 0.1) for i in range(12) for b in (64, 128)]
    df = spark.createDataFrame(rows, "item_id long, config string, bin int, y double")
    curves = resample.drawn_curves(df, "item_id", "config", "bin", "y", 80, SEED)
    r = {x.config: x for x in bars.exponent_intervals(bars.exponents(curves), "jaccard").collect()}
    assert r["few"].alpha is None
    assert r["jaccard"].low < r["jaccard"].alpha < r["jaccard"].high and abs(r["jaccard"].alpha - 1.0) < 0.05
    assert r["jaccard"].gap_low == r["jaccard"].gap_high == 0 and r["content"].gap_high < 0

    def alpha(units, c):
        y = [np.mean([v for i in units for u, k, bb, v in rows if (u, k, bb) == (i, c, b)]) for b in (64, 128, 256, 512)]
        return np.polyfit([math.log(64 / b) for b in (64, 128, 256, 512)], np.log(y), 1)[0]

    a = [alpha(_draws(rep, 12), "content") for rep in range(1, 81)]
    assert abs(r["content"].low - np.percentile(a, 2.5)) < 2e-4 and abs(r["content"].alpha - alpha(range(12), "content")) < 1e-4


def test_verdicts(spark):
    at = lambda rows, *more, **kw: tuple(bars.verdict(spark.createDataFrame(rows, "config string, passes boolean"), "b", "p", *more, **kw).first())[2:]
    assert at([("a", True), ("b", True)], 2) == (2, 2, "PASS")
    assert at([("a", True)], 2) == (1, 1, "PASS_EXCLUDING_VACUOUS")  # one configuration can't be judged
    assert at([("a", True), ("b", False)], 2) == (1, 2, "FAIL")
    assert at([], 2) == (0, 0, "PENDING_DATA")
    assert at([("a", True), ("b", False), ("c", True)], 4, F.expr("(evaluable + 1) DIV 2")) == (2, 3, "PASS")


def test_bars_of_intervals_tell_made_cases_apart(spark):
    """Changes that can't be told from paraphrases beyond the shortest bins, alike in both languages; then changes told everywhere."""
    for tell, want in ((lambda c, lang, b: 0.0 if b >= 512 else 0.3, {"H2a": "PASS_EXCLUDING_VACUOUS", "H6": "PASS"}), (lambda c, lang, b: 0.3 if lang == "en" else 0.0, {"H2a": "FAIL", "H2c": "FAIL", "H6": "FAIL"})):
        _, df = _cells(spark, tell, 6)
        df = df.where("config <> 'jaccard_512' OR bin < 512")  # no bin that H2a asks for
        got = {r.bar: r.verdict for r in queries.interval_bars("p", df, 60, SEED).collect()}
        assert {k: got[k] for k in want} == want and set(got) == {"H1", "H1_alpha_is_one", "H1_alpha_is_lexical", "H2a", "H2c", "H6"}
