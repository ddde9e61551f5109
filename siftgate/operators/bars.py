"""Bars over configurations and populations: what each configuration shows, which of them can be judged, and a verdict.

A configuration is a lexical scorer with a window: it sees the first words of a text that fit into so many subword tokens, so cells of
longer bins are beyond its window and are never judged. A configuration without a bin that a bar asks for is not evaluable: it never counts as a
pass, and a bar that all others pass is passed *excluding* it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import draws

#: Name, whether stop words count, window in subword tokens (none: whole texts).
CONFIGS = [("jaccard", True, None), ("content", False, None), ("jaccard_512", True, 512), ("content_1024", False, 1024)]


def configured(cells: DataFrame) -> DataFrame:
    """Cells of :func:`.passages.titration` as rows ``config, window, item_id, lang, bin, position, pair, score`` of each configuration
    whose window holds the bin. Members that the window holds as well have the cell's own score; only longer ones are cut and scored anew."""

    def seen(c: str, window: int, stops: bool) -> Column:
        t = F.array_join(F.slice(T.ws_tokens(F.col(c)), F.lit(1), T.budget(F.lit(window)).cast("int")), " ")
        return T.token_set(t) if stops else T.stopped(T.token_set(t))

    def score(window: int | None, stops: bool) -> Column:
        whole = F.col("score" if stops else "content")
        if window is None:
            return whole
        cut = T.set_jaccard(seen("text_a", window, stops), seen("text_b", window, stops))
        return F.when(F.col("bin") <= window, F.when(F.col("longest") <= T.budget(F.lit(window)), whole).otherwise(cut))

    each = [F.struct(F.lit(n).alias("config"), F.lit(w).cast("int").alias("window"), score(w, stops).alias("score")) for n, stops, w in CONFIGS]
    return cells.select("item_id", "lang", "bin", "position", "pair", F.explode(F.array(*each)).alias("x")).select("*", "x.*").drop("x").where("score IS NOT NULL")


def verdict(judged: DataFrame, bar: str, population: str, total: int, least: Column | None = None, excluding: str = "PASS_EXCLUDING_VACUOUS") -> DataFrame:
    """One row ``bar, population, met, evaluable, verdict`` from ``judged(config, passes)``, a row for each evaluable configuration.

    All must pass, or ``least`` (of the column ``evaluable``). Nothing evaluable is pending."""
    n = judged.agg(F.count_if("passes").alias("met"), F.count("*").alias("evaluable"))
    ok = F.col("met") == F.col("evaluable") if least is None else F.col("met") >= least
    whole = F.lit("PASS") if least is not None else F.when(F.col("evaluable") < total, excluding).otherwise("PASS")
    return n.select(F.lit(bar).alias("bar"), F.lit(population).alias("population"), "met", "evaluable", F.when(F.col("evaluable") == 0, "PENDING_DATA").when(ok, whole).otherwise("FAIL").alias("verdict"))


class Drawn(NamedTuple):
    """Draws with replacement of the rows of ``units``, as many as there are, ``reps`` times."""

    units: DataFrame
    reps: int
    seed: str


def weights(units: DataFrame, unit: str, reps: int, seed: str) -> Drawn:
    """How often each unit is drawn; tasks of :func:`replicate_aurocs` count that themselves."""
    return Drawn(units.select(unit).distinct(), reps, seed)


#: Drawn cells (cells times replicates) that are counted at once.
HELD = 1 << 22


def _aurocs(table: pa.Table, drawn: np.ndarray) -> list:
    """For each replicate the chance that a change scores below a paraphrase (ties as half); null where either is missing."""
    scores, flips = table.column("scores").combine_chunks(), table.column("flips").combine_chunks()
    row = np.repeat(np.arange(len(scores)), scores.value_lengths().to_numpy())
    values, code = np.unique(scores.flatten().to_numpy(), return_inverse=True)
    flip = flips.flatten().to_numpy(zero_copy_only=False).astype(bool)

    def by_score(of: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Draws at each score, replicate by replicate."""
        out, o = np.zeros((len(values), w.shape[1]), np.int64), np.argsort(code[of], kind="stable")
        c = code[of][o]
        if len(c):
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            out[c[first]] = np.add.reduceat(w[row[of][o]], first, axis=0, dtype=np.int64)
        return out

    a = []
    step = max(1, HELD // max(1, len(row)))
    for i in range(0, drawn.shape[1], step):
        p, q = (by_score(of, drawn[:, i : i + step]) for of in (flip, ~flip))
        u, total = (q * (2 * (np.cumsum(p, 0) - p) + p)).sum(0), 2.0 * p.sum(0) * q.sum(0)
        a += [x / t if t else None for x, t in zip(u.tolist(), total.tolist(), strict=True)]
    return [pa.array(a, pa.float64())]


def replicate_aurocs(cells: DataFrame, by: list[str], unit: str, w: Drawn) -> DataFrame:
    """``by, rep, auroc`` of ``cells(by, unit, pair, score)``: flips against faithful pairs with units drawn with replacement; rep 0: all
    units once. A unit's cells of a group are one row; a task draws for some replicates and goes through all groups."""
    rows = cells.where("pair IN ('flip', 'faithful')").groupBy(*by, unit).agg(F.collect_list(F.struct("score", (F.col("pair") == "flip").alias("flip"))).alias("x"))
    rows = rows.select(F.to_json(F.struct(*by)).alias("key"), unit, F.col("x.score").alias("scores"), F.col("x.flip").alias("flips"))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    a = draws.weighted(rows, unit, w.units, w.reps, w.seed, _aurocs, "auroc double")
    return a.select(F.from_json("key", ", ".join(f"{c} {kinds[c]}" for c in by)).alias("k"), "rep", "auroc").select(*[F.col(f"k.{c}").alias(c) for c in by], "rep", "auroc")


def bounds(aurocs: DataFrame, by: list[str]) -> DataFrame:
    """``by, point, low, high`` of :func:`replicate_aurocs`, the middle 95 percent rounded to four places."""
    drawn = F.when(F.col("rep") > 0, F.col("auroc"))
    return aurocs.groupBy(*by).agg(F.max(F.when(F.col("rep") == 0, F.col("auroc"))).alias("point"), F.round(F.percentile(drawn, 0.025), 4).alias("low"), F.round(F.percentile(drawn, 0.975), 4).alias("high"))


def exponents(curves: DataFrame, base: float = 64.0) -> DataFrame:
    """``config, rep, alpha`` from ``config, rep, xs, ys``: a power law refitted for each replicate in logs, on positive knots; null
    below three."""
    p = curves.select("config", "rep", F.explode(F.arrays_zip("xs", "ys")).alias("p")).where("p.ys > 0")
    ly, lx = F.log(F.col("p.ys")), F.log(F.lit(base) / F.col("p.xs"))
    return p.groupBy("config", "rep").agg(F.when(F.count("*") >= 3, F.regr_slope(ly, lx)).alias("alpha"))


def exponent_intervals(alphas: DataFrame, lexical: str) -> DataFrame:
    """``config, alpha, low, high, gap_low, gap_high``: the exponent, its interval, and the interval of its difference from that of
    the configuration ``lexical`` over the same draws."""
    other = alphas.where(F.col("config") == lexical).select("rep", F.col("alpha").alias("of"))
    j = alphas.join(other, "rep", "left")
    drawn = lambda x: F.when(F.col("rep") > 0, x)
    p = lambda x, q: F.round(F.percentile(drawn(x), q), 4)
    a, gap = F.col("alpha"), F.col("alpha") - F.col("of")
    return j.groupBy("config").agg(F.round(F.max(F.when(F.col("rep") == 0, a)), 4).alias("alpha"), p(a, 0.025).alias("low"), p(a, 0.975).alias("high"), p(gap, 0.025).alias("gap_low"), p(gap, 0.975).alias("gap_high"))
