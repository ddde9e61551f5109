"""The registered bars: one row for each bar and population. Those of points alone have SQL; those of intervals are tested against plain
resampling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bars, passages, resample, scoring
from ..sources.tables import table
from . import oracle as O
from .queries import SEED, cells

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The language whose curves are fitted; the others are held out.
HOME = "en"
#: The configuration that stands for the gate in use, and the one that exponents are compared with.
PRODUCTION, LEXICAL = "content", "jaccard"
# Fixed values of the bars.
BAND, UPPER, FLOOR, GAP, SHARE, CAP = (0.8, 1.2), 0.60, 0.55, 0.05, 0.90, 3
TOTAL = len(bars.CONFIGS)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scored(spark, d) -> DataFrame:
    """Cells of all configurations (kept: every bar reads them)."""
    return bars.configured(cells(spark, d)).persist()


def populations(spark, d, x: DataFrame) -> list[tuple[str, DataFrame]]:
    cohort = passages.cohort(passages.anchors(table(spark, d, "benchmark")))
    return [("full_set", x), ("constant_cohort", x.join(cohort, "item_id", "left_semi"))]


def all_rows(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def _seen(c: str, window: int | None, stops: bool) -> str:
    t = O.TOK.format(c if window is None else f"array_to_string({O.ws(c)}[1:ceil({window} / 1.3)::INT], ' ')")
    return t if stops else f"list_filter({t}, lambda t: NOT list_contains([{', '.join(repr(w) for w in T.STOP_WORDS)}], t))"


def _score(window: int | None, stops: bool) -> str:
    x, y = _seen("text_a", window, stops), _seen("text_b", window, stops)
    return f"(SELECT CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END FROM (SELECT {x} AS x, {y} AS y))"


_SCORED = f"""{O.CELLS}, sc AS ({" UNION ALL ".join(f"SELECT '{n}' AS config, {w or 'NULL'}::INT AS win, item_id, lang, bin, position, pair, {_score(w, s)} AS score FROM ce{f' WHERE bin <= {w}' if w else ''}" for n, s, w in bars.CONFIGS)}),
co AS (SELECT item_id FROM eb GROUP BY item_id HAVING bool_and(fits)),
po AS (SELECT 'full_set' AS population, sc.* FROM sc UNION ALL SELECT 'constant_cohort', sc.* FROM sc WHERE item_id IN (SELECT item_id FROM co)),
ps(population) AS (VALUES ('full_set'), ('constant_cohort'))"""


def _verdict(bar: str, source: str, least: str | None = None, excluding: str = "PASS_EXCLUDING_VACUOUS") -> str:
    ok, whole = ("met >= " + least, "'PASS'") if least else ("met = evaluable", f"CASE WHEN evaluable < {TOTAL} THEN '{excluding}' ELSE 'PASS' END")
    return f"""SELECT '{bar}' AS bar, population, met, evaluable, CASE WHEN evaluable = 0 THEN 'PENDING_DATA' WHEN {ok} THEN {whole} ELSE 'FAIL' END AS verdict
FROM (SELECT ps.population, count(*) FILTER (passes) AS met, count(config) AS evaluable FROM ps LEFT JOIN {source} USING (population) GROUP BY ps.population)"""


_HALF = f"""hm AS (SELECT population, config, max(bin) AS top FROM po WHERE lang = '{HOME}' GROUP BY population, config),
h3c AS (SELECT population || '/' || config || '/' || position AS k, population, config, position, score, pair = 'flip' AS flip FROM po JOIN hm USING (population, config) WHERE lang = '{HOME}' AND position <> 'middle' AND pair IN ('flip', 'faithful') AND bin <= coalesce(win, top) / 2.0),
{O.ranked('h3c', 'score', 'flip', 'k')},
h3a AS (SELECT split_part(k, '/', 1) AS population, split_part(k, '/', 2) AS config, split_part(k, '/', 3) AS position, u2 / (2.0 * n_pos * n_neg) AS a FROM r),
h3 AS (SELECT population, config, max(CASE WHEN position = 'early' THEN a END) - max(CASE WHEN position = 'late' THEN a END) >= {GAP} AS passes FROM h3a GROUP BY population, config HAVING count(*) = 2),
h4b AS (SELECT population, config, bin, avg((score >= 0.85)::INT) AS m85, avg((score >= 0.95)::INT) AS m95 FROM po WHERE lang = '{HOME}' AND pair = 'flip' GROUP BY ALL),
h4 AS (SELECT population, config, bool_and(m85 >= 0.95) FILTER (bin >= 256) AND bool_and(m95 >= 0.90) FILTER (bin >= 128) AS passes FROM h4b GROUP BY ALL HAVING count(*) FILTER (bin >= 256) > 0),
h5 AS (SELECT bin, CASE WHEN count(*) >= 3 AND stddev(score) > 0 AND stddev((pair = 'flip')::INT) > 0 THEN corr(score, (pair = 'flip')::INT) END AS r FROM sc WHERE config = '{LEXICAL}' AND lang = '{HOME}' AND pair IN ('flip', 'faithful') AND bin >= 512 GROUP BY bin),
e0 AS (SELECT 'full_set' AS population, config, avg(1 - score) < {GAP} AS passes FROM sc WHERE lang = '{HOME}' AND pair = 'flip' AND bin = 64 GROUP BY config)"""


@query(f"""WITH {_SCORED}, {_HALF}
{_verdict('H3a', 'h3', '(evaluable + 1) // 2')} UNION ALL {_verdict('H4', 'h4', excluding='PASS_EXCLUDING_NONEVALUABLE')}
UNION ALL SELECT 'H5', 'lexical', met, evaluable, CASE WHEN evaluable = 0 THEN 'PENDING_DATA' WHEN met < evaluable THEN 'FAIL' WHEN evaluable < 4 THEN 'PASS_ON_AVAILABLE_BINS' ELSE 'PASS' END
FROM (SELECT count(*) FILTER (abs(r) < 0.10) AS met, count(r) AS evaluable FROM h5)
UNION ALL SELECT * FROM ({_verdict('external_anchor', 'e0')}) WHERE population = 'full_set'""")
def bars_of_points(spark, d):
    """H3a (early positions beat late ones for half the configurations), H4 (long texts let changes pass), H5 (scores of long
    texts don't tell the classes), and the external anchor (the shortest bin shows no change)."""
    x = scored(spark, d)
    out = []
    flip = F.col("pair") == "flip"
    for name, p in populations(spark, d, x):
        home = p.where(F.col("lang") == HOME)
        top = home.groupBy("config").agg(F.max("bin").alias("top"))
        near = home.join(F.broadcast(top), "config").where("pair IN ('flip', 'faithful') AND bin <= coalesce(window, top) / 2 AND position <> 'middle'")  # a row for each configuration
        a = scoring.auroc(near, ["config", "position"], "score", flip).groupBy("config").agg(*[F.max(F.when(F.col("position") == k, F.col("auroc"))).alias(k) for k in ("early", "late")])
        half = a.where("early IS NOT NULL AND late IS NOT NULL").select("config", (F.col("early") - F.col("late") >= GAP).alias("passes"))
        out.append(bars.verdict(half, "H3a", name, TOTAL, F.expr("(evaluable + 1) DIV 2")))
        miss = home.where(flip).groupBy("config", "bin").agg(F.avg((F.col("score") >= 0.85).cast("int")).alias("m85"), F.avg((F.col("score") >= 0.95).cast("int")).alias("m95"))
        long = miss.groupBy("config").agg(F.bool_and(F.when(F.col("bin") >= 256, F.col("m85") >= 0.95)).alias("a"), F.bool_and(F.when(F.col("bin") >= 128, F.col("m95") >= 0.90)).alias("b"))
        out.append(bars.verdict(long.where("a IS NOT NULL AND b IS NOT NULL").select("config", F.expr("a AND b").alias("passes")), "H4", name, TOTAL, excluding="PASS_EXCLUDING_NONEVALUABLE"))
    y = flip.cast("int")
    lexical = x.where((F.col("config") == LEXICAL) & (F.col("lang") == HOME) & F.col("pair").isin("flip", "faithful") & (F.col("bin") >= 512)).withColumn("y", y)
    r = lexical.groupBy("bin").agg(F.when((F.count("*") >= 3) & (F.stddev("score") > 0) & (F.stddev("y") > 0), F.corr("score", "y")).alias("r"))
    bins = len([b for b in passages.BINS if b >= 512])
    n = r.agg(F.count_if(F.abs("r") < 0.10).alias("met"), F.count("r").alias("evaluable"))
    out.append(n.select(F.lit("H5").alias("bar"), F.lit("lexical").alias("population"), "met", "evaluable", F.when(F.col("evaluable") == 0, "PENDING_DATA").when(F.col("met") < F.col("evaluable"), "FAIL").when(F.col("evaluable") < bins, "PASS_ON_AVAILABLE_BINS").otherwise("PASS").alias("verdict")))
    first = x.where((F.col("lang") == HOME) & flip & (F.col("bin") == 64)).groupBy("config").agg((F.avg(1 - F.col("score")) < GAP).alias("passes"))
    out.append(bars.verdict(first, "external_anchor", "full_set", TOTAL))
    return all_rows(out)


def interval_bars(name: str, p: DataFrame, reps: int, seed: str) -> DataFrame:
    """H1 (the change falls as a power of the length), H2a (long texts are told at chance), H2c (so is every cell of the
    configuration in use) and H6 (curves of the home language hold for the others) for ``p`` of :func:`scored`."""
    w = bars.weights(p, "item_id", reps, seed)
    home = p.where(F.col("lang") == HOME)
    curves = resample.drawn_curves(home.where("pair = 'flip'").withColumn("y", 1 - F.col("score")), "item_id", "config", "bin", "y", reps, seed)
    fits = bars.exponent_intervals(bars.exponents(curves), LEXICAL).where("alpha IS NOT NULL").persist()  # a row for each configuration
    out = [bars.verdict(fits.select("config", F.round("alpha", 4).between(*BAND).alias("passes")), "H1", name, TOTAL)]
    out.append(bars.verdict(fits.select("config", ~((F.col("low") > 1) | (F.col("high") < 1))).toDF("config", "passes"), "H1_alpha_is_one", name, TOTAL))
    out.append(bars.verdict(fits.where(F.col("config") != LEXICAL).select("config", ~((F.col("gap_low") > 0) | (F.col("gap_high") < 0))).toDF("config", "passes"), "H1_alpha_is_lexical", name, TOTAL - 1))
    drawn = bars.replicate_aurocs(p, ["config", "lang", "bin"], "item_id", w).persist()
    long = bars.bounds(drawn.where((F.col("lang") == HOME) & (F.col("bin") >= 512)), ["config", "bin"]).where("high IS NOT NULL")
    out.append(bars.verdict(long.groupBy("config").agg(F.bool_and(F.col("high") < UPPER).alias("passes")), "H2a", name, TOTAL))
    each = bars.bounds(bars.replicate_aurocs(p.where(F.col("config") == PRODUCTION), ["lang", "bin", "position"], "item_id", w), ["lang", "bin", "position"]).where("low IS NOT NULL")
    out.append(bars.verdict(each.select("lang", (F.col("low") <= FLOOR).alias("passes")), "H2c", name, 0))
    knots = drawn.where("auroc IS NOT NULL").groupBy("config", "rep", "lang").agg(F.array_sort(F.collect_list(F.struct(F.col("bin").alias("x"), F.col("auroc").alias("v")))).alias("c")).select("config", "rep", "lang", F.col("c.x").alias("xs"), F.col("c.v").alias("ys"))
    band = resample.transfer_band(knots, "lang", HOME, ["config"])
    n = band.groupBy("config").agg(F.count("*").alias("n"), F.count_if("inside").alias("k"))
    n = n.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("met"), F.coalesce(F.sum("n"), F.lit(0)).alias("evaluable"), F.coalesce(F.max(F.col("n") - F.col("k")), F.lit(0)).alias("most_outside"))
    out.append(n.select(F.lit("H6").alias("bar"), F.lit(name).alias("population"), "met", "evaluable", F.when(F.col("evaluable") == 0, "PENDING_DATA").when((F.col("met") >= F.ceil(SHARE * F.col("evaluable"))) & (F.col("most_outside") <= CAP), "PASS").otherwise("FAIL").alias("verdict")))
    return all_rows(out)


@query(None)
def bars_of_intervals(spark, d):
    """H1, H2a, H2c and H6 with items drawn 10,000 times, for all items."""
    (name, p), _ = populations(spark, d, scored(spark, d))
    return interval_bars(name, p, resample.BOOTSTRAPS, SEED)


@query(None)
def bars_of_intervals_cohort(spark, d):
    """:func:`bars_of_intervals` for the items eligible in all bins."""
    _, (name, p) = populations(spark, d, scored(spark, d))
    return interval_bars(name, p, resample.BOOTSTRAPS, SEED)
