"""Quality rules with risk-controlled thresholds. Native: DataFrame and SQL functions only.

Each rule rejects a document whose feature exceeds a cutoff; a document goes if any rule rejects it. Cutoffs are chosen
together, for each stratum (language). A quarter of the labelled good documents (by md5 of their id) proposes: for each rule
the feature that a share of ``TAIL`` of them exceeds. Multiples of these cutoffs are tested from the laxest (``FACTORS``) to the
strictest on the other three quarters, a holdout that no cutoff has seen. A test passes if, were the rate of false rejection
by all rules together ``risk`` or more, so few rejected good documents would come up with a probability of at most
``delta / strata`` (exact binomial tail). The first failure ends the sequence, so the multiples cost no further correction;
strata are corrected for by the division. Together: with probability 1 - delta, in no stratum more than ``risk`` of the good
documents that pass the base are rejected. A stratum needs ln(delta / strata) / ln(1 - risk) labelled good documents in the
holdout, 108 at the defaults and four strata, none of them rejected, to get cutoffs at all; without them it rejects nothing.

Cases: null and empty texts have no words (base_failed); a null language is a stratum; ids may be null (not labelled)
or repeated; labels with a null quality count for nothing, of several for one id the worst counts; columns besides
doc_id, text and lang are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

RISK, DELTA = 0.04, 0.05
#: Share of the proposing documents beyond each rule's cutoff, and the multiples tried, in this order.
TAIL, FACTORS = 0.001, (4.0, 3.0, 2.0, 1.5, 1.2, 1.0)
#: Features are compared in steps; those beyond MOST steps are alike. No cutoff is below LEAST steps.
STEPS, MOST, LEAST = 1000, 4000, 10
RULES = {
    "symbols": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "capitals": "n_capitals / word_chars",
    "exclamations": "n_exclamations / n_words",
    "echoes": "n_echoes / n_words",
    "length": "word_chars / (10 * n_words)",
}
#: W: words; S: (hash, place) of each 8-word window by hash; P: places of windows found twice or more, in order.
REPEATS = """
if(size(w) < 8, 0L, transform(array(w), W ->
 transform(array(sort_array(transform(sequence(0, size(W) - 8), i -> struct(xxhash64(slice(W, i + 1, 8)) AS h, i AS i)))), S ->
  aggregate(sort_array(transform(filter(S, (x, j) -> (j > 0 AND S[greatest(j - 1, 0)].h = x.h) OR
      (j < size(S) - 1 AND S[least(j + 1, size(S) - 1)].h = x.h)), x -> x.i)),
    struct(0L AS n, -8 AS last), (a, i) -> struct(a.n + least(8, i - a.last) AS n, i AS last), a -> a.n))[0])[0])
"""


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_exclamations, n_echoes``."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    t = t.withColumn("w", C.words(F.col("text"))).withColumn("l", F.filter(F.split("text", "\n"), lambda x: x.rlike(C.NOT_SPACE)))
    return t.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr(REPEATS).alias("n_repeat_words"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        count("!").alias("n_exclamations"),
        F.expr("transform(array(w), W -> size(filter(W, (x, i) -> i > 0 AND W[greatest(i - 1, 0)] = x)))[0]").cast("long").alias("n_echoes"),
    )


def steps() -> list:
    """The rules' features as whole numbers of steps."""
    share = lambda x: F.coalesce(F.expr("try_divide({}, {})".format(*x.split(" / "))), F.lit(0.0))
    return [F.least(F.ceil(share(x) * STEPS), F.lit(MOST)).cast("int").alias(r) for r, x in RULES.items()]


#: P(X <= k) of a binomial, summed as logarithms; above the mean it is no evidence and counts as 1.
TAIL_SUM = """
if(k > n * {p}, 1.0D, exp(aggregate(sequence(1L, k), struct(n * ln(1 - {p}) AS t, n * ln(1 - {p}) AS s),
  (a, i) -> transform(array(a.t + ln((n - i + 1) / i) + ln({p} / (1 - {p}))), t ->
     struct(t AS t, greatest(a.s, t) + log1p(exp(-abs(a.s - t))) AS s))[0], a -> a.s)))
"""


def proposals(good: DataFrame, tail: float = TAIL) -> DataFrame:
    """``lang`` and each rule's cutoff (in steps): the least feature with at most that share of the rows beyond it.

    Counts per step are at most ``MOST`` rows for a stratum and rule, so no task holds a stratum."""
    each = good.select("lang", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES])).alias("x")).select("lang", "x.*")
    n = each.groupBy("lang", "rule", "step").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang", "rule")
    beyond = F.coalesce(F.sum("n").over(by.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("beyond", beyond).withColumn("every", F.sum("n").over(by)).where(F.col("beyond") <= tail * F.col("every"))
    return n.groupBy("lang").agg(*[F.greatest(F.min(F.when(F.col("rule") == r, F.col("step"))), F.lit(LEAST)).alias(r) for r in RULES])


def rejects(r: str):
    return F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))


def cutoffs(f: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, factors: tuple[float, ...] = FACTORS) -> DataFrame:
    """``lang, factor, n, false_rejections, tail, cut_<rule>`` of the least certified factor of each stratum that has one.

    ``f`` has ``doc_id, lang, base_failed`` and the rules' features in steps."""
    l = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1")
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), 16, 10).cast("int") % 4
    good = C.table(f.where("NOT base_failed").join(l, "doc_id").select("lang", *RULES, part.alias("part")), "good")
    g = proposals(good.where("part = 0")).withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
    g = C.table(g.select("lang", "factor", *[F.ceil(F.col("factor") * F.col(r)).alias(f"cut_{r}") for r in RULES]), "grid")
    by = good.where("part > 0").join(g, "lang").withColumn("no", F.greatest(*[rejects(r) for r in RULES]))
    by = by.groupBy("lang", "factor").agg(F.count("*").alias("n"), F.count_if("no").alias("k"))
    by = by.crossJoin(F.broadcast(by.agg(F.count_distinct("lang").alias("strata"))))  # one row
    tail = "if(k = 0, exp(n * ln(1 - {p})), {t})".format(p=risk, t=TAIL_SUM.replace("{p}", str(risk)))
    by = by.withColumn("tail", F.expr(tail)).withColumn("passed", (F.col("tail") <= F.lit(delta) / F.col("strata")).cast("int"))
    so_far = F.min("passed").over(Window.partitionBy("lang").orderBy(F.desc("factor")).rowsBetween(Window.unboundedPreceding, 0))
    best = by.withColumn("so_far", so_far).where("so_far = 1").groupBy("lang")
    best = best.agg(F.min("factor").alias("factor"), F.first("n").alias("n"), F.min_by("k", "factor").alias("false_rejections"), F.min_by("tail", "factor").alias("tail"))
    return best.join(g, ["lang", "factor"])


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, factors: tuple[float, ...] = FACTORS) -> DataFrame:
    """:func:`features`, ``base_failed``, ``failed`` (names of the rules that reject) and ``kept``."""
    f = features(docs).withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    f = C.table(f.select("*", *steps()), "features")
    c = C.table(cutoffs(f, labels, risk, delta, factors).select("lang", *[f"cut_{r}" for r in RULES]), "cutoffs")
    failed = F.filter(F.array(*[F.when(rejects(r), F.lit(r)) for r in RULES]), lambda x: x.isNotNull()).alias("failed")
    f = f.join(c, "lang", "left").withColumn("failed", failed).drop(*RULES, *[f"cut_{r}" for r in RULES])
    return f.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    r = quality_rules(docs, labels)
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))
