"""Queries of the audit's smaller operators: populations, texts, joins, tallies, ordered walks, samples, sets, integrity.

Each stands beside its SQL, which is written apart from it."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import integrity, order, scoring, simjoin
from ..sources.tables import table
from . import oracle as O
from .queries import SEED, doc_pairs, labelled_pairs, next_matches, packet, sentences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def hashed(*parts) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *parts))


# populations and labels

_NORM = O.SQUEEZE


@query(f"""WITH {O.LP}, r AS (SELECT lang, CASE WHEN quality <> 1 THEN 'status' WHEN lang NOT IN ('en', 'fr') THEN 'type' WHEN {_NORM.format('a')} = '' OR {_NORM.format('b')} = '' THEN 'empty'
  WHEN {_NORM.format('a')} = {_NORM.format('b')} THEN 'identical' WHEN {O.alpha('a')} < 0.70 OR {O.code('a')} >= 0.5 OR {O.alpha('b')} < 0.70 OR {O.code('b')} >= 0.5 THEN 'code' ELSE 'primary' END AS reason FROM lp)
SELECT lang, reason, count(*) AS n FROM r GROUP BY lang, reason""")
def population_filter(spark, d):
    """Pairs by the first reason that keeps them out of the primary population: status, type, empty, identical once white
    space is squeezed, code. Labels and languages stand in for status and type."""
    a, b = T.squeeze(F.col("a")), T.squeeze(F.col("b"))
    reason = F.when(F.col("quality") != 1, "status").when(~F.col("lang").isin("en", "fr"), "type").when((a == "") | (b == ""), "empty").when(a == b, "identical")
    reason = reason.when(T.code_primary(F.col("a"), F.col("b")), "code").otherwise("primary")
    return labelled_pairs(spark, d).groupBy("lang", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT CASE event_type WHEN 'purchase' THEN 'preserve' WHEN 'signup' THEN 'preserve' WHEN 'error' THEN 'break' END AS label, count(*) AS n, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS n_skipped FROM events GROUP BY 1")
def label_mapping(spark, d):
    """Source labels to two classes; those without a class are skipped and counted, unknown ones fail."""
    label = T.closed_map(F.col("event_type"), {"purchase": "preserve", "signup": "preserve", "error": "break", "click": None, "view": None})
    return table(spark, d, "events").withColumn("label", label).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isin("click", "view")).alias("n_skipped"))


@query("SELECT source, count(*) AS n FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(source), '7') GROUP BY source")
def config_filter(spark, d):
    """Sources whose name contains any of a list of parts, whatever the case."""
    parts = F.array(F.lit("SRC1"), F.lit("7"))
    return table(spark, d, "documents").where(F.exists(parts, lambda p: F.lower("source").contains(F.lower(p)))).groupBy("source").agg(F.count("*").alias("n"))


@query(f"""WITH {O.DP}, t AS (SELECT lang, len({O.ws('a')}) AS x, len({O.ws('b')}) AS y FROM dp), w AS (SELECT lang, win, x, y FROM t, unnest([128, 512, 2048]) u(win)),
g AS (SELECT lang, win, count(*) AS n, avg((greatest(x, y) > win)::INT) AS share, median(x) AS typical, sum(((x > win) <> (greatest(x, y) > win))::INT)::BIGINT AS mismatches FROM w GROUP BY lang, win)
SELECT lang, win AS cap, n, round(share, 9) AS truncated, typical::DOUBLE AS typical, mismatches, CASE WHEN share >= 0.5 THEN 'excluded' WHEN share > 0 THEN 'boundary' ELSE 'inside' END AS regime FROM g""")
def truncation_regimes(spark, d):
    """Share of pairs with a member beyond a window of words, the regime that follows, the median length, and the pairs for
    which a flag of the first member alone would be wrong."""
    p = doc_pairs(spark, d).select("lang", T.ws_count(F.col("a")).alias("x"), T.ws_count(F.col("b")).alias("y"), F.explode(F.array(*map(F.lit, (128, 512, 2048)))).alias("cap"))
    beyond = F.greatest("x", "y") > F.col("cap")
    g = p.groupBy("lang", "cap").agg(F.count("*").alias("n"), F.avg(beyond.cast("int")).alias("share"), F.median("x").alias("typical"), F.count_if((F.col("x") > F.col("cap")) != beyond).alias("mismatches"))
    regime = F.when(F.col("share") >= 0.5, "excluded").when(F.col("share") > 0, "boundary").otherwise("inside")
    return g.select("lang", "cap", "n", F.round("share", 9).alias("truncated"), "typical", "mismatches", regime.alias("regime"))


@query(f"WITH {O.LP}, s AS (SELECT * FROM lp WHERE jaccard >= 0.05), {O.ranked('s', 'jaccard', 'quality = 1')} SELECT n_pos, n_neg, u2, (SELECT count(*) FROM lp) AS n_all FROM r")
def common_support(spark, d):
    """Ranks among the pairs above a floor of overlap, beside the number of all pairs."""
    p = labelled_pairs(spark, d)
    n = p.agg(F.count("*").alias("n_all"))
    return scoring.rank_counts(p.where("jaccard >= 0.05"), [], "jaccard", F.col("quality") == 1).withColumn("u2", F.col("u2").cast("long")).crossJoin(F.broadcast(n))


@query("SELECT event_id, round(value, 1) AS half_up, round_even(value, 1) AS half_even, CASE WHEN value > 50 THEN round(value, 4) END AS guarded FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN floor(value) + 0.25 WHEN event_id % 7 = 1 THEN floor(value) + 0.75 ELSE value END AS value FROM events)")
def rounding_forms(spark, d):
    """Half up, half to even, and NaN as null; every seventh value is a tie."""
    k = F.col("event_id") % 7
    v = F.when(k == 0, F.floor("value") + 0.25).when(k == 1, F.floor("value") + 0.75).otherwise(F.col("value"))
    nan = F.when(v > 50, v).otherwise(F.lit(float("nan")))
    return table(spark, d, "events").select("event_id", F.round(v, 1).alias("half_up"), F.bround(v, 1).alias("half_even"), F.when(F.isnan(nan), F.lit(None)).otherwise(F.round(nan, 4)).alias("guarded"))


# texts

_WORDS = ["of the", "the", "of"]
_LINT = {"shouting": ("[A-Z]{4,}", "error"), "doubled": (r"\b(the the|of of|and and)\b", "error"), "spaced": (r" ,| \.", "warning")}
_PIECE = r"[A-Za-z]{1,4}|[0-9]|[^\sA-Za-z0-9]"
_HEAD = r"^[A-Z]\S*( \S+){0,3}\.?$"


@query(r"""WITH t AS (SELECT lower(trim(text)) AS t FROM conversations UNION ALL SELECT unnest(['Different', ' same ', 'the same, not different', 'UNJUDGEABLE!', '?']) AS t),
v AS (SELECT lower(trim(t)) AS t FROM t) SELECT CASE WHEN t IN ('different', 'same', 'unjudgeable') THEN t WHEN contains(t, 'different') THEN 'different' WHEN contains(t, 'same') THEN 'same' WHEN contains(t, 'unjudgeable') THEN 'unjudgeable' ELSE 'unparseable' END AS verdict, count(*) AS n FROM v GROUP BY 1""")
def verdict_parse(spark, d):
    """Answers as verdicts; turns of conversations and five made answers stand in for an annotator's."""
    made = spark.createDataFrame([(x,) for x in ("Different", " same ", "the same, not different", "UNJUDGEABLE!", "?")], "t string")
    t = table(spark, d, "conversations").select(F.lower(F.trim("text")).alias("t")).unionByName(made)
    return t.groupBy(T.verdict(F.col("t")).alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 80) AS slug FROM pages")
def page_slugs(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query(f"""WITH f AS (SELECT item_id, {O.FOLD.format('text')} AS t FROM benchmark), s AS (SELECT *, {O.sents('t')} AS ss FROM f)
SELECT item_id, md5(left(t, 250)) AS first, md5(coalesce(ss[len(ss) // 2 + 1], t)) AS middle, md5(right(t, 250)) AS last, len(ss)::INT AS n_sentences FROM s""")
def probe_table(spark, d):
    t = T.fold(F.col("text"))
    p = table(spark, d, "benchmark").select("item_id", T.probes(t).alias("p"), F.size(T.sentences(t)).alias("n_sentences"))
    return p.select("item_id", F.md5(F.col("p")[0]).alias("first"), F.md5(F.col("p")[1]).alias("middle"), F.md5(F.col("p")[2]).alias("last"), "n_sentences")


@query(r"""WITH a AS (SELECT doc_id, lang, text AS t FROM documents), b AS (SELECT *, len(regexp_extract_all(t, '\bof\s+the\b')) AS n1, regexp_replace(t, '\bof\s+the\b', ' ', 'g') AS u FROM a), c AS (SELECT *, len(regexp_extract_all(u, '\bthe\b')) AS n2, regexp_replace(u, '\bthe\b', ' ', 'g') AS v FROM b)
SELECT lang, sum(n1)::BIGINT AS of_the, sum(n2)::BIGINT AS the, sum(len(regexp_extract_all(v, '\bof\b')))::BIGINT AS "of" FROM c GROUP BY lang""")
def masked_keywords(spark, d):
    """Words counted in an order in which longer ones come first and hide what they contain."""
    m = table(spark, d, "documents").select("lang", T.masked_keywords(F.col("text"), _WORDS).alias("m"))
    n = lambda w: F.sum(F.coalesce(F.get(F.filter("m", lambda x: x["word"] == w), F.lit(0))["n"], F.lit(0))).alias(w.replace(" ", "_"))
    return m.groupBy("lang").agg(*map(n, _WORDS))


@query(rf"""WITH p AS (SELECT doc_id, text, {O.ws('text')} AS w FROM documents WHERE len({O.ws('text')}) >= 30), q AS (SELECT *, array_to_string(w[11:22], ' ') AS part FROM p),
n AS (SELECT doc_id, part, text FROM q) SELECT doc_id, length(regexp_extract(text, '^(?s)(.*?)' || array_to_string(list_transform(string_split(part, ' '), lambda x: regexp_escape(x)), '\s+'), 1)) + 1 AS place FROM n""")
def flexible_find(spark, d):
    """Where twelve words of a text stand, whatever white space lies between them."""
    w = T.ws_tokens(F.col("text"))
    docs = table(spark, d, "documents").where(F.size(w) >= 30).withColumn("part", F.array_join(F.slice(w, 11, 12), " "))
    return docs.select("doc_id", T.flexible_find(F.col("text"), F.col("part")).cast("long").alias("place"))


@query(rf"""WITH l AS (SELECT doc_id, length(text) AS n, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, n, unnest(range(1, len(ls) + 1)) AS i, ls FROM l),
o AS (SELECT doc_id, n, i, ls[i] AS line, sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(ls[i]) - 1 AS place FROM e), m AS (SELECT *, n // 2 AS lo, n // 2 + 40 AS hi, regexp_matches(line, '{_HEAD}') AS head FROM o)
SELECT doc_id, coalesce(max(place) FILTER (WHERE head AND place <= lo), 0)::INT AS start, coalesce(min(place) FILTER (WHERE head AND place >= hi), any_value(n))::INT AS "end" FROM m GROUP BY doc_id""")
def section_spans(spark, d):
    """The section around the middle of each document; short lines with a capital stand in for headings."""
    mid = F.floor(F.length("text") / 2).cast("int")
    return table(spark, d, "documents").select("doc_id", T.section_span(F.col("text"), mid, mid + 40, _HEAD).alias("s")).select("doc_id", "s.start", "s.end")


@query("""WITH v AS (SELECT url, unnest(list_distinct([url, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')])) AS spelling FROM pages)
SELECT spelling, count(*) AS n, min(url) AS title FROM v GROUP BY spelling""")
def title_spellings(spark, d):
    v = table(spark, d, "pages").select("url", F.explode(T.spellings(F.col("url"))).alias("spelling"))
    return v.groupBy("spelling").agg(F.count("*").alias("n"), F.min("url").alias("title"))


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS rule, '{s}' AS severity, sum(len(regexp_extract_all(regexp_replace(text, '`[^`]*`', ' ', 'g'), '{p}')))::BIGINT AS n, count(*) FILTER (WHERE regexp_matches(regexp_replace(text, '`[^`]*`', ' ', 'g'), '{p}')) AS n_docs FROM documents) WHERE n > 0" for k, (p, s) in _LINT.items()))
def prose_lint(spark, d):
    """Findings of a table of patterns outside of code spans, with their severity."""
    prose = table(spark, d, "documents").select(F.regexp_replace("text", "`[^`]*`", " ").alias("t"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(s).alias("severity"), F.regexp_count("t", F.lit(p)).alias("n")) for k, (p, s) in _LINT.items()])
    hits = prose.select(F.explode(rules).alias("x")).select("x.*").where("n > 0")
    return hits.groupBy("rule", "severity").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query(f"""WITH {O.DP}, s AS (SELECT doc_id, {_NORM.format('a')} AS x, {_NORM.format('b')} AS y, {O.EDIT} AS label FROM dp), k AS (SELECT *, least(x, y) AS p, greatest(x, y) AS q FROM s),
g AS (SELECT p, q, count(*) AS n, count(DISTINCT label) AS labels, min(doc_id) AS first_doc FROM k GROUP BY p, q) SELECT count(*) AS n_keys, sum(n)::BIGINT AS n_pairs, sum((n > 1)::INT)::BIGINT AS n_repeated, sum((labels > 1)::INT)::BIGINT AS n_disagree, sum(first_doc)::BIGINT AS id_sum FROM g""")
def unordered_pair_join(spark, d):
    """Pairs looked up by an unordered, squeezed key: repeated keys, and those whose labels don't agree."""
    key = F.md5(F.to_json(T.unordered(F.col("a"), F.col("b"))))
    p = doc_pairs(spark, d).select("doc_id", key.alias("key"), T.edit_class(F.col("a"), F.col("b")).alias("label"))
    g = p.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.min("doc_id").alias("first_doc"))
    return g.agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_pairs"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col("labels") > 1).alias("n_disagree"), F.sum("first_doc").alias("id_sum"))


@query(rf"""WITH t AS (SELECT lang, len(regexp_extract_all(text, '{_PIECE}')) AS pieces, len({O.ws('text')}) AS n FROM documents), r AS (SELECT lang, pieces::DOUBLE / n AS r, pieces, n FROM t WHERE n > 0)
SELECT lang, count(*) AS n_docs, round(sum(pieces)::DOUBLE / sum(n), 6) AS ratio, round(median(r), 6) AS typical, round(quantile_cont(r, 0.9), 6) AS p90 FROM r GROUP BY lang""")
def token_ratio(spark, d):
    """Subword tokens for each word; runs of up to four letters, single digits and signs stand in for a tokenizer's."""
    t = table(spark, d, "documents").select("lang", F.regexp_count("text", F.lit(_PIECE)).alias("pieces"), T.ws_count(F.col("text")).alias("n")).where("n > 0").withColumn("r", F.col("pieces") / F.col("n"))
    return t.groupBy("lang").agg(F.count("*").alias("n_docs"), F.round(F.sum("pieces") / F.sum("n"), 6).alias("ratio"), F.round(F.median("r"), 6).alias("typical"), F.round(F.percentile("r", 0.9), 6).alias("p90"))


# joins


@query("""WITH x AS (SELECT label, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), m AS (SELECT dim, avg(x) AS mean FROM x GROUP BY dim)
SELECT label, dim::INT AS dim, count(*) AS n, round(avg(x - mean), 9) AS shift FROM x JOIN m USING (dim) GROUP BY label, dim""")
def positional_join(spark, d):
    """Array elements beside a value of the same place: how far each label's mean lies from the overall one."""
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    m = x.groupBy("dim").agg(F.avg("x").alias("mean"))
    return x.join(m, "dim").groupBy("label", "dim").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x") - F.col("mean")), 9).alias("shift"))


@query("""WITH e AS (SELECT DISTINCT doc_id AS old, doc_id + 1 + doc_id % 3 AS new FROM documents), j AS (SELECT e.*, a.doc_id IS NOT NULL AS has_old, b.doc_id IS NOT NULL AS has_new FROM e LEFT JOIN labels a ON a.doc_id = old LEFT JOIN labels b ON b.doc_id = new)
SELECT count(*) AS n_edges, sum((has_old AND has_new)::INT)::BIGINT AS n_both, sum((NOT has_old)::INT)::BIGINT AS n_no_old, sum((has_old AND NOT has_new)::INT)::BIGINT AS n_no_new FROM j""")
def edge_lookup(spark, d):
    """Edges of which both ends are known, and the misses on either side."""
    e = table(spark, d, "documents").select(F.col("doc_id").alias("old"), (F.col("doc_id") + 1 + F.col("doc_id") % 3).alias("new")).distinct()
    known = table(spark, d, "labels").select("doc_id").distinct()
    j = e.join(known.select(F.col("doc_id").alias("old"), F.lit(True).alias("has_old")), "old", "left").join(known.select(F.col("doc_id").alias("new"), F.lit(True).alias("has_new")), "new", "left")
    has_old, has_new = F.coalesce("has_old", F.lit(False)), F.coalesce("has_new", F.lit(False))
    return j.agg(F.count("*").alias("n_edges"), F.count_if(has_old & has_new).alias("n_both"), F.count_if(~has_old).alias("n_no_old"), F.count_if(has_old & ~has_new).alias("n_no_new"))


@query(f"""WITH k AS (SELECT doc_id, source, md5({O.FOLD.format('text')}) AS k FROM documents), f AS (SELECT k, min(doc_id) AS head, count(*) AS n, count(DISTINCT source) AS sources FROM k WHERE source <> 'src0' GROUP BY k)
SELECT CASE WHEN f.k IS NULL THEN 'none' WHEN sources > 1 THEN 'ambiguous' ELSE 'exact' END AS tier, count(*) AS n, count(head) AS n_heads, sum(head)::BIGINT AS head_sum FROM (SELECT * FROM k WHERE source = 'src0') q LEFT JOIN f USING (k) GROUP BY 1""")
def exact_text_tiers(spark, d):
    """Texts of one source looked up in the others by their folded text: found in one source, in several, nowhere."""
    k = table(spark, d, "documents").select("doc_id", "source", F.md5(T.fold(F.col("text"))).alias("k"))
    f = k.where("source <> 'src0'").groupBy("k").agg(F.min("doc_id").alias("head"), F.count_distinct("source").alias("sources"))
    j = k.where("source = 'src0'").join(f, "k", "left")
    tier = F.when(F.col("sources").isNull(), "none").when(F.col("sources") > 1, "ambiguous").otherwise("exact")
    return j.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.count("head").alias("n_heads"), F.sum("head").alias("head_sum"))


@query("SELECT lang, count(*) AS n, sum((doc_id NOT IN (SELECT doc_id FROM labels))::INT)::BIGINT AS n_todo, sum((doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))::INT)::BIGINT AS n_needed FROM documents GROUP BY lang")
def resume_and_need(spark, d):
    """What a resumed run still has to do (anti join) and what a later step needs (semi join)."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.lit("v1").alias("config"))
    done = table(spark, d, "labels").select("doc_id", F.lit("v1").alias("config"))
    todo = integrity.resume(docs, done, "doc_id", "config").groupBy("lang").agg(F.count("*").alias("n_todo"))
    need = docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n_needed"))
    every = docs.groupBy("lang").agg(F.count("*").alias("n"))
    return every.join(todo, "lang", "left").join(need, "lang", "left").select("lang", "n", F.coalesce("n_todo", F.lit(0)).alias("n_todo"), F.coalesce("n_needed", F.lit(0)).alias("n_needed"))


@query(f"""WITH s AS (SELECT DISTINCT {O.FOLD.format('s[i]')} AS k, doc_id % 2 AS half FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {O.sents(O.SQUEEZE.format('text'))} AS s FROM documents))),
g AS (SELECT k, bool_or(half = 0) AS a, bool_or(half = 1) AS b FROM s GROUP BY k), t AS (SELECT DISTINCT {O.FOLD.format('s[i]')} AS k FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT {O.sents(O.SQUEEZE.format('text'))} AS s FROM benchmark)))
SELECT coalesce(a, false) AS in_even, coalesce(b, false) AS in_odd, count(*) AS n FROM t LEFT JOIN g USING (k) GROUP BY 1, 2""")
def presence_in_halves(spark, d):
    """Sentences of the benchmark in each of two dumps (documents of even and odd ids): both, one, none."""
    cut = lambda df, *more: df.select(*more, F.explode(T.flat_sentences(F.col("text"))).alias("s")).select(*more, F.md5(T.fold(F.col("s"))).alias("k")).distinct()
    docs = cut(table(spark, d, "documents").withColumn("half", F.col("doc_id") % 2), "half")
    seen = docs.groupBy("k").agg(F.bool_or(F.col("half") == 0).alias("a"), F.bool_or(F.col("half") == 1).alias("b"))
    j = cut(table(spark, d, "benchmark")).join(seen, "k", "left")
    return j.groupBy(F.coalesce("a", F.lit(False)).alias("in_even"), F.coalesce("b", F.lit(False)).alias("in_odd")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL) SELECT user_id, round(max(CASE WHEN event_type = 'view' THEN v END), 6) AS before, round(max(CASE WHEN event_type = 'purchase' THEN v END), 6) AS after, count(*) AS n_roles FROM m GROUP BY user_id HAVING count(*) FILTER (WHERE event_type IN ('view', 'purchase')) = 2""")
def role_regroup(spark, d):
    """Rows of two roles brought side by side; groups that lack one go. Values of a role are averaged over its draws first."""
    m = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    at = lambda role: F.max(F.when(F.col("event_type") == role, F.col("v")))
    g = m.groupBy("user_id").agg(at("view").alias("x"), at("purchase").alias("y"), F.count("*").alias("n_roles")).where("x IS NOT NULL AND y IS NOT NULL")
    return g.select("user_id", F.round("x", 6).alias("before"), F.round("y", 6).alias("after"), "n_roles")


# tallies


@query("SELECT lang || '|' || quality || '|' || toxic AS stratum, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def strata_totals(spark, d):
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return l.groupBy(F.concat_ws("|", "lang", "quality", "toxic").alias("stratum")).agg(F.count("*").alias("n"))


def _spans(n: int, t: str) -> str:
    return f"list_distinct(list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n} - 1], ' ')))"


def _overlap(n: int) -> str:
    return f"(SELECT CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END FROM (SELECT {_spans(n, 'ta')} AS x, {_spans(n, 'tb')} AS y))"


@query(f"""WITH {O.DP.split('dp AS')[0].rstrip().rstrip(',')}, l AS MATERIALIZED (SELECT lang, regexp_extract_all(lower(a), '[a-z0-9]+') AS ta, regexp_extract_all(lower(b), '[a-z0-9]+') AS tb FROM dp0 JOIN labels USING (doc_id) WHERE b IS NOT NULL), g AS (SELECT lang, {_overlap(1)} AS g1, {_overlap(2)} AS g2, {_overlap(3)} AS g3 FROM l), m AS (SELECT lang, avg(g1) AS g1, avg(g2) AS g2, avg(g3) AS g3 FROM g GROUP BY lang)
SELECT round(avg(g1), 6) AS g1, round(avg(g2), 6) AS g2, round(avg(g3), 6) AS g3, avg(g1) >= avg(g2) AND avg(g2) >= avg(g3) AND avg(g1) - avg(g3) >= 0.10 AS decays FROM m""")
def granularity_means(spark, d):
    """Overlap of whole texts at three granularities, words and runs of two and three, averaged within languages and over them; whether
    it falls from one to the next."""

    def runs(c: str, n: int):
        # a list of one: the tokens are found once, not for each of their runs
        return F.flatten(F.transform(F.array(T.tokens(F.col(c))), lambda t: F.array_distinct(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: i <= F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")))))

    g = labelled_pairs(spark, d).groupBy("lang").agg(*[F.avg(T.set_jaccard(runs("a", n), runs("b", n))).alias(f"g{n}") for n in (1, 2, 3)])
    m = g.agg(F.avg("g1").alias("g1"), F.avg("g2").alias("g2"), F.avg("g3").alias("g3"))
    falls = (F.col("g1") >= F.col("g2")) & (F.col("g2") >= F.col("g3")) & (F.col("g1") - F.col("g3") >= 0.10)
    return m.select(*[F.round(c, 6).alias(c) for c in ("g1", "g2", "g3")], falls.alias("decays"))


@query("""WITH m AS (SELECT lang = 'en' AS en, source, median(n_chars) AS m FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY en ORDER BY m DESC, source) AS r FROM m), t AS (SELECT en, list(source ORDER BY source) AS top FROM r WHERE r <= 3 GROUP BY en)
SELECT array_to_string(a.top, ',') AS top_en, array_to_string(b.top, ',') AS top_other, a.top = b.top AS same_set FROM (SELECT top FROM t WHERE en) a, (SELECT top FROM t WHERE NOT en) b""")
def top_classes(spark, d):
    """The three sources with the longest median text, among English documents and the others; whether the sets agree."""
    m = table(spark, d, "documents").groupBy((F.col("lang") == "en").alias("en"), "source").agg(F.median("n_chars").alias("m"))
    r = m.withColumn("r", F.row_number().over(Window.partitionBy("en").orderBy(F.desc("m"), "source"))).where("r <= 3")
    top = r.agg(F.array_sort(F.collect_set(F.when(F.col("en"), F.col("source")))).alias("x"), F.array_sort(F.collect_set(F.when(~F.col("en"), F.col("source")))).alias("y"))
    return top.select(F.array_join("x", ",").alias("top_en"), F.array_join("y", ",").alias("top_other"), (F.col("x") == F.col("y")).alias("same_set"))


@query(f"WITH {O.LP}, x AS (SELECT {O.EDIT} AS label, CASE WHEN quality = 1 THEN 'keyword' ELSE 'other' END AS reference FROM lp) SELECT label, count(*) AS total, sum((label = reference)::INT)::BIGINT AS matched, round(avg((label = reference)::INT), 9) AS precision FROM x GROUP BY label")
def regex_precision(spark, d):
    """How often the class by patterns is the reference's."""
    x = labelled_pairs(spark, d).select(T.edit_class(F.col("a"), F.col("b")).alias("label"), F.when(F.col("quality") == 1, "keyword").otherwise("other").alias("reference"))
    hit = F.col("label") == F.col("reference")
    return x.groupBy("label").agg(F.count("*").alias("total"), F.count_if(hit).alias("matched"), F.round(F.avg(hit.cast("int")), 9).alias("precision"))


@query("""WITH p AS (SELECT lang, count(*) FILTER (WHERE quality = 0) AS n1, count(*) FILTER (WHERE quality = 1) AS n0, avg(CASE WHEN quality = 0 THEN toxic END) AS p1, avg(CASE WHEN quality = 1 THEN toxic END) AS p0 FROM labels JOIN documents USING (doc_id) GROUP BY lang),
s AS (SELECT *, (p1 - p0 + 1) / 2 AS a, sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) / 2 AS se FROM p WHERE n1 > 0 AND n0 > 0) SELECT lang, n1, n0, round(a, 9) AS auroc, round(greatest(0, a - 1.96 * se), 9) AS low, round(least(1, a + 1.96 * se), 9) AS high FROM s""")
def one_point_roc(spark, d):
    """Area and normal interval of a verdict that is one point of the curve."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    one = F.col("quality") == 0
    p = l.groupBy("lang").agg(F.count_if(one).alias("n1"), F.count_if(F.col("quality") == 1).alias("n0"), F.avg(F.when(one, F.col("toxic"))).alias("p1"), F.avg(F.when(F.col("quality") == 1, F.col("toxic"))).alias("p0")).where("n1 > 0 AND n0 > 0")
    a = (F.col("p1") - F.col("p0") + 1) / 2
    se = F.sqrt(F.col("p1") * (1 - F.col("p1")) / F.col("n1") + F.col("p0") * (1 - F.col("p0")) / F.col("n0")) / 2
    return p.select("lang", "n1", "n0", F.round(a, 9).alias("auroc"), F.round(F.greatest(F.lit(0.0), a - 1.96 * se), 9).alias("low"), F.round(F.least(F.lit(1.0), a + 1.96 * se), 9).alias("high"))


@query(f"""WITH {O.LP}, jc AS (SELECT jaccard AS j, count(*) AS k FROM lp GROUP BY jaccard), ju AS (SELECT *, sum(k) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING) AS upto, sum(k) OVER () AS n FROM jc WHERE j IS NOT NULL),
o1 AS (SELECT count(*)::DOUBLE AS n, avg(jaccard) AS m, median(jaccard) AS d, max(jaccard) - min(jaccard) AS r FROM lp),
t1 AS (SELECT (SELECT sum(k) FROM jc)::DOUBLE AS n, sum(k * j) / sum(k) AS m, (max(CASE WHEN upto - k <= (n - 1) // 2 AND (n - 1) // 2 < upto THEN j END) + max(CASE WHEN upto - k <= n // 2 AND n // 2 < upto THEN j END)) / 2 AS d, max(j) - min(j) AS r FROM ju),
pm AS (SELECT unnest(['n_pairs', 'mean_jaccard', 'median_jaccard', 'range_jaccard']) AS metric, unnest([o1.n, o1.m, o1.d, o1.r]) AS x, unnest([t1.n, t1.m, t1.d, t1.r]) AS y FROM o1, t1),
m AS (SELECT lang, count(*) AS n, count(n_chars) AS k, sum(length(text))::DOUBLE AS s, sum(n_chars)::DOUBLE AS ss, max(length(text)) AS m, max(n_chars) AS mm FROM documents GROUP BY lang),
l AS (SELECT lang, 'rows' AS metric, n::DOUBLE AS ours, k::DOUBLE AS theirs FROM m UNION ALL SELECT lang, 'characters', s, ss FROM m UNION ALL SELECT lang, 'longest', m::DOUBLE, mm::DOUBLE FROM m)
SELECT lang, metric, ours, theirs, abs(ours - theirs) <= 0.5 AS agrees FROM l UNION ALL SELECT 'all pairs', metric, round(x, 6), round(y, 6), coalesce(abs(x - y) <= 1e-9, false) FROM pm""")
def two_source_check(spark, d):
    """What the texts show against what the table states of them (``n_chars``), language by language, and metrics of the labelled pairs from the
    pairs against those from counts by value, each within a tolerance."""
    p = labelled_pairs(spark, d).select("jaccard").persist()  # a number for each pair
    ours = p.agg(F.count("*").alias("n"), F.avg("jaccard").alias("m"), F.median("jaccard").alias("d"), (F.max("jaccard") - F.min("jaccard")).alias("r"))
    counts, known = p.groupBy("jaccard").agg(F.count("*").alias("k")), F.col("jaccard").isNotNull()
    mean = F.sum(F.col("k") * F.col("jaccard")) / F.sum(F.when(known, F.col("k")))
    theirs = counts.agg(F.sum("k").alias("nn"), mean.alias("mm"), F.expr("percentile(jaccard, 0.5, k)").alias("dd"), (F.max("jaccard") - F.min("jaccard")).alias("rr"))
    both = ours.crossJoin(theirs).withColumn("lang", F.lit("all pairs"))
    each = compared(both, ["lang"], {"n_pairs": ("n", "nn"), "mean_jaccard": ("m", "mm"), "median_jaccard": ("d", "dd"), "range_jaccard": ("r", "rr")}, 1e-9)
    each = each.select("lang", "metric", F.round("ours", 6).alias("ours"), F.round("theirs", 6).alias("theirs"), "agrees")
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count("n_chars").alias("k"), F.sum(F.length("text")).alias("s"), F.sum("n_chars").alias("ss"), F.max(F.length("text")).alias("m"), F.max("n_chars").alias("mm"))
    return compared(g, ["lang"], {"rows": ("n", "k"), "characters": ("s", "ss"), "longest": ("m", "mm")}, 0.5).unionByName(each)


def compared(df: DataFrame, by: list[str], metrics: dict[str, tuple[str, str]], tolerance: float) -> DataFrame:
    """``by, metric, ours, theirs, agrees``: two columns for each metric; a missing number agrees with nothing."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(a).cast("double").alias("ours"), F.col(b).cast("double").alias("theirs")) for k, (a, b) in metrics.items()])
    r = df.select(*by, F.explode(each).alias("x")).select(*by, "x.*")
    return r.withColumn("agrees", F.coalesce(F.abs(F.col("ours") - F.col("theirs")) <= tolerance, F.lit(False)))


# ordered computations


@query(f"""WITH {O.DS}, st AS (SELECT doc_id, pos, list_filter({O.TOK.format('sent')}, lambda x: NOT list_contains({O.STOP}, x)) AS t FROM ds WHERE length(sent) BETWEEN 30 AND 600), w AS (SELECT doc_id, pos, unnest(t) AS w FROM st),
nr AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, count(*) AS n FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 AND a.w = b.w GROUP BY ALL HAVING count(*) >= 2),
sc AS (SELECT nr.doc_id, i, j, round(n::DOUBLE / (len(x.t) + len(y.t) - n), 9) AS jac FROM nr JOIN st x ON x.doc_id = nr.doc_id AND x.pos = i JOIN st y ON y.doc_id = nr.doc_id + 1 AND y.pos = j),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY jac DESC, j) AS r FROM sc) SELECT doc_id, i::INT AS pos, max(CASE WHEN r = 1 THEN jac END) AS best, max(CASE WHEN r = 2 THEN jac END) AS second, coalesce(max(CASE WHEN r = 1 THEN jac END) - max(CASE WHEN r = 2 THEN jac END) >= 0.1, true) AS clear FROM r WHERE r <= 2 GROUP BY doc_id, i""")
def second_best(spark, d):
    """Best and second-best match of each sentence in the next document, and whether the best is clearly ahead."""
    r = next_matches(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("a", "i").orderBy(F.desc("jac"), "j"))).where("r <= 2")
    g = r.groupBy(F.col("a").alias("doc_id"), F.col("i").alias("pos")).agg(F.max(F.when(F.col("r") == 1, F.col("jac"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("jac"))).alias("second"))
    return g.select("*", F.coalesce(F.col("best") - F.col("second") >= 0.1, F.lit(True)).alias("clear"))


@query(f"""WITH {O.DS}, c AS (SELECT doc_id, pos, len({O.ws('sent')}) AS n FROM ds), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM c)
SELECT doc_id, count(*) FILTER (WHERE upto <= 50) AS n_whole, coalesce(max(CASE WHEN upto <= 50 THEN upto END), 0)::BIGINT AS used, count(*) FILTER (WHERE upto > 50 AND upto - n < 50) AS n_cut FROM r GROUP BY doc_id""")
def running_budget(spark, d):
    """Whole sentences that a budget of 50 words pays for, and whether the next one is cut."""
    s = sentences(spark, d).select("doc_id", "pos", T.ws_count(F.col("sent")).alias("n"))
    r = s.withColumn("upto", F.sum("n").over(Window.partitionBy("doc_id").orderBy("pos")))
    fits = F.col("upto") <= 50
    return r.groupBy("doc_id").agg(F.count_if(fits).alias("n_whole"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("used"), F.count_if(~fits & (F.col("upto") - F.col("n") < 50)).alias("n_cut"))


@query("""WITH b AS (SELECT lang, floor(log2(greatest(n_chars, 1)))::INT AS bin, avg(toxic) AS y, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), l AS (SELECT *, lag(y) OVER w AS before, n < 10 AS thin, lag(n < 10) OVER w AS thin_before FROM b WINDOW w AS (PARTITION BY lang ORDER BY bin))
SELECT lang, bin, n, round(y, 9) AS y, coalesce(y > before, false) AS rises, sum((thin <> coalesce(thin_before, thin))::INT) OVER (PARTITION BY lang ORDER BY bin)::INT AS piece, thin <> coalesce(thin_before, thin) AS carries, CASE WHEN thin <> coalesce(thin_before, thin) THEN round(before, 9) END AS carried FROM l""")
def bin_curve(spark, d):
    """A curve over bins of length: bins that rise above the one before, and the pieces between changes of regime (bins of fewer
    than ten rows); a piece that begins with a change carries the last point before it."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    b = l.groupBy("lang", F.floor(F.log2(F.greatest("n_chars", F.lit(1)).cast("double"))).cast("int").alias("bin")).agg(F.avg("toxic").alias("y"), F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy("bin")
    thin = F.col("n") < 10
    b = b.withColumn("change", thin != F.coalesce(F.lag(thin).over(w), thin)).withColumn("rises", F.coalesce(F.col("y") > F.lag("y").over(w), F.lit(False)))
    return b.select("lang", "bin", "n", F.round("y", 9).alias("y"), "rises", F.sum(F.col("change").cast("int")).over(w).cast("int").alias("piece"), F.col("change").alias("carries"), F.when(F.col("change"), F.round(F.lag("y").over(w), 9)).alias("carried"))


@query("""WITH o AS (SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS hour FROM events), n AS (SELECT *, lead(hour) OVER (PARTITION BY user_id ORDER BY hour) AS next FROM o) SELECT e.event_id, n.hour, n.next FROM events e JOIN n ON n.user_id = e.user_id AND n.hour = epoch_us(e.ts) // 3600000000""")
def next_offset(spark, d):
    """The next distinct offset (hour) of each row's own: rows that share one share the next."""
    e = table(spark, d, "events").withColumn("hour", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("long"))
    n = e.select("user_id", "hour").distinct().withColumn("next", F.lead("hour").over(Window.partitionBy("user_id").orderBy("hour")))
    return e.join(n, ["user_id", "hour"]).select("event_id", "hour", "next")


@query("SELECT doc_id, lang || '-' || lpad((row_number() OVER (PARTITION BY lang ORDER BY doc_id))::VARCHAR, 5, '0') AS name FROM documents")
def label_ordinals(spark, d):
    """Names that count up within each label."""
    n = (F.col("index") + 1).cast("string")
    return order.indexed(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang").select("doc_id", F.concat("lang", F.lit("-"), F.lpad(n, 5, "0")).alias("name"))


# order, samples


@query("""SELECT doc_id, walk::INT AS walk FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars > 2000, lang, doc_id) AS walk FROM documents WHERE n_chars >= 600) WHERE walk <= 25""")
def ordered_walk(spark, d):
    """The first 25 that qualify, in an order that puts light ones first."""
    heavy = (F.col("n_chars") > 2000).alias("heavy")
    first = table(spark, d, "documents").where("n_chars >= 600").select("doc_id", "lang", heavy).orderBy("heavy", "lang", "doc_id").limit(25)
    return first.select("doc_id", F.row_number().over(Window.orderBy("heavy", "lang", "doc_id")).alias("walk"))


@query("""WITH t AS (SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 1 ELSE 2 END AS tier, md5('20260805|' || doc_id) AS h FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tier, h, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS pool FROM t)
SELECT lang, doc_id, tier::INT AS tier, r::INT AS r, pool FROM r WHERE r <= 15""")
def topped_up_sample(spark, d):
    """Fifteen of each language from the preferred tier, topped up from the second; the pool's size goes along."""
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    t = t.select("lang", "doc_id", F.when(F.col("toxic") == 1, 1).otherwise(2).alias("tier"), hashed("doc_id").alias("h"))
    r = t.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("tier", "h", "doc_id"))).where("r <= 15")
    return r.join(t.groupBy("lang").agg(F.count("*").alias("pool")), "lang").select("lang", "doc_id", "tier", "r", "pool")


@query("""SELECT quality, doc_id FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('20260805|' || doc_id), doc_id) AS r FROM labels) WHERE r <= 20""")
def balanced_sample(spark, d):
    """Half and half of two classes."""
    r = F.row_number().over(Window.partitionBy("quality").orderBy(hashed("doc_id"), "doc_id"))
    return table(spark, d, "labels").select("quality", "doc_id", r.alias("r")).where("r <= 20").select("quality", "doc_id")


@query("""WITH b AS (SELECT doc_id, floor(log2(greatest(n_chars, 1)))::INT AS bin FROM documents) SELECT bin, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('20260805|' || bin || '|' || doc_id), doc_id) AS r FROM b) WHERE r <= 8""")
def bin_probes(spark, d):
    """Eight rows of each bin of length."""
    b = table(spark, d, "documents").select("doc_id", F.floor(F.log2(F.greatest("n_chars", F.lit(1)).cast("double"))).cast("int").alias("bin"))
    r = F.row_number().over(Window.partitionBy("bin").orderBy(hashed("bin", "doc_id"), "doc_id"))
    return b.withColumn("r", r).where("r <= 8").select("bin", "doc_id")


@query(f"""WITH {O.DP}, h AS (SELECT doc_id, lang, md5('20260805|' || doc_id) AS h FROM dp) SELECT row_number() OVER (ORDER BY h, doc_id)::INT AS item, doc_id, lang AS native, CASE WHEN substr(h, 32, 1) IN ('1','3','5','7','9','b','d','f') THEN 'b' ELSE 'a' END AS a_is FROM h""")
def sealed_key(spark, d):
    """The key of the blind packet: which pair an item is, its class, and which of its texts came first."""
    return packet(spark, d).select("item", "doc_id", F.col("lang").alias("native"), F.when(F.col("flipped"), "b").otherwise("a").alias("a_is"))


# sets


@query("""WITH s AS (SELECT 'a' AS side, lang, source FROM documents WHERE doc_id % 2 = 0 AND n_chars > 9000 GROUP BY ALL UNION ALL SELECT 'b', lang, source FROM documents WHERE doc_id % 2 = 1 AND n_chars > 9000 GROUP BY ALL)
SELECT lang, source, CASE WHEN count(*) = 2 THEN 'both' WHEN min(side) = 'a' THEN 'only_a' ELSE 'only_b' END AS side FROM s GROUP BY lang, source""")
def config_difference(spark, d):
    """Configurations (language and source of long documents) of two shards: in both, in either alone."""
    c = table(spark, d, "documents").where("n_chars > 9000")
    a, b = (c.where(F.col("doc_id") % 2 == k).select("lang", "source").distinct() for k in (0, 1))
    tag = lambda x, t: x.withColumn("side", F.lit(t))
    return tag(a.exceptAll(b), "only_a").unionByName(tag(b.exceptAll(a), "only_b")).unionByName(tag(a.intersect(b), "both"))


@query(rf"""WITH x AS (SELECT doc_id, quality, (len({O.ws('text')}) >= 20)::INT AS by_rule, toxic FROM labels JOIN documents USING (doc_id)), d AS (SELECT doc_id FROM x WHERE quality <> by_rule), f AS (SELECT doc_id FROM x WHERE toxic = 1)
SELECT (SELECT count(*) FROM d) AS n_disagree, (SELECT count(*) FROM f) AS n_adjudicated, (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM f)) AS n_missing, (SELECT count(*) FROM f WHERE doc_id NOT IN (SELECT doc_id FROM d)) AS n_extra""")
def disagreement_set(spark, d):
    """The rows on which two raters disagree (the label, and a rule on the text's length) beside those that were adjudicated (flagged as
    toxic): how many lack the other."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", (T.ws_count(F.col("text")) >= 20).cast("int").alias("by_rule")), "doc_id")
    return set_check(l.where("quality <> by_rule").select("doc_id"), l.where("toxic = 1").select("doc_id"))


def set_check(differ: DataFrame, final: DataFrame) -> DataFrame:
    """``n_disagree, n_adjudicated, n_missing, n_extra`` of two sets of one column: those of the first that the second lacks, and the other way."""
    key = differ.columns[0]
    sides = differ.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(final.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return sides.agg(F.count_if(F.col("a") == 1).alias("n_disagree"), F.count_if(F.col("b") == 1).alias("n_adjudicated"), F.count_if(F.col("a") > F.col("b")).alias("n_missing"), F.count_if(F.col("b") > F.col("a")).alias("n_extra"))


@query("""WITH c AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars > 8000) SELECT c.doc_id, (l.doc_id IS NOT NULL) AS labelled FROM c LEFT JOIN labels l ON l.doc_id = c.doc_id""")
def candidate_union(spark, d):
    """Candidates of two kinds, each once."""
    l, docs = table(spark, d, "labels"), table(spark, d, "documents")
    c = l.where("toxic = 1").select("doc_id").union(docs.where("n_chars > 8000").select("doc_id")).distinct()
    return c.join(l.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left").select("doc_id", F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("""WITH u AS (SELECT text, min(doc_id) AS head, length(text) AS score FROM documents GROUP BY text) SELECT doc_id, head, score FROM documents JOIN u USING (text)""")
def scored_once(spark, d):
    """Every text is scored once and the score fans back out to its rows; equal texts meet by their digest."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("k"))
    u = docs.groupBy("k").agg(F.min("doc_id").alias("head"), F.first(F.length("text")).cast("long").alias("score"))
    return docs.select("doc_id", "k").join(u, "k").select("doc_id", "head", "score")


@query("SELECT lang, source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def first_of_key(spark, d):
    """One row of each composite key, the first in a stated order."""
    best = F.min(F.struct((-F.col("n_chars")).alias("o"), "doc_id", "n_chars")).alias("x")
    return table(spark, d, "documents").groupBy("lang", "source").agg(best).select("lang", "source", "x.doc_id", "x.n_chars")


# integrity


@query("""WITH f AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS s FROM documents WHERE doc_id % 10 <> 3), m AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 4 THEN sha256(text || '!') ELSE sha256(text) END AS want, doc_id % 10 = 5 AS external FROM documents)
SELECT CASE WHEN external THEN 'EXTERN' WHEN s IS NULL THEN 'MISSING' WHEN s = want THEN 'OK' ELSE 'CORRUPT' END AS status, count(*) AS n FROM m LEFT JOIN f USING (path) GROUP BY 1""")
def manifest_check(spark, d):
    """A manifest in which every tenth entry is missing, another is corrupt and another lies elsewhere."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", (F.col("doc_id") % 10).alias("k"))
    files = docs.where("k <> 3").select("path", F.sha2("text", 256).alias("sha256"))
    manifest = docs.select("path", F.sha2(F.when(F.col("k") == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"), (F.col("k") == 5).alias("external"))
    return integrity.manifest_check(files, manifest).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, sha256('{"chars":' || n_chars || ',"lang":"' || lang || '","source":"' || source || '"}') AS digest FROM documents""")
def config_digest(spark, d):
    """Digest of a configuration as JSON with sorted keys."""
    return table(spark, d, "documents").select("doc_id", integrity.config_digest(F.col("n_chars").alias("chars"), "lang", "source").alias("digest"))


@query("""WITH g AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS members, count(*) AS n FROM conversations WHERE turn <= 1 GROUP BY conv_id) SELECT conv_id, array_to_string(members, ',') AS members, n FROM g WHERE members <> ['assistant', 'user'] OR n <> 2""")
def group_completeness(spark, d):
    """Conversations whose first two turns aren't one of the user's and one of the assistant's."""
    t = table(spark, d, "conversations").where("turn <= 1")
    return integrity.incomplete_groups(t, ["conv_id"], "role", ["user", "assistant"]).select("conv_id", F.array_join("members", ",").alias("members"), "n")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def fan_out_guard(spark, d):
    """Keys that a join on them would multiply."""
    return integrity.fan_out(table(spark, d, "events"), ["user_id", "event_type"])


@query("""WITH t AS (SELECT lang, count(*)::DOUBLE AS n, sum(n_chars)::DOUBLE AS chars FROM documents GROUP BY lang) SELECT lang, 'chars' AS field, chars AS ours, chars + 1 AS theirs FROM t WHERE lang = 'de' UNION ALL SELECT lang, unnest(['n', 'chars']), unnest([n, chars]), NULL FROM t WHERE lang = 'fr'""")
def ledger_tally(spark, d):
    """A stored ledger against its rows: one total is off, one language is absent from it."""
    ours = table(spark, d, "documents").groupBy("lang").agg(F.count("*").cast("double").alias("n"), F.sum("n_chars").cast("double").alias("chars"))
    stored = ours.where("lang <> 'fr'").withColumn("chars", F.when(F.col("lang") == "de", F.col("chars") + 1).otherwise(F.col("chars")))
    return integrity.differences(ours, stored, ["lang"], ["n", "chars"], 1e-9)


@query("""WITH s AS (SELECT vec_id, label, CASE WHEN right(sha256(vec_id::VARCHAR), 1) IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE 0 END AS want FROM embeddings), r AS (SELECT *, want AS shard FROM s UNION ALL SELECT *, 1 FROM s WHERE vec_id % 100 = 0)
SELECT 'wrong shard' AS problem, count(*) AS n FROM r WHERE want <> shard UNION ALL SELECT 'repeated key', count(*) FROM (SELECT vec_id FROM r GROUP BY vec_id HAVING count(*) > 1) UNION ALL SELECT 'further configurations', count(DISTINCT label % 2) - 1 FROM r""")
def shard_assembly(spark, d):
    """Two shards by the parity of a digest, one of which holds strangers."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    parity = F.conv(F.right(F.sha2(F.col("vec_id").cast("string"), 256), F.lit(1)), 16, 10).cast("int") % 2
    shards = {0: e.where(parity == 0), 1: e.where(parity == 1).unionByName(e.where(F.col("vec_id") % 100 == 0))}
    return integrity.assembled(shards, parity, F.col("label") % 2, ["vec_id"])[1]


@query("SELECT lang, count(*) AS printed, count(*) + (lang = 'es')::INT AS frozen, lang <> 'es' AS agrees FROM documents GROUP BY lang")
def printed_table_check(spark, d):
    """Rows of a printed table, parsed from its text, against the numbers it was made from (one of which has changed since)."""
    n = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    printed = n.select(F.concat(F.lit("| "), "lang", F.lit(" | "), F.format_number("n", 0), F.lit(" |")).alias("line"))
    cell = F.split("line", r"\|")
    read = printed.select(F.trim(cell[1]).alias("lang"), F.replace(F.trim(cell[2]), F.lit(","), F.lit("")).cast("long").alias("printed"))
    frozen = n.select("lang", (F.col("n") + F.when(F.col("lang") == "es", 1).otherwise(0)).alias("frozen"))
    return read.join(frozen, "lang").select("lang", "printed", "frozen", (F.col("printed") == F.col("frozen")).alias("agrees"))


# arrays


@query(f"""WITH {O.DP}, s AS (SELECT doc_id, {O.sents('a')} AS x, {O.sents('b')} AS y FROM dp), h AS (SELECT *, least(len(x), len(y)) AS m FROM s),
p AS (SELECT *, coalesce(list_min(list_filter(range(0, m), lambda i: x[i + 1] <> y[i + 1])), m) AS head FROM h), q AS (SELECT *, least(coalesce(list_min(list_filter(range(0, m), lambda i: x[len(x) - i] <> y[len(y) - i])), m), m - head) AS tail FROM p),
o AS (SELECT *, x[head + 1:len(x) - tail] AS ox, y[head + 1:len(y) - tail] AS oy, greatest(head - 1, 0) AS f FROM q WHERE NOT (len(x) = len(y) AND head = m))
SELECT doc_id, md5(array_to_string(CASE WHEN len(ox) > 0 THEN ox ELSE x[f + 1:least(len(x) - tail + 1, len(x))] END, ' ')) AS before, md5(array_to_string(CASE WHEN len(oy) > 0 THEN oy ELSE y[f + 1:least(len(y) - tail + 1, len(y))] END, ' ')) AS after, len(ox) = 1 AND len(oy) = 1 AS single FROM o""")
def changed_spans(spark, d):
    """What differs between two texts' sentences, and whether one sentence stands for one."""
    p = doc_pairs(spark, d).select("doc_id", T.sentences(F.col("a")).alias("x"), T.sentences(F.col("b")).alias("y"))
    p = p.select("doc_id", T.changed_span(F.col("x"), F.col("y")).alias("c")).where("c IS NOT NULL")
    return p.select("doc_id", F.md5("c.before").alias("before"), F.md5("c.after").alias("after"), F.col("c.single").alias("single"))


@query("""WITH m AS (SELECT lang, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL) SELECT lang, '{' || string_agg('"' || quality || '":' || n, ',' ORDER BY quality) || '}' AS report FROM m GROUP BY lang""")
def nested_report(spark, d):
    """Counts as one nested value per language, and as JSON."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    m = l.groupBy("lang", F.col("quality").cast("string").alias("quality")).agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("quality", "n")))
    return m.groupBy("lang").agg(F.to_json(F.map_from_entries(rows)).alias("report"))


@query("""WITH s AS (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w, role FROM conversations), v AS (SELECT conv_id, role, avg(w) AS w FROM s GROUP BY ALL) SELECT role, count(*) AS n, round(avg(w), 6) AS mean, round(quantile_cont(w, 0.9), 6) AS p90, (list_sort(list(w)))[floor(0.9 * count(*))::INT + 1] AS p90_by_index FROM v GROUP BY role""".replace("\\\\", "\\"))
def variant_average(spark, d):
    """Averages within a conversation first, over conversations then; the 90 % point interpolated and by index."""
    s = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.avg(T.ws_count(F.col("text"))).alias("w"))
    at = F.get(F.array_sort(F.collect_list("w")), F.floor(F.count("*") * 0.9).cast("int"))
    return s.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean"), F.round(F.percentile("w", 0.9), 6).alias("p90"), at.alias("p90_by_index"))


@query("SELECT event_id, k::BIGINT AS k, CASE WHEN k >= 50 THEN 'high' ELSE 'low' END AS side FROM (SELECT event_id, (regexp_extract(props, '\"k\": (\\d+)', 1))::BIGINT AS k FROM events)")
def nested_flatten(spark, d):
    """A map in JSON, flattened to a row per key."""
    m = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "k")).where("key = 'k'")
    return m.select("event_id", "k", F.when(F.col("k") >= 50, "high").otherwise("low").alias("side"))


# joins over all documents

#: Sentences with so much of their words in common are matches.
ALIKE = Fraction(1, 2)


@query(f"""WITH {O.DS}, st AS (SELECT list_sort(list_filter({O.TOK.format('sent')}, lambda x: NOT list_contains({O.STOP}, x))) AS t FROM ds WHERE length(sent) BETWEEN 30 AND 600),
se AS (SELECT md5(array_to_string(t, ' ')) AS key, t, len(t) AS size, count(*) AS n FROM st WHERE len(t) > 0 GROUP BY t), w AS (SELECT key, size, unnest(t) AS w FROM se),
p AS (SELECT a.key AS a, b.key AS b, count(*) AS shared, a.size AS na, b.size AS nb FROM w a JOIN w b ON a.w = b.w AND a.key < b.key AND 2 * least(a.size, b.size) >= greatest(a.size, b.size) GROUP BY ALL),
l AS (SELECT a, b, shared::DOUBLE / (na + nb - shared) AS s FROM p WHERE 2 * shared >= na + nb - shared), e AS (SELECT a AS key, s FROM l UNION ALL SELECT b, s FROM l), g AS (SELECT key, count(*) AS n_links, max(s) AS best FROM e GROUP BY key)
SELECT se.key, n, coalesce(n_links, 0) AS n_links, round(best, 9) AS best FROM se LEFT JOIN g USING (key)""")
def sentence_links(spark, d):
    """Each distinct set of a sentence's words (without stop words) in all documents: its sentences, and the sets alike."""
    s = sentences(spark, d).where(F.length("sent").between(30, 600)).select(T.stopped(T.token_set(F.col("sent"))).alias("t"))
    return simjoin.linked(simjoin.distinct_sets(s, "t"), ALIKE).select("key", "n", "n_links", F.round("best", 9).alias("best"))


# routing

#: Pairs of a class that the rules don't know that go to the arbiter, at most.
SAMPLE_CAP = 200


def bottom(df: DataFrame, by: str, hashed: Column, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the lowest hashes. Each task keeps the k lowest of what it holds before anything is shuffled, so
    no group meets as a whole."""
    r = F.row_number().over(Window.partitionBy(by).orderBy("hash", tie))
    return df.withColumn("hash", hashed).withColumn("r", r).where(F.col("r") <= k).drop("hash", "r")


@query(f"""WITH {O.LP}, x AS (SELECT doc_id, quality, nullif({O.EDIT}, 'other') AS rule, CASE WHEN toxic = 1 THEN 'unparseable' WHEN quality = 0 THEN 'scope' WHEN jaccard < 0.05 THEN 'keyword' ELSE 'identifier' END AS bulk FROM lp),
y AS (SELECT *, bulk = 'unparseable' OR coalesce(bulk <> rule, bulk IN ('keyword', 'number')) AS differ FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY bulk ORDER BY md5('20260805|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY bulk) AS n_pool FROM y WHERE NOT differ AND rule IS NULL),
s AS (SELECT y.*, z.n_pool, CASE WHEN y.differ THEN 'disagreement' WHEN z.r <= {SAMPLE_CAP} THEN 'class_sample' END AS reason FROM y LEFT JOIN z USING (doc_id)),
a AS (SELECT *, CASE WHEN reason IS NOT NULL AND doc_id % 7 <> 0 THEN CASE WHEN quality = 1 THEN 'keyword' ELSE 'scope' END END AS arbiter FROM s)
SELECT doc_id, rule, bulk, reason, arbiter, CASE WHEN reason IS NOT NULL THEN coalesce(arbiter, nullif(bulk, 'unparseable'), rule, 'scope') ELSE coalesce(rule, bulk) END AS final, reason IS NULL AND rule IS NULL AS unsampled, reason IS NOT NULL AND arbiter IS NULL AS unresolved, n_pool FROM a""")
def cascade_sample(spark, d):
    """Which pairs go to the arbiter: all that rule and bulk label disagree on, and of each class that the rules don't know a seeded sample,
    whose denominator stands beside it; then the final label, the arbiter's before the bulk's before the rule's. An arbiter that says
    nothing (here: for one id in seven) leaves the pair unresolved, never silently."""
    p = labelled_pairs(spark, d)
    rule = T.edit_class(F.col("a"), F.col("b"))
    bulk = F.when(F.col("toxic") == 1, "unparseable").when(F.col("quality") == 0, "scope").when(F.col("jaccard") < 0.05, "keyword").otherwise("identifier")
    x = p.select("doc_id", "quality", F.when(rule != "other", rule).alias("rule"), bulk.alias("bulk"))
    differ = (F.col("bulk") == "unparseable") | F.coalesce(F.col("bulk") != F.col("rule"), F.col("bulk").isin("keyword", "number"))
    x = x.withColumn("differ", differ).persist()
    pool = x.where("NOT differ AND rule IS NULL")
    chosen = bottom(pool, "bulk", F.md5(F.concat_ws("|", F.lit(SEED), "doc_id")), "doc_id", SAMPLE_CAP).select("doc_id", F.lit(True).alias("sampled"))
    sizes = pool.groupBy("bulk").agg(F.count("*").alias("n_pool"))  # a row for each class
    s = x.join(chosen, "doc_id", "left").join(F.broadcast(sizes), "bulk", "left")
    unseen = ~F.col("differ") & F.col("rule").isNull()
    s = s.withColumn("n_pool", F.when(unseen, F.col("n_pool"))).withColumn("reason", F.when(F.col("differ"), "disagreement").when(F.col("sampled"), "class_sample"))
    s = s.withColumn("arbiter", F.when(F.col("reason").isNotNull() & (F.col("doc_id") % 7 != 0), F.when(F.col("quality") == 1, "keyword").otherwise("scope")))
    known = F.when(F.col("bulk") != "unparseable", F.col("bulk"))
    final = F.when(F.col("reason").isNotNull(), F.coalesce("arbiter", known, "rule", F.lit("scope"))).otherwise(F.coalesce("rule", "bulk"))
    return s.select("doc_id", "rule", "bulk", "reason", "arbiter", final.alias("final"), (F.col("reason").isNull() & F.col("rule").isNull()).alias("unsampled"), (F.col("reason").isNotNull() & F.col("arbiter").isNull()).alias("unresolved"), "n_pool")
