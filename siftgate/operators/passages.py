"""Length-controlled passages: payloads spliced into frames of a host, cut to an exact number of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import kept
from . import order

# Fixed values.
BINS = [64, 96, 128, 256, 512, 1024, 2048, 4096]
#: Midpoints of the first, middle and last tenth of the slots.
POSITIONS = [("early", 0.05), ("middle", 0.5), ("late", 0.95)]
KEPT = 4


def anchors(items: DataFrame) -> DataFrame:
    """``item_id, orig, para`` (without its last word), ``affirm`` (the next item's text, of the last the first's), ``scope``
    (nullable). Items are numbered by ranges of ids, and neighbours joined by their numbers. They are a table, as every step reads them."""
    words = T.ws_tokens(F.col("text"))
    numbered = kept(order.indexed(items.select("item_id", "text"), "item_id"), "items")
    follows = numbered.select(F.col("text").alias("affirm"), F.when(F.col("index") > 0, F.col("index") - 1).otherwise(numbered.count() - 1).alias("index"))
    a = numbered.join(follows, "index")
    return kept(a.select("item_id", F.col("text").alias("orig"), F.array_join(F.slice(words, 1, F.size(words) - 1), " ").alias("para"), "affirm", F.when(F.col("item_id") % 10 != 0, F.col("text")).alias("scope")), "anchors")


def eligible(a: DataFrame) -> DataFrame:
    """anchors x bins with ``fits``: the longest payload takes half of the budget at most."""
    longest = F.greatest(*[T.ws_count(F.col(c)) for c in ("orig", "para", "affirm")])
    b = a.withColumn("longest", longest).withColumn("bin", F.explode(F.array(*map(F.lit, BINS))))
    return b.withColumn("fits", F.col("longest") <= T.budget(F.col("bin")) / 2)


def attrition(a: DataFrame) -> DataFrame:
    e = eligible(a).groupBy("bin").agg(F.count_if("fits").alias("eligible"), F.count_if(~F.col("fits")).alias("dropped"), F.count_if(F.col("fits") & F.col("scope").isNotNull()).alias("scope_eligible"))
    return e.withColumn("dropped_share", F.round(F.col("dropped") / (F.col("eligible") + F.col("dropped")), 9))


def cohort(a: DataFrame) -> DataFrame:
    return eligible(a).groupBy("item_id").agg(F.bool_and("fits").alias("all_fit")).where("all_fit").select("item_id")


def reached(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, reach``: the longest bin that a document has enough words for (null: none). Words are counted once: the
    table (no texts) is kept."""
    d = docs.select("doc_id", "lang", T.ws_count(F.col("text")).alias("n"))
    reach = F.greatest(*[F.when(F.col("n") >= T.budget(F.lit(b)), F.lit(b)) for b in BINS])
    return kept(d.select("doc_id", "lang", reach.alias("reach")), "reached")


def longest(counted: DataFrame) -> DataFrame:
    """``domain, most``: the longest bin that any document of a domain (language) reaches. A row for each language."""
    return counted.groupBy(F.col("lang").alias("domain")).agg(F.max("reach").alias("most"))


def chosen(counted: DataFrame) -> DataFrame:
    """Of :func:`reached` the documents with enough words for the longest bin that any of their domain reaches: one host serves all
    of a domain's bins, so lengths are never compared across hosts."""
    return counted.join(F.broadcast(longest(counted)), F.expr("lang <=> domain AND reach = most")).select("doc_id", "lang", "reach")


def hosts(docs: DataFrame) -> DataFrame:
    """:func:`chosen` with texts."""
    return docs.select("doc_id", "text").join(chosen(reached(docs)), "doc_id").select("doc_id", "lang", "text", "reach")


def places(n: Column, kept: int, *key: Column) -> Column:
    """``kept`` distinct places below ``n`` (all, if there are fewer), each set as likely as any other: for each bound b from n - kept + 1 to
    n a hash of key and bound draws one below b, which counts unless it was drawn before; then b - 1 does. In the order of a hash."""
    bounds = F.filter(F.sequence(F.greatest(n - kept, F.lit(0)) + 1, F.greatest(n, F.lit(1))), lambda b: b <= n)
    text = [x.cast("string") for x in key]

    def take(have: Column, b: Column) -> Column:
        t = F.floor(T.unit_hash(*text, b.cast("string")) * b)
        return F.concat(have, F.array(F.when(F.array_contains(have, t), b - 1).otherwise(t)))

    drawn = F.aggregate(bounds, F.array().cast("array<long>"), take)
    return F.transform(F.array_sort(F.transform(drawn, lambda p: F.struct(F.md5(F.concat_ws("|", *text, p.cast("string"))), p.alias("p")))), lambda s: s["p"])


def draw(a: DataFrame, pool: DataFrame, seed: str) -> DataFrame:
    """``item_id, lang, r, doc_id``: for each anchor and domain ``KEPT`` hosts of ``pool(doc_id, lang)`` in the order drawn.

    Hosts are numbered within their domain and looked up by the places drawn: rows are anchors x domains x KEPT, no host is looked at
    besides those drawn."""
    numbered = order.indexed(pool.select("doc_id", "lang"), "doc_id", "lang")
    n = pool.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each domain
    each = a.select("item_id").crossJoin(F.broadcast(n)).withColumn("places", places(F.col("n"), KEPT, F.lit(seed), F.col("item_id"), F.coalesce("lang", F.lit(""))))
    each = each.select("item_id", F.col("lang").alias("of"), F.posexplode("places").alias("r", "place"))
    return each.join(numbered, F.expr("of <=> lang AND place = index")).select("item_id", "lang", (F.col("r") + 1).alias("r"), "doc_id")


def sentence_counts(sents: Column) -> Column:
    """Words up to the end of each sentence."""
    return F.aggregate(sents, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + T.ws_count(x))))


def frame(sents: Column, upto: Column, words: Column) -> Column:
    """The first sentences, as many ``words``; the last one is cut where they end."""
    whole = F.size(F.filter(upto, lambda u: u <= words))
    rest = words - F.coalesce(F.get(upto, whole - 1), F.lit(0))
    cut = F.array_join(F.slice(T.ws_tokens(F.get(sents, whole)), F.lit(1), rest), " ")
    return F.concat(F.slice(sents, F.lit(1), whole), F.when(rest > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))


def titration(a: DataFrame, docs: DataFrame, seed: str, first: DataFrame | None = None) -> DataFrame:
    """Member texts and lexical score (``content``: without stop words; ``longest``: words of the longer member) for each anchor, domain, bin,
    position and pair class.

    The frame is the first clean host's first sentences, as many words as the budget leaves beside ``orig``, so that every
    member ``a`` has the bin's words exactly; the payload goes in between two sentences. ``scope`` pairs need a scope
    payload that takes half of the budget at most. ``first``: :func:`first_clean`, if it is there already."""
    first = (first_clean(a, docs, seed) if first is None else first).select("item_id", "lang", "doc_id", "reach")
    e = eligible(a).where("fits").select("item_id", "bin", "orig", "para", "affirm", "scope")
    # each host's sentences are counted once, each frame's tokens too: positions and pair classes don't change them
    h = docs.select("doc_id", "text").join(first.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", T.sentences(F.col("text")).alias("sents"))
    h = h.withColumn("upto", sentence_counts(F.col("sents")))
    left = (T.budget(F.col("bin")) - T.ws_count(F.col("orig"))).cast("int")
    j = e.join(first, "item_id").where("bin <= reach").join(h, "doc_id").withColumn("frame", frame(F.col("sents"), F.col("upto"), left)).drop("sents", "upto")
    j = j.withColumn("tokens", T.token_set(F.array_join("frame", " "))).withColumn("rare", T.stopped(F.col("tokens")))
    scope = F.when(F.greatest(T.ws_count(F.col("orig")), T.ws_count(F.col("scope"))) <= T.budget(F.col("bin")) / 2, F.col("scope"))
    kinds = F.filter(F.array(*[F.struct(F.lit(n).alias("pair"), F.col("orig").alias("x"), y.alias("y")) for n, y in (("flip", F.col("affirm")), ("faithful", F.col("para")), ("scope", scope))]), lambda s: s["y"].isNotNull())
    j = j.withColumn("left", left).select("item_id", "lang", "bin", "frame", "left", "tokens", "rare", F.explode(kinds).alias("k")).select("*", "k.*")
    px, py = T.token_set(F.col("x")), T.token_set(F.col("y"))
    shared, either = F.array_intersect(px, py), F.array_union(px, py)
    # the members' token sets are those of the frame and of a payload each, as a blank lies between
    def alike(of: str, shared: Column, either: Column) -> Column:
        every = F.size(F.array_union(of, either))
        return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_union(of, shared)) / every)

    score, content = alike("tokens", shared, either), alike("rare", T.stopped(shared), T.stopped(either))
    j = j.select("item_id", "lang", "bin", "frame", "pair", "x", "y", F.size("tokens").alias("host_set"), F.size(shared).alias("shared"), F.size(either).alias("either"), score.alias("score"), content.alias("content"), (F.col("left") + F.greatest(T.ws_count(F.col("x")), T.ws_count(F.col("y")))).alias("longest"), T.ws_count(F.col("x")).alias("payload_ws"))
    pos = F.explode(F.array(*[F.struct(F.lit(n).alias("position"), F.lit(q).alias("q")) for n, q in POSITIONS])).alias("p")
    j = j.select("*", pos).select("*", "p.*").withColumn("slot", F.least(F.size("frame"), F.floor(F.col("q") * (F.size("frame") + 1)).cast("int")))

    def spliced(c: str):
        rest = F.slice("frame", F.col("slot") + 1, F.greatest(F.size("frame") - F.col("slot"), F.lit(0)))
        return F.array_join(F.concat(F.slice("frame", 1, F.col("slot")), F.array(c), rest), " ")

    return j.select("item_id", "lang", "bin", "position", "slot", "pair", spliced("x").alias("text_a"), spliced("y").alias("text_b"), "payload_ws", "host_set", "shared", "either", "score", "content", "longest")


def unfilled(a: DataFrame, docs: DataFrame, seed: str, first: DataFrame | None = None) -> DataFrame:
    """``item_id, lang, bin, position`` of the eligible cells without a frame: no drawn host is clean, or none has the words."""
    first = first_clean(a, docs, seed) if first is None else first
    u = eligible(a).where("fits").crossJoin(F.broadcast(longest(reached(docs)))).withColumnRenamed("domain", "lang")  # a row per language
    u = u.join(first.select("item_id", "lang", "doc_id"), ["item_id", "lang"], "left").where("doc_id IS NULL OR most IS NULL OR bin > most")
    return u.select("item_id", "lang", "bin", F.explode(F.array(*[F.lit(n) for n, _ in POSITIONS])).alias("position"))


#: Anchors that look into a host in one row.
ASKS = 256


def first_clean(a: DataFrame, docs: DataFrame, seed: str) -> DataFrame:
    """``item_id, lang, r, doc_id, reach``: of each anchor's drawn hosts the first that holds none of its payloads.

    Payloads are brought to the hosts, up to ``ASKS`` anchors in a row: a host's text is folded once for all of them and never
    copied to an anchor. The table (no texts) is kept."""
    needles = F.array_compact(F.array(*[T.fold(F.col(c)) for c in ("orig", "para", "affirm", "scope")])).alias("needles")
    pool = kept(chosen(reached(docs)), "hosts")
    asks = draw(a, pool, seed).join(a.select("item_id", needles), "item_id")
    asks = asks.groupBy("doc_id", F.floor(F.col("item_id") / ASKS).alias("part")).agg(F.collect_list(F.struct("item_id", "lang", "r", "needles")).alias("asks"))
    j = docs.select("doc_id", T.fold(F.col("text")).alias("body")).join(asks, "doc_id")
    clean = j.select("doc_id", F.explode(F.filter("asks", lambda x: ~F.exists(x["needles"], lambda n: F.col("body").contains(n)))).alias("x")).select("doc_id", "x.item_id", "x.lang", "x.r")
    best = clean.groupBy("item_id", "lang").agg(F.min(F.struct("r", "doc_id")).alias("x")).select("item_id", "lang", "x.r", "x.doc_id")
    return kept(best.join(pool.select("doc_id", "reach"), "doc_id").select("item_id", "lang", "r", "doc_id", "reach"), "first-clean")


def native_windows(found: DataFrame, bins: list[int]) -> DataFrame:
    """Words around a payload where it stands in its own text, for ``found(item_id, doc_id, body, item, payload)``.

    The window has the bin's words without the payload; a share by position lies before it. What one side lacks the
    other gives; ``n_before`` and ``n_after`` are null where both together lack words, or payload or item isn't there."""
    at, inner = T.find_ci(F.col("body"), F.col("item")), T.find_ci(F.col("item"), F.col("payload"))
    d = found.withColumn("start", F.when((at > 0) & (inner > 0), at + inner - 1))
    d = d.withColumn("before", T.ws_tokens(F.substring("body", F.lit(1), F.col("start") - 1))).withColumn("after", T.ws_tokens(F.substring("body", F.col("start") + F.length("payload"), F.length("body"))))
    pos = F.explode(F.array(*[F.struct(F.lit(n).alias("position"), F.lit(q).alias("q")) for n, q in POSITIONS])).alias("p")
    d = d.withColumn("bin", F.explode(F.array(*map(F.lit, bins)))).select("*", pos).select("*", "p.*")
    room = (T.budget(F.col("bin")) - T.ws_count(F.col("payload"))).cast("int")
    d = d.withColumn("room", room).where("room >= 0")
    nb = F.least(F.bround(F.col("q") * F.col("room"), 0).cast("int"), F.size("before"))
    d = d.withColumn("nb", nb).withColumn("na", F.least(F.col("room") - F.col("nb"), F.size("after")))
    d = d.withColumn("nb", F.least(F.col("room") - F.col("na"), F.size("before")))
    fits = F.col("start").isNotNull() & (F.col("nb") + F.col("na") == F.col("room"))
    text = F.concat_ws(" ", F.slice("before", F.size("before") - F.col("nb") + 1, F.col("nb")), F.col("payload"), F.slice("after", F.lit(1), F.col("na")))
    return d.select("item_id", "doc_id", "bin", "position", F.when(fits, F.col("nb")).alias("n_before"), F.when(fits, F.col("na")).alias("n_after"), F.when(fits, text).alias("text"))
