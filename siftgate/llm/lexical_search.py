"""Ranked lexical search over a tiered index of whole documents.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased; they are told apart by 64-bit hashes.
A posting's impact is ``(10^9 * tf) div (1000 * tf + 20 * m)``, where m follows the document's length against the mean; an item's score of
a document is the sum of weight times impact over the item's terms, once each. All of this is integer arithmetic (sums
stay below 2^53, so that doubles hold them exactly).

Index. Documents are cut into shards of about ``CHUNK`` bytes of text or one text; a shard is one row. It holds the shard's
terms with their counts and three tiers of postings: of each term the postings of highest impact first (all of them up to ``SHORT``, else a
sixteenth), then those up to a quarter, then the rest. For each term and tier it states the residual bound, the largest
impact that the tiers after it hold. Building the index shuffles nothing, and every document is in it.

Search. Queries are taken in blocks of about ``ITEMS``; the weights of a block's terms come from one sum over the shards' counts.
A first scan reads the first tier's columns only and finds for each item the K documents of the best partial scores. A second one
scores just these exactly: the least of K exact scores is a floor that every document in the result reaches. The third scan goes
down the tiers: after each, a document's bound is its score so far plus the weighted residual bounds of the item's terms that it hasn't shown yet.
Where no document of a shard can reach an item's floor, that is the proof, and the pair of shard and item is done. Pairs that lack it fall through
to the next tier, with the documents that may still reach the floor and no others; after the last tier scores are exact. Only exact scores are
returned, at most K for each shard and item; the best K of an item are taken by a rank that is limited in each task before it is shuffled.

Cases: null and empty texts and texts without terms have none and are never found; very long texts are a shard of their own; equal scores go by
ascending doc_id (null last), then row; repeated rows and ids are documents (items) of their own; items without terms give
no rows; columns besides the id and the text are ignored; an empty table of documents or items gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import windows as K
from .minhash_dedup import LOWER
from .substring_dedup import word_hashes

TOP = 50
CHUNK = 1 << 19
#: Documents, and shards, that are handed to Python at once.
BATCH, SHARDS = 1000, 8
SHORT = 4
#: Queries and query terms of a block, terms scored at once.
ITEMS, TERMS, COLUMNS = 256, 20_000, 1024
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = ~np.array([chr(i).isalnum() for i in range(128)])

#: Columns of the index: each cell is an array as bytes (a shard's documents are rows of one batch, 65,536 at most).
LAYOUT = {"rids": np.int64, "ids": np.int64, "no_id": np.bool_, "terms": np.int64, "counts": np.int32} | {f"{k}{t}": kind for t in (1, 2, 3) for k, kind in (("n", np.int32), ("at", np.uint16), ("impact", np.int32), ("rest", np.int32))}
INDEX = ", ".join(f"{k} binary" for k in LAYOUT)
FIRST = ["terms", "n1", "at1", "impact1"]


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of the documents in ``data``, and where each document's terms begin."""
    return word_hashes(LOWER[data], offsets, OUTSIDE)


def _lengths(batches):
    """Documents with a term and terms of all documents."""
    for batch in batches:
        n = total = 0
        for _, _, data, offsets in K.chunks(batch.column(0), CHUNK):
            _, at = terms_of(data, offsets)
            n, total = n + int(np.count_nonzero(np.diff(at))), total + int(at[-1])
        yield pa.record_batch([pa.array([n]), pa.array([total])], ["n", "l"])


def _shard(n_docs: int, n_terms: int, chunk: int):
    """One row of the index for each chunk of documents."""

    def go(batches):
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(2), chunk):
                h, at = terms_of(data, offsets)
                if len(h):
                    yield pa.record_batch(columns(h, at, batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)), list(LAYOUT))

    def columns(h, at, rids, ids):
        n = np.diff(at)
        m = 50 + (50 * n * n_docs) // n_terms
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
        first = np.flatnonzero(new)
        tf = np.diff(np.r_[first, len(h)])
        h, row = h[first].view(np.int64), row[first]
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
        terms, code, counts = np.unique(h, return_inverse=True, return_counts=True)
        order = np.lexsort((row, -impact, code))
        code, row, impact = code[order], row[order], impact[order]
        begin = np.cumsum(counts) - counts
        rank = np.arange(len(code)) - begin[code]
        ends = [np.minimum(counts, np.maximum(SHORT, -(-counts // share))) for share in (16, 4, 1)]
        out = [rids.to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), terms, counts]
        for low, high in zip([np.zeros_like(counts), *ends[:-1]], ends, strict=True):
            mine = (rank >= low[code]) & (rank < high[code])
            rest = np.where(high < counts, impact[np.minimum(begin + high, len(impact) - 1)], 0)
            out += [high - low, row[mine], impact[mine], rest]
        return [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(out, LAYOUT.values(), strict=True)]

    return go


class Index:
    """The table of shards with the numbers of all documents (``n_docs`` with a term) and terms that weights need."""

    def __init__(self, docs: DataFrame, chunk: int = CHUNK) -> None:
        d = C.keyed(docs)
        with C.batches(docs.sparkSession, BATCH):
            s = d.select("text").mapInArrow(_lengths, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
            self.n_docs, self.n_terms = s[0] or 0, s[1] or 0
            self.shards = C.table(d.select("rid", "doc_id", "text").mapInArrow(_shard(self.n_docs, self.n_terms, chunk), INDEX), "index")


def _asked(batches):
    """The distinct terms of each query."""
    for batch in batches:
        for i, j, data, offsets in K.chunks(batch.column(2), CHUNK):
            h, at = terms_of(data, offsets)
            each = [np.unique(h[a:b].view(np.int64)) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(each, pa.list_(pa.int64()))], ["rid", "item_id", "terms"])


def _counts(terms: np.ndarray):
    """How many documents hold each of ``terms`` (sorted)."""

    def go(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in _rows(batch):
                at = np.minimum(np.searchsorted(row["terms"], terms), len(row["terms"]) - 1)
                total += np.where(row["terms"][at] == terms, row["counts"][at], 0)
        yield pa.record_batch([pa.array(terms), pa.array(total)], ["term", "df"])

    return go


class _Scorer:
    """Scores of a block of queries in one shard, tier by tier."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, asks: np.ndarray) -> None:
        self.terms, self.weights, self.asks = terms, weights, asks  # asks: items x terms, 0 or 1

    def open(self, row: dict) -> bool:
        have = row["terms"]
        at = np.minimum(np.searchsorted(have, self.terms), len(have) - 1)
        self.q = np.flatnonzero(have[at] == self.terms)
        self.t = at[self.q]
        return len(self.q) > 0

    def add(self, row: dict, tier: int, scores: np.ndarray, items: np.ndarray, column: np.ndarray, owed: np.ndarray | None = None) -> None:
        """Adds the tier's weighted impacts to ``scores`` (items x documents); ``column`` is the place of each of the shard's documents there,
        or -1. ``owed``: from it the residual bounds of the terms shown are taken."""
        n = row[f"n{tier}"]
        begin = np.cumsum(n, dtype=np.int64) - n
        for s in range(0, len(self.q), COLUMNS):
            q, t = self.q[s : s + COLUMNS], self.t[s : s + COLUMNS]
            k = n[t].astype(np.int64)
            if total := int(k.sum()):
                which = np.repeat(np.arange(len(q)), k)
                at = np.arange(total) + np.repeat(begin[t] - (np.cumsum(k) - k), k)
                to = column[row[f"at{tier}"][at]]
                which, at, to = which[to >= 0], at[to >= 0], to[to >= 0]
                part, ask = np.zeros((len(q), scores.shape[1])), self.asks[np.ix_(items, q)]
                part[which, to] = self.weights[q][which] * row[f"impact{tier}"][at]
                scores += ask @ part
                if owed is not None:
                    part[which, to] = self.weights[q][which] * row["rest1"][t][which]
                    owed -= ask @ part

    def rest(self, row: dict, tier: int, items: np.ndarray) -> np.ndarray:
        """What the tiers after this one can add to any document's score at most."""
        return self.asks[np.ix_(items, self.q)] @ (self.weights[self.q] * row[f"rest{tier}"][self.t])


def _rows(batch: pa.RecordBatch):
    """Shards of a batch, as dictionaries of arrays."""
    for k in range(batch.num_rows):
        yield {name: np.frombuffer(batch.column(i)[k].as_buffer(), LAYOUT[name]) for i, name in enumerate(batch.schema.names)}


def _partial(shared, top: int):
    """The documents of the best partial scores of each item from the first tier, at most ``top`` of them for each task."""

    def go(batches):
        scorer = _Scorer(*shared.value)
        n = len(scorer.asks)
        every = np.arange(n)
        best, docs = np.zeros((n, 0)), np.zeros((n, 0), np.int64)
        for batch in batches:
            for row in _rows(batch):
                if scorer.open(row):
                    scores = np.zeros((n, len(row["rids"])))
                    scorer.add(row, 1, scores, every, np.arange(scores.shape[1]))
                    best, docs = np.concatenate([best, scores], 1), np.concatenate([docs, np.broadcast_to(row["rids"], scores.shape)], 1)
                    if best.shape[1] > top:
                        at = np.argpartition(-best, top - 1, 1)[:, :top]
                        best, docs = np.take_along_axis(best, at, 1), np.take_along_axis(docs, at, 1)
        item, at = np.nonzero(best)
        yield pa.record_batch([pa.array(item.astype(np.int32)), pa.array(docs[item, at]), pa.array(best[item, at].astype(np.int64))], ["item", "rid", "score"])

    return go


def _completed(shared, wanted: dict[int, list[int]]):
    """Exact scores of the documents in ``wanted`` for the items listed there."""
    asked = np.array(sorted(wanted), np.int64)

    def go(batches):
        scorer = _Scorer(*shared.value)
        every = np.arange(len(scorer.asks))
        for batch in batches:
            out = []
            for row in _rows(batch):
                some = np.flatnonzero(np.isin(row["rids"], asked))
                if len(some) and scorer.open(row):
                    column = np.full(len(row["rids"]), -1)
                    column[some] = np.arange(len(some))
                    scores = np.zeros((len(every), len(some)))
                    for t in (1, 2, 3):
                        scorer.add(row, t, scores, every, column)
                    out += [(i, int(scores[i, c])) for c, rid in enumerate(row["rids"][some].tolist()) for i in wanted[rid]]
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64()), strict=True)], ["item", "score"])

    return go


FOUND = "item int, rid long, doc_id long, score long, tier int"


def _exact(shared, floors: np.ndarray, top: int, proofs: bool):
    """Exact scores of at least the floor, at most ``top`` for each shard and item; pairs with a proof are left at their tier.

    proofs: one row for each shard and item instead, with the tier after which it had its proof (3: scored to the end)."""

    def go(batches):
        scorer = _Scorer(*shared.value)
        for batch in batches:
            out = []
            for row in _rows(batch):
                items = np.arange(len(scorer.asks))
                tier = np.ones(len(items), np.int32)
                if scorer.open(row):
                    docs = np.arange(len(row["rids"]))
                    scores, owed = np.zeros((len(items), len(docs))), np.zeros((len(items), len(docs)))
                    for t in (1, 2, 3):
                        column = np.full(len(row["rids"]), -1)
                        column[docs] = np.arange(len(docs))
                        # what a document may still get: the rest of each term that it hasn't shown, by the bound behind the first tier
                        scorer.add(row, t, scores, items, column, owed)
                        open_ = scores + owed + scorer.rest(row, 1, items)[:, None] >= floors[items][:, None] if t < 3 else scores >= floors[items][:, None]
                        lacks, may = open_.any(1), open_.any(0)
                        tier[items[lacks]] = min(3, t + 1)
                        items, docs = items[lacks], docs[may]
                        scores, owed = scores[lacks][:, may], owed[lacks][:, may]
                        if not len(items):
                            break
                    order = np.lexsort((row["rids"][docs], row["ids"][docs], row["no_id"][docs]))
                    for i, s in zip(items.tolist(), scores, strict=True):
                        ok = order[s[order] >= floors[i]]
                        out += [] if proofs else [(i, int(row["rids"][docs[x]]), None if row["no_id"][docs[x]] else int(row["ids"][docs[x]]), int(s[x]), 3) for x in ok[np.argsort(-s[ok], kind="stable")][:top]]
                if proofs:
                    out += [(i, 0, 0, 0, t) for i, t in enumerate(tier.tolist())]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["item", "rid", "doc_id", "score", "tier"])

    return go


def _blocks(items: DataFrame, item_id: str):
    """Blocks of queries, each with its distinct terms: (rows at the driver, their number bounded), by a hash of their number."""
    rows = items.select(F.monotonically_increasing_id().alias("rid"), F.col(item_id).cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = C.table(rows.mapInArrow(_asked, "rid long, item_id long, terms array<long>").where("size(terms) > 0"), "queries")
    n, terms = rows.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(-(-n // ITEMS), -(-(terms or 0) // TERMS))
    for b in range(blocks):
        yield rows.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b).orderBy("rid").collect()


def search(index: Index, items: DataFrame, item_id: str = "item_id", top: int = TOP, proofs: bool = False) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each row of ``items(item_id, text)``, scores above 0.

    proofs: ``item_id, tier`` for each shard and item instead, for measurements."""
    with C.batches(items.sparkSession, SHARDS):
        found = _found(index, items, item_id, top, proofs)
    if not found:
        return items.sparkSession.createDataFrame([], "item_id long, tier int" if proofs else "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def _found(index: Index, items: DataFrame, item_id: str, top: int, proofs: bool) -> list[DataFrame]:
    """The results of each block of queries."""
    spark, found = items.sparkSession, []
    for block in _blocks(items, item_id) if index.n_docs else ():
        if not block:
            continue
        terms = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in block]))
        df = np.zeros(len(terms), np.int64)
        for r in index.shards.select("terms", "counts").mapInArrow(_counts(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").collect():
            df[np.searchsorted(terms, r["term"])] = r["df"]
        weights = np.floor(1000 * np.log((2 * index.n_docs + 2) / (2 * df + 1)))
        asks = np.zeros((len(block), len(terms)))
        for i, r in enumerate(block):
            asks[i, np.searchsorted(terms, np.array(r["terms"], np.int64))] = 1
        shared = spark.sparkContext.broadcast((terms, weights, asks))
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "rid"))
        partial = index.shards.select("rids", *FIRST).mapInArrow(_partial(shared, top), "item int, rid long, score long")
        wanted: dict[int, list[int]] = {}
        for r in partial.withColumn("r", rank).where(F.col("r") <= top).collect():  # ``top`` rows for each query of the block
            wanted.setdefault(r["rid"], []).append(r["item"])
        done = index.shards.mapInArrow(_completed(shared, wanted), "item int, score long").groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        floors = np.ones(len(block))
        for r in done.where(F.col("n") >= top).collect():
            floors[r["item"]] = max(1, r["least"])
        exact = index.shards.mapInArrow(_exact(shared, floors, top, proofs), FOUND)
        names = F.create_map(*[x for i, r in enumerate(block) for x in (F.lit(i), F.lit(r["item_id"]).cast("long"))])[F.col("item")].alias("item_id")
        if proofs:
            found.append(C.table(exact.select(names, "tier"), "proofs"))
            continue
        by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "rid")
        ranked = exact.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
        found.append(C.table(ranked.select(names, "rank", "doc_id", "score"), "found"))
    return found


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(Index(docs), items)


OP12_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
a AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) AS m FROM d, a),
f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
x AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM f, a),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
 FROM q JOIN x USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
