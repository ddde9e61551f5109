"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams (single words and pairs, in spaces of their own): the target from
labelled clean documents, the raw one from all documents. A document's log weight is the sum of the log ratios
of its n-grams; adding Gumbel noise and keeping the k largest samples k documents without replacement in
proportion to their weights. k is a budget of documents. Where none is given it is a share of all documents, the one that a draw takes of the labelled documents
without part in the target model if it is to hold all but ``LOSS`` of their clean ones. So the labelled sample sets the budget, and the draw
over all documents decides who fills it.

The target model is fitted on at most ``sample`` labelled clean documents, every second by md5 of their id (a
documented bound). The raw model counts every document. Both models have a fixed number of buckets, as hashed n-gram
models do, so what the driver gathers and sends out is bounded.

Cases: null or empty texts have log weight 0; ids may be null (never labelled) or repeated; labels with nulls are
not clean, of several for one id the worst counts; without clean labels all log weights are 0 and, if no k is given,
all documents stay; noise hangs on id and text, so only rows with both alike share a draw; columns besides doc_id and text are kept by :func:`kept_documents`, whatever their names, and ignored
by :func:`importance_resample`; an empty table gives no rows. Ties at the k-th key all stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import windows as K
from .substring_dedup import grams, word_hashes

WORDS, PAIRS = 1 << 20, 1 << 16
BUCKETS = WORDS + PAIRS
#: Added to both counts of a bucket: rare n-grams say little.
PRIOR = 2.0
SAMPLE = 20_000
#: Share of the clean documents that the budget may leave out.
LOSS = 0.01
SEED = "draw-1"
CHUNK = 1 << 21


def features(column) -> tuple[np.ndarray, np.ndarray, int]:
    """Chunks as (bucket, row) of each n-gram, with the rows they span."""
    for i, j, data, offsets in K.chunks(column, CHUNK):
        h, at = word_hashes(data, offsets)
        row = np.repeat(np.arange(i, j), np.diff(at))
        two = grams(h, 2) if len(h) > 1 else h[:0]
        inside = row[1:] == row[:-1] if len(row) > 1 else np.empty(0, bool)
        yield np.r_[(h % np.uint64(WORDS)).astype(np.int64), WORDS + (two[inside] % np.uint64(PAIRS)).astype(np.int64)], np.r_[row, row[:-1][inside] if len(row) > 1 else row[:0]], i, j


def _count(target: np.ndarray):
    def go(batches):
        raw, aim = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0)
            mine = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), target) & ids.is_valid().to_numpy(zero_copy_only=False)
            for f, row, _, _ in features(batch.column(1)):
                raw += np.bincount(f, minlength=BUCKETS)
                if (m := mine[row]).any():
                    aim += np.bincount(f[m], minlength=BUCKETS)
        b = np.flatnonzero(raw)
        for s in range(0, len(b), 100_000):
            x = b[s : s + 100_000]
            yield pa.record_batch([pa.array(x.astype(np.int32)), pa.array(raw[x]), pa.array(aim[x])], ["bucket", "raw", "aim"])

    return go


def _score(model):
    def go(batches):
        ratio = model.value
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for f, row, i, j in features(batch.column(1)):
                total[i:j] += np.bincount(row - i, weights=ratio[f], minlength=j - i)
            yield pa.record_batch([*batch.columns, pa.array(total)], [*batch.schema.names, "log_weight"])

    return go


def kth_key(keys: DataFrame, k: int) -> float:
    """The k-th largest of a double column ``key``, by ever finer histograms; never more than 4096 rows at the driver."""
    n, lo, hi = keys.agg(F.count("key"), F.min("key"), F.max("key")).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    if lo == hi:
        return lo
    while True:
        if lo == hi:
            return lo
        inside = keys.where((F.col("key") >= F.lit(lo)) & (F.col("key") <= F.lit(hi)))
        bins = F.least(F.floor((F.col("key") - F.lit(lo)) / F.lit(max((hi - lo) / 4096, 5e-324))), F.lit(4095)).alias("bin")
        rows = inside.groupBy(bins).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if k <= r["n"]:
                if (r["a"], r["b"]) == (lo, hi) and len(rows) == 1:
                    return lo
                lo, hi = r["a"], r["b"]
                break
            k -= r["n"]


def budget(held: DataFrame, n: int, loss: float = LOSS) -> int:
    """Of ``n`` documents how many to draw: the share that a draw takes of the labelled ones ``held(key, clean)`` if it is to hold all but
    ``loss`` of the clean ones, times n. All, where none is clean."""
    n_clean = held.where("clean").count()
    if not n_clean:
        return n
    least = kth_key(held.where("clean").select("key"), n_clean - int(n_clean * loss))
    return math.ceil(n * held.agg(F.avg((F.col("key") >= F.lit(least)).cast("int"))).first()[0])


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, sample: int = SAMPLE, seed: str = SEED) -> DataFrame:
    """``doc_id, log_weight, key, kept`` for ``docs(doc_id, text)``, ``labels(doc_id, quality, toxic)``."""
    return _resample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, k, sample, seed).drop("text")


def _resample(d: DataFrame, labels: DataFrame, k: int | None, sample: int, seed: str, text: bool = False) -> DataFrame:
    """:func:`importance_resample` with the columns named by :func:`.common.carried`, and texts if asked for."""
    spark = d.sparkSession
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t"))
    clean = told.where("q = 1 AND t = 0")
    clean = clean.select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h")).withColumn("half", F.conv(F.substring("h", 32, 1), 16, 10).cast("int") % 2)
    # one half of the clean documents can be in the target model, the other tells the budget
    target = np.array([r[0] for r in clean.where("half = 0").orderBy("h", "doc_id").limit(sample).select("doc_id").collect()], np.int64)
    counts = d.select("doc_id", "text").mapInArrow(_count(target), "bucket int, raw long, aim long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("aim").alias("aim")).toArrow()
    raw, aim = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts.column("bucket").to_numpy()
    raw[at], aim[at] = counts.column("raw").to_numpy(), counts.column("aim").to_numpy()
    ratio = np.zeros(BUCKETS)
    for part in (slice(0, WORDS), slice(WORDS, BUCKETS)):
        if aim[part].sum():
            expected = raw[part] * (aim[part].sum() / raw[part].sum())
            ratio[part] = np.log((aim[part] + PRIOR) / (expected + PRIOR))
    model = spark.sparkContext.broadcast(ratio.astype(np.float32))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    base = d.select("doc_id", "text", *C.others(d))
    scored = base.mapInArrow(_score(model), ", ".join(f"{c} {kinds[c]}" for c in base.columns) + ", log_weight double")
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)
    scored = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))
    scored = C.table(scored if text else scored.drop("text"), "weights")
    if k is None:
        # of the labelled documents half, so that both kinds stand in their proportion
        half = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 32, 1), 16, 10).cast("int") % 2
        held = told.where(half == 1).select("doc_id", F.expr("q = 1 AND t = 0").alias("clean")) if len(target) else told.where("false").select("doc_id", F.lit(False).alias("clean"))
        k = budget(scored.select("doc_id", "key").join(held, "doc_id").select("key", "clean"), scored.count())
    return scored.withColumn("kept", F.col("key") >= F.lit(kth_key(scored.select("key"), k)))


def kept_documents(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    d, back = C.carried(docs)
    return _resample(d, labels, k, SAMPLE, SEED, text=True).where("kept").select(*back)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return importance_resample(docs, labels).select("doc_id", "log_weight", "key", "kept")
