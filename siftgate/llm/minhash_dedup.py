"""MinHash near-dedup with tensored banding.

Only ``COLLECTIONS`` small collections of ``ROWS`` minhashes are computed; every pair of collections forms the key of a
table. Documents that agree in two collections meet in a table, so the work for minhashes is about a square root of that
of independent tables. At the least similarity that counts the chance to meet is over 0.9999 (0.999 at 80 percent).

Documents with the same shingle set are one class before anything is paired. Classes that meet in a bucket of up to
``BIG`` are compared pair by pair. Larger buckets are never paired out. First each of their classes is compared with one
member only, that of the least hash; confirmed links give first components. A bucket within one of them is
settled, which is the fate of nearly all groups of near copies, at a cost that grows with their size and not with its square.
What is left are buckets that span several components: those that share classes form a group, a group is cut into blocks
of about ``BLOCK`` classes (large components into blocks of their own, the rest by hash), and each pair of blocks goes to one
task, which counts all intersections as matrix products and returns a spanning forest of its links only; blocks of one
component never meet. So a stray class costs a comparison with each member of the bucket, two large components that meet
cost the product of their sizes: the exact answer needs these. Links are always confirmed on the full sets, and no link
between different texts that meet is lost. Components are found by handing on the least id, in tables in the shared folder.

Cases: null and empty texts have no shingles and are linked with nothing; fewer words than a shingle make one;
repeated rows and ids are documents of their own (rows that share an id share its component id); columns besides
doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import windows as K
from .substring_dedup import grams, word_hashes

SHINGLE = 5
PERCENT = 85
COLLECTIONS, ROWS = 14, 3
CHUNK = 1 << 20
BIG, BLOCK = 8, 128
_r = np.random.default_rng(11)
MULTIPLY = _r.integers(0, 2**63, COLLECTIONS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _r.integers(0, 2**64, COLLECTIONS * ROWS, np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and where each document's begin."""
    h, at = word_hashes(LOWER[data], offsets)
    n = np.diff(at)
    g = grams(h, size) if len(h) >= size else h[:0]
    many = n >= size
    start = np.flatnonzero(K.left_over(at) >= size) if len(h) else np.empty(0, np.int64)
    row = np.searchsorted(at, start, "right") - 1
    values, rows = [g[start]], [row]
    for i in np.flatnonzero((n > 0) & ~many).tolist():
        x = np.uint64(0x5851F42D4C957F2D)
        for w in h[at[i] : at[i + 1]]:
            x = K.mix(np.array([x]), np.array([w]))[0]
        values.append(np.array([x]))
        rows.append(np.array([i]))
    v, r = np.concatenate(values), np.concatenate(rows)
    o = np.lexsort((v, r))
    v, r = v[o], r[o]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(len(n) + 1))


SIGNED = "rid long, doc_id long, n_shingles long, s long, t long, bands array<long>"


def _sign(size: int):
    def go(batches):
        for batch in batches:
            out = []
            for i, j, data, offsets in K.chunks(batch.column(2), CHUNK):
                v, at = shingles(data, offsets, size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sums = np.zeros((2, j - i), np.uint64)
                bands = np.zeros((j - i, COLLECTIONS), np.uint64)
                if len(full):
                    first = at[:-1][full]
                    a = K.mix(v, v >> np.uint64(7))
                    sums[0, full], sums[1, full] = np.add.reduceat(a, first), np.add.reduceat(K.mix(a, ~v), first)
                    for c in range(COLLECTIONS):
                        key = np.full(len(full), c, np.uint64)
                        for k in range(c * ROWS, (c + 1) * ROWS):
                            x = v * MULTIPLY[k] + ADD[k]
                            x ^= x >> np.uint64(32)
                            x *= MULTIPLY[k]
                            key = K.mix(key, np.minimum.reduceat(x, first))
                        bands[full, c] = key
                out.append(pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * COLLECTIONS), pa.array(bands.ravel().view(np.int64)))], ["rid", "doc_id", "n_shingles", "s", "t", "bands"]))
            yield from out

    return go


def _sets(size: int):
    def go(batches):
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1), CHUNK):
                v, at = shingles(data, offsets, size)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v.view(np.int64)))], ["c", "shingles"])

    return go


def _compare(percent: int):
    """Links within (x = y) or between two blocks, as a spanning forest; between two, one link for each join of their parts."""

    def go(table: pa.Table) -> pa.Table:
        c, own, x, y = (table.column(k).to_numpy() for k in ("c", "own", "x", "y"))
        lists = table.column("shingles").combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(c)), n)
        o = np.argsort(code, kind="stable")
        code, row = code[o], row[o]
        both = np.zeros((len(c), len(c)), np.float32)
        step = 4096
        cuts = np.searchsorted(code, np.arange(0, (code[-1] if len(code) else 0) + step + 1, step))
        for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = np.zeros((len(c), step), np.float32)
            part[row[i:j], code[i:j] - k * step] = 1
            both += part @ part.T
        both = both.astype(np.int64)
        link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        link = np.triu(link, 1)
        inner = own[:, None] == own[None, :] if x[0] != y[0] else np.zeros_like(link)
        head = list(range(len(c)))

        def find(i):
            while head[i] != i:
                head[i] = head[head[i]]
                i = head[i]
            return i

        def unite(links):
            for i, j in zip(*np.nonzero(links), strict=True):
                p, q = find(int(i)), find(int(j))
                if p != q:
                    head[q] = p
                    yield c[i], c[j]

        # what is joined already needs no further link, and a block's own task returns the links within it
        known = table.column("known").to_numpy()
        first: dict = {}
        for i, k in enumerate(known.tolist()):
            head[find(i)] = find(first.setdefault(k, i))
        list(unite(link & inner))
        out = list(unite(link & ~inner))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return go


def components(links: DataFrame) -> DataFrame:
    """``c, comp``: the least id reachable, for every id in ``links(a, b)``. Neighbours hand on their least id until none falls."""
    both = C.table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    now = C.table(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        # the least among neighbours, then the label of one's own label: paths shrink by halves
        near = both.join(now.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.min("comp").alias("m"))
        step = now.join(near, "c").select("c", "comp", F.least("comp", "m").alias("m"))
        jump = now.select(F.col("c").alias("m"), F.col("comp").alias("mm"))
        new = C.table(step.join(jump, "m", "left").select("c", F.least("m", F.coalesce("mm", "m")).alias("comp"), (F.least("m", F.coalesce("mm", "m")) < F.col("comp")).alias("fell")), "labels")
        C.drop(now)
        now = new
        if not now.where("fell").limit(1).count():
            return now.select("c", "comp")


def minhash_dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``."""
    return near_groups(C.keyed(docs), shingle, percent).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id. Other columns are kept, whatever their names."""
    d, back = C.carried(docs)
    d = C.keyed(d, *C.others(d))
    heads = near_groups(d, shingle, percent).where("head").select("rid")
    return d.join(heads, "rid", "left_semi").select(*back)


def _buckets(classes: DataFrame) -> DataFrame:
    """``key, size, c, n_shingles``: classes that meet in a table, of whose keys several classes have the same."""
    pairs = [(i, j) for i in range(COLLECTIONS) for j in range(i + 1, COLLECTIONS)]
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i * COLLECTIONS + j), F.col("bands")[i], F.col("bands")[j]) for i, j in pairs])).alias("key")
    rows = classes.select("c", "n_shingles", keys)
    full = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return C.table(rows.join(full, "key").select("key", "size", "c", "n_shingles"), "buckets")


def _whole_sets(d: DataFrame, buckets: DataFrame, shingle: int) -> DataFrame:
    """``c, shingles`` of the classes that are in a bucket."""
    ids = buckets.select("c").distinct()
    texts = d.select(F.col("rid").alias("c"), "text").join(ids, "c").select("c", "text")
    return C.table(texts.mapInArrow(_sets(shingle), "c long, shingles array<long>"), "sets")


def near_groups(d: DataFrame, shingle: int, percent: int) -> DataFrame:
    """:func:`minhash_dedup` for documents with ``rid``, which it keeps, and ``head``: whether the row stands for its component."""
    signed = C.table(d.select("rid", "doc_id", "text").mapInArrow(_sign(shingle), SIGNED), "signed")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "rid", "doc_id", "bands")).alias("x")
    classes = C.table(signed.where("n_shingles > 0").groupBy("s", "t", "n_shingles").agg(least).select(F.col("x.rid").alias("c"), F.col("x.doc_id").alias("doc_id"), "n_shingles", "s", "t", "x.bands"), "classes")

    buckets = _buckets(classes)
    C.release(d.sparkSession)  # the tables' shuffles
    sets = _whole_sets(d, buckets, shingle)
    C.release(d.sparkSession)  # that of the texts

    left, right = sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb"))

    def confirmed(candidates: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("sa", "sb"))
        return candidates.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    near_size = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    x, y = (buckets.where(f"size <= {BIG}").select("key", F.col("c").alias(v), F.col("n_shingles").alias(f"n{v}")) for v in "ab")
    small = x.join(y, "key").where(F.col("a") < F.col("b"))
    # large buckets: one member that all others are compared with
    big = buckets.where(f"size > {BIG}")
    by_hash = F.struct(F.xxhash64("c").alias("h"), "c", F.col("n_shingles").alias("n"))
    stars = big.join(big.groupBy("key").agg(F.min(by_hash).alias("m")), "key").where("c <> m.c")
    stars = stars.select(F.least("c", "m.c").alias("a"), F.greatest("c", "m.c").alias("b"), F.col("n_shingles").alias("na"), F.col("m.n").alias("nb"))
    some = C.table(small.select(*stars.columns).unionByName(stars).where(near_size).select("a", "b").distinct(), "pairs")
    links = C.table(confirmed(some), "confirmed")

    # large buckets that span several components: groups of those that share classes, compared block by block
    if not big.isEmpty():
        part = components(links)
        placed = big.select("key", "c").join(part, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        spans = placed.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("c").alias("b")).where("least <> most").select("key", "b")
        spans = C.table(placed.join(spans, "key").select("c", "comp", "b"), "spans")
        if not spans.isEmpty():
            group = components(spans.select(F.col("c").alias("a"), "b").distinct()).withColumnRenamed("comp", "g")
            members = spans.select("c", "comp").distinct().join(group, "c")
            n = members.groupBy("g", "comp").agg(F.count("*").alias("n"))
            cut = members.join(n.withColumn("pure", F.col("n") >= BLOCK), ["g", "comp"])
            sizes = cut.groupBy("g", F.when(F.col("pure"), F.col("comp")).alias("own_comp")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
            cut = cut.withColumn("own_comp", F.when(F.col("pure"), F.col("comp"))).alias("m").join(sizes.alias("s"), F.expr("m.g = s.g AND m.own_comp <=> s.own_comp")).select("m.g", "m.c", "m.comp", "m.own_comp", "blocks")
            cut = C.table(cut.withColumn("own", F.xxhash64(F.coalesce("own_comp", F.lit(0)), F.col("own_comp").isNull(), F.pmod(F.xxhash64("c"), "blocks"))), "blocks")
            blocks = cut.select("g", "own", "own_comp").distinct()
            x, y = (blocks.select("g", F.col("own").alias(v), F.col("own_comp").alias(f"of_{v}")) for v in "xy")
            meet = x.join(y, "g").where("x <= y AND NOT coalesce(of_x = of_y, false)").select("g", "x", "y")
            members = cut.select("g", "c", "own", F.col("comp").alias("known"))
            sides = members.join(meet.withColumn("own", F.col("x")), ["g", "own"]).unionByName(members.join(meet.where("x < y").withColumn("own", F.col("y")), ["g", "own"]))
            forest = sides.join(sets, "c").select("g", "x", "y", "c", "own", "known", "shingles").groupBy("g", "x", "y").applyInArrow(_compare(percent), "a long, b long")
            links = C.table(links.union(forest), "all-links")
    label = components(links)
    named = classes.join(label, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    order = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "c", F.col("doc_id").alias("component_id"))).alias("x")
    heads = named.groupBy("comp").agg(order).select("comp", "x.component_id", F.col("x.c").alias("head_rid"))
    named = named.join(heads, "comp").select("s", "t", "n_shingles", "component_id", "head_rid")
    some = signed.where("n_shingles > 0").select("rid", "doc_id", "n_shingles", "s", "t").join(named, ["s", "t", "n_shingles"])
    none = signed.where("n_shingles = 0").select("rid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("rid").alias("head_rid"))
    out = some.select(*none.columns).unionByName(none)
    return out.select("rid", (F.col("rid") == F.col("head_rid")).alias("head"), "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return minhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
