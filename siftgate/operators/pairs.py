"""All pairs of a table of vectors, block by block."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block; a task holds the products of two blocks.
BLOCK = 384


def _products(table: pa.Table) -> pa.Table:
    """Pairs (a < b by id) within one block, or between two."""
    ids, labels, own = (table.column(c).to_numpy() for c in ("vec_id", "label", "own"))
    lists = table.column("v").combine_chunks()
    v = lists.flatten().to_numpy().reshape(len(ids), -1)
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    if x == y:
        i, j = np.triu_indices(len(left), 1)
    else:
        i, j = (k.ravel() for k in np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
    dot = (v[left] @ v[right].T)[i, j]
    i, j = left[i], right[j]
    swap = ids[i] > ids[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return pa.table({"vec_id_a": ids[i], "vec_id_b": ids[j], "label_a": labels[i], "label_b": labels[j], "dot": dot, "gap": np.abs(v[i, 0] - v[j, 0])})


def all_pairs(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``vec_id_a, vec_id_b, label_a, label_b, dot, gap`` for every pair a < b of ``vectors(vec_id, label, v array<double>)``.

    The pairs are a square of the table, as asked for; vectors are copied once for each block they meet, and no pair is
    shuffled. ``gap`` is the distance of the first components. Vectors have one length, ids are unique and not null."""
    blocks = max(1, -(-vectors.count() // block))
    d = vectors.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    kinds = dict(vectors.dtypes)
    return d.select("vec_id", "label", "v", "own", "x", "y").groupBy("x", "y").applyInArrow(_products, f"vec_id_a {kinds['vec_id']}, vec_id_b {kinds['vec_id']}, label_a {kinds['label']}, label_b {kinds['label']}, dot double, gap double")


# counts of pairs: what a statistic needs of them is summed up in the task that forms them

#: Vectors of a block at most, blocks at least (where there are so many vectors), and pairs formed at once.
LARGEST, FEWEST, CHUNK = 16_384, 12, 1 << 21
#: Scores that share a row of counts; scores of a chunk that lie further apart than ``SPAN`` are sorted instead.
ROW, SPAN = 4096, 1 << 25
#: Numbers rounded at once, so few that they stay in a core's cache.
PIECE = 1 << 14
#: Rows and columns of a square of pairs that are put in strata at once, scores around 0 that a stratum has places for, and pairs counted before they
#: are handed on (a place has four bytes).
SQUARE, PLACES, MOST = 256, 1 << 21, (1 << 32) - 1
UNIT = 1e6
#: Rows of counts that a task holds before it hands them on.
HELD = 8192


def whole(x: np.ndarray, places: int) -> np.ndarray:
    """``x`` in units of the last of ``places``, rounded as Spark rounds: half up, by the decimal digits."""
    flat, out, unit = np.ascontiguousarray(x).reshape(-1), np.empty(x.shape, np.int64), 10.0**places
    ends = out.reshape(-1)
    t, r = np.empty((2, min(PIECE, len(flat))))
    for at in range(0, len(flat), PIECE):
        some = flat[at : at + PIECE]
        t, r = t[: len(some)], r[: len(some)]
        np.multiply(some, unit, out=t)
        np.rint(t, out=r)
        np.abs(np.subtract(t, r, out=t), out=t)
        if t.max() > 0.499999:
            for i in np.flatnonzero(t > 0.499999):
                r[i] = float(Decimal(repr(float(some[i]))).scaleb(places).quantize(Decimal(1), ROUND_HALF_UP))
        ends[at : at + PIECE] = r
    return out


def dealt(vectors: DataFrame, block: int | None = None) -> DataFrame:
    """``vectors(vec_id, ...)`` beside ``own, x, y, t``: a row for each pair of blocks ``x <= y`` that the vector takes part in, whose number is ``t``.
    Blocks are ranges of ids, so vectors of x come before those of y. The pairs of blocks are dealt out evenly, each as neighbouring rows."""
    spark, n = vectors.sparkSession, vectors.count()
    blocks = max(1, -(-n // block) if block else max(min(FEWEST, n // 64), -(-n // LARGEST)))
    edges = vectors.approxQuantile("vec_id", [i / blocks for i in range(1, blocks)], 1e-4) if n and blocks > 1 else []
    own = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("vec_id"))) if edges else F.lit(0)
    d = vectors.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")
    d = d.withColumn("t", F.expr("y * (y + 1) DIV 2 + x").cast("int"))
    parts = min(blocks * (blocks + 1) // 2, 3 * spark.sparkContext.defaultParallelism)
    return d.repartitionById(parts, "t").sortWithinPartitions("t")


def _meetings(batches):
    """The two blocks of each pair of blocks, one after the other: columns of x and of y, and whether they are the same block."""
    held, t = [], None

    def done():
        b = pa.Table.from_batches(held)
        v = b.column("v").combine_chunks()
        c = {k: b.column(k).to_numpy() for k in b.column_names if k != "v"} | {"v": v.flatten().to_numpy().reshape(b.num_rows, -1)}
        left = c["own"] == c["x"][0]
        right = c["own"] == c["y"][0]
        return {k: a[left] for k, a in c.items()}, {k: a[right] for k, a in c.items()}, c["x"][0] == c["y"][0]

    for batch in batches:
        at = batch.column("t").to_numpy()
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
            if len(part):
                if t is not None and at[part[0]] != t:
                    yield done()
                    held = []
                t = at[part[0]]
                held.append(batch.slice(part[0], len(part)))
    if held:
        yield done()


def _chunks(x: dict, y: dict, own: bool):
    """Rows of x of one key and label at a time beside all of y, by label: ``rows, columns of y, first and last column of the label, mask``
    (of the pairs with the smaller id in x; none if that is all)."""
    columns = np.argsort(y["label"], kind="stable")
    labels = y["label"][columns]
    order = np.lexsort((x["label"], x["key"]))
    cut = np.flatnonzero(np.diff(x["label"][order]) | np.diff(x["key"][order])) + 1
    step = max(1, CHUNK // max(1, len(columns)))
    for alike in np.split(order, cut):
        for rows in (alike[i : i + step] for i in range(0, len(alike), step)):
            lo, hi = np.searchsorted(labels, x["label"][rows[0]], "left"), np.searchsorted(labels, x["label"][rows[0]], "right")
            yield rows, columns, lo, hi, x["vec_id"][rows][:, None] < y["vec_id"][columns] if own else None


def _count(cells: dict, key: int, k: np.ndarray, which: int) -> None:
    """Adds how often each score of ``k`` occurs to the rows of counts of ``key``."""
    if not len(k):
        return
    lo, hi = int(k.min()) // ROW, int(k.max()) // ROW
    if (hi - lo + 1) * ROW <= min(SPAN, 16 * len(k)):
        n = np.bincount(k - lo * ROW, minlength=(hi - lo + 1) * ROW).reshape(-1, ROW)
        for i in np.flatnonzero(n.any(1)):
            cells.setdefault((key, lo + int(i)), np.zeros((2, ROW), np.int64))[which] += n[i]
        return
    values, n = np.unique(k, return_counts=True)
    for part in np.split(np.arange(len(values)), np.flatnonzero(np.diff(values // ROW)) + 1):
        r = int(values[part[0]]) // ROW
        cells.setdefault((key, r), np.zeros((2, ROW), np.int64))[which][values[part] - r * ROW] += n[part]


def least_gap(k: int) -> float:
    """The least gap (a double) that rounds to ``k`` millionths or more."""
    if k <= 0:
        return -math.inf
    g = (k - 0.5) / UNIT
    while whole(np.array([g]), 6)[0] >= k:
        g = math.nextafter(g, -math.inf)
    while whole(np.array([g]), 6)[0] < k:
        g = math.nextafter(g, math.inf)
    return g


def strata_of(edges: list[float], closed: bool) -> list[tuple[float, float]]:
    """Strata of rounded gaps as half-open ranges of gaps that aren't rounded: half open, the last closed; or all closed, so that gaps on an edge
    belong to both sides. Gaps beyond the edges belong to the outer strata."""

    def first(e: float, beyond: bool) -> float:
        k = round(e * UNIT)
        reached = lambda k: k / UNIT > e if beyond else k / UNIT >= e
        while reached(k):
            k -= 1
        while not reached(k):
            k += 1
        return least_gap(k)

    last = len(edges) - 2
    low = [-math.inf, *(first(e, False) for e in edges[1:-1])]
    return [(low[i], math.inf if i == last else first(edges[i + 1], True) if closed else low[i + 1]) for i in range(last + 1)]


def _packed(n: np.ndarray) -> bytes:
    return n.astype(np.min_scalar_type(int(n.max()))).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{len(b) // ROW}").astype(np.int64)


def _added(table: pa.Table) -> pa.Table:
    """One row of counts from all tasks, score by score."""
    p, q = (sum((_unpacked(b) for b in table.column(c).to_pylist()), np.zeros(ROW, np.int64)) for c in "pq")
    k = np.flatnonzero(p + q)
    n = len(k)
    return pa.table({"key": pa.array([table.column("key")[0].as_py()] * n, pa.int64()), "k": k + table.column("range")[0].as_py() * ROW, "p": p[k], "q": q[k]})


#: Columns of rows of counts.
ROWS = "key long, range long, p binary, q binary"


def tally(cells: dict, k: np.ndarray, which: int) -> None:
    """Counts the scores ``k`` in ``cells``, as pairs of one label (0) or others (1)."""
    _count(cells, 0, k, which)


def handed(cells: dict):
    """The rows of counts that a task holds, which are emptied."""
    for i in range(0, len(cells), 256):
        some = list(cells.items())[i : i + 256]
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for (k, _), _ in some], pa.int64()), "range": pa.array([r for (_, r), _ in some], pa.int64()), "p": pa.array([_packed(n[0]) for _, n in some], pa.binary()), "q": pa.array([_packed(n[1]) for _, n in some], pa.binary())})
    cells.clear()


def added(c: DataFrame, places: int) -> DataFrame:
    """``key, score, same, n`` from the rows of counts of all tasks."""
    c = c.groupBy("key", "range").applyInArrow(_added, "key long, k long, p long, q long")
    each = F.explode(F.array(F.struct(F.lit(True).alias("same"), F.col("p").alias("n")), F.struct(F.lit(False).alias("same"), F.col("q").alias("n")))).alias("c")
    return c.select("key", (F.col("k") / F.lit(10.0**places)).alias("score"), each).select("key", "score", "c.same", "c.n").where("n > 0")


def _stratified(places: int, strata: list[tuple[float, float]]):
    """Counts of pairs by stratum. Both blocks are put in the order of the first component, so most squares of pairs lie in one or two strata."""
    ahead = PLACES // 2

    def go(batches):
        cells: dict = {}
        tables: dict = {}
        n = 0

        def told():
            yield from handed(cells)
            for s, table in tables.items():
                t = table.reshape(2, -1, ROW)
                for i in np.flatnonzero(t.any((0, 2))):
                    cells[s, int(i) - ahead // ROW] = t[:, i]
                    if len(cells) >= 256:
                        yield from handed(cells)
                yield from handed(cells)
            tables.clear()

        for x, y, own in _meetings(batches):
            (v, f, label), (w, g, other) = ((b["v"][o], b["v"][o, 0], b["label"][o]) for b in (x, y) for o in (np.argsort(b["v"][:, 0], kind="stable"),))
            if not len(v) or not len(w):
                continue
            near = np.sqrt((v * v).sum(1).max() * (w * w).sum(1).max()) * 10.0**places + 2 < ahead  # scores have places in a table
            for i in range(0, len(v), SQUARE):
                a = slice(i, i + SQUARE)
                for j in range(i if own else 0, len(w), SQUARE):
                    b = slice(j, j + SQUARE)
                    k = whole(v[a] @ w[b].T, places)
                    differ = label[a][:, None] != other[b]
                    pairs = np.triu(np.ones(k.shape, bool), 1) if own and i == j else None  # each once
                    least, most = max(0.0, g[b][0] - f[a][-1], f[a][0] - g[b][-1]), max(g[b][-1] - f[a][0], f[a][-1] - g[b][0])
                    inside = [s for s, (low, high) in enumerate(strata) if low <= most and least < high]
                    gap = None
                    if near:
                        k += np.where(differ, PLACES + ahead, ahead)
                    for s in inside:
                        low, high = strata[s]
                        keep = pairs
                        if least < low or most >= high:
                            gap = np.abs(f[a][:, None] - g[b]) if gap is None else gap
                            keep = (gap >= low) & (gap < high)
                            keep = keep if pairs is None else keep & pairs
                        some = k.ravel() if keep is None else k[keep]
                        if near:
                            if n + len(some) > MOST:
                                yield from told()
                                n = 0
                            n += len(some)
                            if s not in tables:
                                tables[s] = np.zeros(2 * PLACES, np.uint32)
                            np.add.at(tables[s], some, np.uint32(1))
                        else:
                            d = differ.ravel() if keep is None else differ[keep]
                            _count(cells, s, some[~d], 0)
                            _count(cells, s, some[d], 1)
                    if len(cells) > HELD:
                        yield from handed(cells)
        yield from told()

    return go


def gap_percentiles(vectors: DataFrame, shares: list[float]) -> list[float]:
    """Interpolated percentiles of the gaps (six places) of all pairs of ``vectors(v)``. No pair is formed: among the first components in order, pairs
    with a gap below a bound are counted by the place of the bound, and the bounds of all shares are closed in on together. A task reads all first
    components (8 bytes each) and counts for its share of them."""
    spark, first = vectors.sparkSession, F.get("v", F.lit(0))
    n, least, most = vectors.agg(F.count("*"), F.min(first), F.max(first)).first()
    total = n * (n - 1) // 2
    if not total:
        return []
    parts = max(1, min(3 * spark.sparkContext.defaultParallelism, n // 4096))

    def packed(batches):
        yield from (pa.RecordBatch.from_pydict({"x": pa.array([b.column("x").to_numpy().tobytes()], pa.binary())}) for b in batches if b.num_rows)

    def below(bounds: list[float]):
        def go(batches):
            held: dict = {}
            for batch in batches:
                for t, x in zip(batch.column("t").to_pylist(), batch.column("x").to_pylist(), strict=True):
                    held.setdefault(t, []).append(np.frombuffer(x))
            for t, some in held.items():
                x = np.sort(np.concatenate(some))
                at = np.arange(n * t // parts, n * (t + 1) // parts)
                yield pa.RecordBatch.from_pydict({"n": [[int((_first_beyond(x, at, g) - at - 1).sum()) for g in bounds]]})

        return go

    d = vectors.select(first.alias("x")).mapInArrow(packed, "x binary").select("x", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("t"))
    d = d.repartitionById(parts, "t").persist()
    ends = sorted({f((total - 1) * p) for p in shares for f in (math.floor, math.ceil)})
    found = {e: (-1, int(whole(np.array([most - least]), 6)[0])) for e in ends}  # beyond the first, at most the second
    while any(b - a > 1 for a, b in found.values()):
        tried = sorted({a + max(1, (b - a) * i // 16) for a, b in found.values() for i in range(1, 16) if b - a > 1})
        counts = dict(zip(tried, np.array([r["n"] for r in d.mapInArrow(below([least_gap(k + 1) for k in tried]), "n array<long>").collect()]).sum(0).tolist(), strict=True))  # a row for each task
        found = {e: (max([a, *(k for k in tried if counts[k] <= e)]), min([b, *(k for k in tried if counts[k] > e)])) for e, (a, b) in found.items()}
    d.unpersist()
    of = {e: k / UNIT for e, (_, k) in found.items()}
    return between(of, [(total - 1) * p for p in shares])


def between(of: dict[int, float], at: list[float]) -> list[float]:
    """Values at places that need not be whole, from those at whole places."""
    low, high = [of[math.floor(p)] for p in at], [of[math.ceil(p)] for p in at]
    return [a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b for p, a, b in zip(at, low, high, strict=True)]


def _first_beyond(x: np.ndarray, at: np.ndarray, gap: float) -> np.ndarray:
    """For each place of the sorted ``x`` the first whose distance, as a double, is ``gap`` or more."""
    a, slack = x[at], 4 * np.spacing(max(abs(x[0]), abs(x[-1]), gap))
    low, high = np.searchsorted(x, a + (gap - slack)), np.searchsorted(x, a + (gap + slack))
    while (todo := np.flatnonzero(low < high)).size:
        mid = (low[todo] + high[todo]) // 2
        far = x[mid] - a[todo] >= gap
        high[todo], low[todo] = np.where(far, mid, high[todo]), np.where(far, low[todo], mid + 1)
    return np.maximum(low, at + 1)


def score_counts(vectors: DataFrame, places: int, of: str = "dot", edges: list[float] | None = None, closed: bool = False, block: int | None = None) -> DataFrame:
    """``key, score, same, n``: how many pairs a < b of ``vectors(vec_id, label, v, key)`` have the product (``of`` gap: the distance of the
    first components) that rounds to the score, apart for pairs of one label and others; ``key`` (a whole number) is that of a.

    With ``edges`` the key is a stratum of the pair's gap (six places) instead, as :func:`.strata.deciles` has them. No pair leaves the task that
    forms it: tasks hand on counts by score, whose number the places bound. Ids and labels are numbers, none is null."""

    def counts(batches):
        cells: dict = {}

        for x, y, own in _meetings(batches):
            for rows, columns, lo, hi, mask in _chunks(x, y, own):
                k = whole(np.abs(x["v"][rows, 0][:, None] - y["v"][columns, 0]) if of == "gap" else x["v"][rows] @ y["v"][columns].T, places)
                for at, which in (((slice(None), slice(lo, hi)), 0), ((slice(None), slice(0, lo)), 1), ((slice(None), slice(hi, None)), 1)):
                    _count(cells, int(x["key"][rows[0]]), k[at].ravel() if mask is None else k[at][mask[at]], which)
                if len(cells) > HELD:
                    yield from handed(cells)
        yield from handed(cells)

    how = counts if edges is None else _stratified(places, strata_of(edges, closed))
    c = dealt(vectors.select("vec_id", "label", "v", F.col("key").cast("long").alias("key")), block).mapInArrow(how, ROWS)
    return added(c, places)


def row_counts(vectors: DataFrame, places: int, block: int | None = None) -> DataFrame:
    """``vec_id, label, same, n, total, most``: of each vector's pairs with later ids their number, the sum of their rounded products and the
    greatest, apart for one label and others. A task hands on one row for each vector of a block that meets another."""

    def sums(batches):
        for x, y, own in _meetings(batches):
            for rows, columns, lo, hi, mask in _chunks(x, y, own):
                k = whole(x["v"][rows] @ y["v"][columns].T, places)
                here = np.ones(k.shape, bool) if mask is None else mask
                alike = np.zeros(k.shape[1], bool)
                alike[lo:hi] = True
                for same in (True, False):
                    m, some = here[:, alike == same], k[:, alike == same]
                    n = m.sum(1)
                    has = n > 0
                    if has.any():
                        top = np.where(m, some, np.iinfo(np.int64).min).max(1)
                        yield pa.RecordBatch.from_pydict({"vec_id": pa.array(x["vec_id"][rows][has], pa.int64()), "label": pa.array(x["label"][rows][has], pa.int64()), "same": pa.array([same] * int(has.sum())), "n": pa.array(n[has], pa.int64()), "total": pa.array(np.where(m, some, 0).sum(1)[has], pa.int64()), "most": pa.array(top[has], pa.int64())})

    r = dealt(vectors.select("vec_id", "label", "v", F.lit(0).cast("long").alias("key")), block).mapInArrow(sums, "vec_id long, label long, same boolean, n long, total long, most long")
    unit = F.lit(10.0**places)
    return r.groupBy("vec_id", "label", "same").agg(F.sum("n").alias("n"), (F.sum("total") / unit).alias("total"), (F.max("most") / unit).alias("most"))
