"""Substring dedup by level-wise doubling over words.

What is removed: each word covered by a window of ``window`` words whose word sequence also starts in a
document with a smaller doc_id (a null id counts as the largest).

How. The lengths are window, half of it (rounded up), and so on down to ``LEAST`` words or fewer: 7 and 13 as registered (a third length, 4, took more memory than one executor may have where phrases are very common). At the shortest
length only the owner string of each window is looked up (see :mod:`.windows`), a fraction of all positions;
windows whose string occurs once are done. Those that are left are tested at twice the length, until the window
itself is reached or no candidates survive. Longer lengths could not change what is removed.

At each level a batch (what a task has read, up to ``BATCH`` strings) settles its own repeats and sends one row
for each string, so no key has more rows than there are batches. Strings are told by digests of 96 bits.

Cases: null text has no words; fewer words than the window keep everything; repeated rows with one id leave each
other alone; ids may be null or repeated; columns besides doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import windows as K

WINDOW = 13
#: Lengths are halved as long as they exceed this.
LEAST = 8
BATCH = 1_000_000
CHUNK = 1 << 19
BYTE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
ODD = np.uint64(0x9FB21C651E98DF25)
ODD_INVERSE = np.uint64(pow(int(ODD), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LAST = np.iinfo(np.int64).max
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK + 1, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x)]) for x in (ODD, ODD_INVERSE))
    return _powers[size]


def word_hashes(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the documents in ``data``, and where each document's words begin. ``outside``: the bytes between words."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~outside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _pow(n)
    total = np.r_[np.uint64(0), np.cumsum(BYTE[data] * power[:n])]
    return K.mix((total[e] - total[s]) * inverse[s], (e - s).astype(np.uint64)), np.searchsorted(s, offsets)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    m = 1
    while 2 * m <= size:
        h, m = K.double(h, m), 2 * m
    rest = size - m
    return K.mix(h[: max(0, len(h) - rest)], h[rest:] + np.uint64(size)) if rest else h


def check_grams(h: np.ndarray, size: int) -> np.ndarray:
    """A second hash, by another rule."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= ODD
        out += h[i : i + n] ^ (h[i : i + n] >> np.uint64(17))
    return out


def lengths(window: int) -> list[int]:
    out = [window]
    while out[0] > LEAST:
        out.insert(0, -(-out[0] // 2))
    return out


ENTRY = "ship boolean, known boolean, h long, rid long, lo int, run int"


def _first(window: int, size: int):
    """Owners among the strings of ``size`` words; equal ones within a batch are known to be repeated."""
    w = window - size + 1
    names = ["ship", "known", "h", "rid", "lo", "run"]

    def out(held):
        h, rid, lo, run = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, rid, lo, run = h[order], rid[order], lo[order], run[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        known = (np.bincount(which := np.cumsum(first) - 1) > 1)[which]
        return pa.record_batch([pa.array(first), pa.array(known), pa.array(h.view(np.int64)), pa.array(rid), pa.array(lo.astype(np.int32)), pa.array(run.astype(np.int32))], names)

    def go(batches):
        held, n = [], 0
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in K.chunks(batch.column(1), CHUNK):
                h, at = word_hashes(data, offsets)
                if len(h) < window:
                    continue
                p = np.flatnonzero(K.left_over(at) >= window)
                if not len(p):
                    continue
                g = grams(h, size)
                own = K.owners(g, w)[p]
                a, b = K.runs(p, own)
                row = np.searchsorted(at, p[a], "right") - 1
                held.append((g[own[a]], rid[i:j][row], p[a] - at[row], p[b] - p[a] + 1))
                n += len(a)
                if n >= BATCH:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    return go


DENSE = "ship boolean, h long, g long, doc_id long, known boolean, rid long, lo int, run int, more array<struct<rid:long,lo:int>>"


def _next(size: int, last: bool):
    """Strings of ``size`` words at the asked positions. last: only those of a smaller id count."""
    names = ["ship", "h", "g", "doc_id", "known", "rid", "lo", "run", "more"]
    pair = pa.list_(pa.struct([("rid", pa.int64()), ("lo", pa.int32())]))

    def out(held):
        h, g, doc, rid, p = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((p, rid, doc, g, h))
        h, g, doc, rid, p = h[order], g[order], doc[order], rid[order], p[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        at, which = np.flatnonzero(new), np.cumsum(new) - 1
        if last:
            known = doc > doc[at][which]
        else:
            known = (np.bincount(which) > 1)[which]
        r, q = rid[known], p[known]
        o = np.lexsort((q, r))
        r, q = r[o], q[o]
        f = np.ones(len(r), bool)
        f[1:] = (r[1:] != r[:-1]) | (q[1:] != q[:-1] + 1)
        f = np.flatnonzero(f)
        e = np.r_[f[1:], len(r)] - 1 if len(f) else f
        none = len(f)
        yield pa.record_batch([pa.array(np.zeros(none, bool)), pa.array(r[f]), pa.array(q[f]), pa.array(np.zeros(none, np.int64)), pa.array(np.ones(none, bool)), pa.array(r[f]), pa.array(q[f].astype(np.int32)), pa.array((q[e] - q[f] + 1).astype(np.int32)), pa.nulls(none, pair)], names)
        # one row for each string; what is as open as its first place travels along
        rest = np.flatnonzero(~known & ~new)
        n = np.bincount(which[rest], minlength=len(at))
        offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        more = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(rid[rest]), pa.array(p[rest].astype(np.int32))], ["rid", "lo"]))
        yield pa.record_batch([pa.array(np.ones(len(at), bool)), pa.array(h[at].view(np.int64)), pa.array(g[at].view(np.int64)), pa.array(doc[at]), pa.array(known[at]), pa.array(rid[at]), pa.array(p[at].astype(np.int32)), pa.array(np.ones(len(at), np.int32)), more.cast(pair)], names)

    def go(batches):
        held, n = [], 0
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            doc = batch.column(1).fill_null(LAST).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in K.chunks(batch.column(2), CHUNK):
                h, at = word_hashes(data, offsets)
                asked = batch.column(3).slice(i, j - i)
                row = np.repeat(np.arange(j - i), asked.value_lengths().to_numpy(zero_copy_only=False))
                flat = asked.flatten()
                lo, run = (flat.field(k).to_numpy().astype(np.int64) for k in ("lo", "run"))
                p = np.repeat(lo + at[row] - np.r_[0, np.cumsum(run)[:-1]], run) + np.arange(run.sum())
                row = np.repeat(row, run)
                held.append((grams(h, size)[p], check_grams(h, size)[p] >> np.uint64(32), doc[i:j][row], rid[i:j][row], p - at[row]))
                n += len(p)
                if n >= BATCH:
                    yield from out(held)
                    held, n = [], 0
        if held:
            yield from out(held)

    return go


def _cut(window: int):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def go(batches):
        for batch in batches:
            texts, found = batch.column(1).cast(pa.binary()), batch.column(2)
            n, kept, removed = [], [], []
            for i in range(batch.num_rows):
                words, cut, runs = (texts[i].as_py() or b"").split(), [], found[i]
                n.append(len(words))
                if runs.is_valid and len(runs):
                    lo, run = (runs.values.field(k).to_numpy().astype(np.int64) for k in ("lo", "run"))
                    o = np.argsort(lo, kind="stable")
                    for a, b in zip(lo[o].tolist(), (lo + run - 1 + window)[o].tolist(), strict=True):
                        if cut and a <= cut[-1][1]:
                            cut[-1][1] = max(cut[-1][1], b)
                        else:
                            cut.append([a, b])
                    at, rest = 0, []
                    for a, b in cut:
                        rest += words[at:a]
                        at = b
                    words = rest + words[at:]
                kept.append(b" ".join(words))
                removed.append([{"start": a, "end": b} for a, b in cut])
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, spans)], ["doc_id", "n_words", "kept", "spans"])

    return go


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document ``doc_id, n_words, kept`` (binary, words joined by a blank) and ``spans`` (removed word ranges)."""
    if window < 2:
        raise ValueError("window must be at least 2")
    n = C.parts(docs.sparkSession)
    d = C.keyed(docs)
    long = d.where(F.octet_length("text") >= 2 * window - 1)
    steps = lengths(window)
    entries = C.table(long.select("rid", "text").mapInArrow(_first(window, steps[0]), ENTRY), "owners")
    met = entries.where("ship").repartition(n, "h").withColumn("c", F.count("*").over(Window.partitionBy("h"))).where("c > 1 OR known")
    alive = C.table(met.select("rid", "lo", "run").unionByName(entries.where("NOT ship").select("rid", "lo", "run")), "alive")
    C.drop(entries)
    del entries, met  # else their shuffles stay
    C.release(docs.sparkSession)
    for size in [x for x in steps[1:]] or steps:
        last = size == window
        asked = alive.groupBy("rid").agg(F.collect_list(F.struct("lo", "run")).alias("asked"))
        dense = long.join(asked, "rid").select("rid", "doc_id", "text", "asked").mapInArrow(_next(size, last), DENSE)
        # one shuffle and no copy on disk: what is decided travels along under its own place as key
        each = Window.partitionBy("h", "g", "ship")
        dense = dense.repartition(n, "h")
        if last:
            dense = dense.withColumn("least", F.min("doc_id").over(each)).where("NOT ship OR doc_id > least")
        else:
            dense = dense.withColumn("c", F.count("*").over(each)).where("NOT ship OR (c > 1 AND NOT known)")
        first = F.array(F.struct("rid", "lo", "run"))
        places = F.when(F.col("more").isNull(), first).otherwise(F.concat(first, F.transform("more", lambda x: F.struct(x["rid"].alias("rid"), x["lo"].alias("lo"), F.lit(1).alias("run")))))
        found = C.table(dense.select(F.explode(places).alias("x")).select("x.*"), "alive")
        C.drop(alive)
        alive = found
        del asked, dense, found
        C.release(docs.sparkSession)
        if not last and alive.isEmpty():
            break
    runs = alive.groupBy("rid").agg(F.collect_list(F.struct("lo", "run")).alias("runs"))
    return d.join(runs, "rid", "left").select("doc_id", "text", "runs").mapInArrow(_cut(window), "doc_id long, n_words long, kept binary, spans array<struct<start:long,end:long>>")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    r = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return r.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), "spans")
