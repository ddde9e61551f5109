"""Suffix-array dedup: a logarithmic family of sorted suffix indexes finds every long repeated string.

What is removed: each byte covered by a ``length``-byte string that also starts anywhere else in the table.

How. A batch is what one task has read, up to ``BATCH`` entries. Its *suffix array* is sparse: it holds the
suffixes at the owners of the batch's windows (:mod:`.windows`), in the order of the digest of the string that
all windows of an owner share (the core), then of the digest of their whole extent (the block). Equal windows
have equal owners, so no repeat escapes. Arrays are cut by key range into shards; each shard keeps a family of
levels: a new batch's array is merge-scanned against every level, and two levels of equal rank merge into one of
the next rank. A suffix without a partner is done. If all partners share its block, its windows are all repeats.
Otherwise the windows are told apart one by one in a dense pass over those extents alone.

Within a batch equal suffixes become one entry before any shuffle, so a key has a row for each batch at most,
however hot it is. Digests have 64 bits for cores (only a filter) and core plus block, and 96 for a
window, where a match decides.

Cases: null text is empty; shorter texts keep everything; repeated rows are repeats of each other; ids may be
null or repeated; columns besides doc_id and text are ignored; an empty table gives no rows. Memory: about 80
bytes for each byte of the longest text, and a shard's entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import windows as K

LENGTH = 400
#: Entries of a batch: bounds a task's memory.
BATCH = 1_000_000
#: Entries that a shard is meant to hold, all batches together (about 40 bytes each).
SHARD = 4_000_000
CHUNK = 1 << 19
BYTE = np.random.default_rng(20240607).integers(0, 2**64, 256, np.uint64)
#: Status of an entry: no partner, all windows repeated, partners differ.
NONE, FULL, MIXED = 0, 1, 2


def _levels(data: np.ndarray, most: int) -> dict[int, np.ndarray]:
    h, m, out = BYTE[data], 1, {}
    while True:
        out[m] = h
        if 2 * m > most:
            return out
        h, m = K.double(h, m), 2 * m


def _span(levels: dict[int, np.ndarray], m: int, start: np.ndarray, size, most: int) -> np.ndarray:
    """Hash of [start, start + size), m <= size <= most, from hashes of m bytes that cover it."""
    out = np.full(len(start), size, np.uint64) if np.isscalar(size) else size.astype(np.uint64)
    for i in range(-(-most // m)):
        out = K.mix(out, levels[m][start + np.minimum(i * m, size - m)])
    return out


def _sizes(length: int) -> tuple[int, int, int]:
    """Owner range, core and the short strings among which owners are found."""
    w = max(1, length * 8 // 25)
    core = length - w + 1
    return w, core, 1 << min(4, core.bit_length() - 1)


def batch_array(core, block, rid, lo, run, batch: int) -> pa.RecordBatch:
    """A batch's suffix array, with equal suffixes as one entry that goes on to the shards (ship)."""
    order, new = K.groups(core, block)
    c, b = core[order], block[order]
    first = np.ones(len(c), bool)
    first[1:] = c[1:] != c[:-1]
    which = np.cumsum(first) - 1
    n, kinds = np.bincount(which), np.bincount(which, weights=new)
    status = np.where(kinds[which] > 1, MIXED, np.where(n[which] > 1, FULL, NONE)).astype(np.int8)
    return pa.record_batch([pa.array(first), pa.array(status), pa.array(np.full(len(c), batch)), pa.array(c.view(np.int64)), pa.array(b.view(np.int64)), pa.array(rid[order]), pa.array(lo[order].astype(np.int32)), pa.array(run[order].astype(np.int32))], ["ship", "status", "batch", "core", "block", "rid", "lo", "run"])


ENTRY = "ship boolean, status byte, batch long, core long, block long, rid long, lo int, run int"


def _index(length: int):
    w, core, gram = _sizes(length)
    m_core = 1 << (core.bit_length() - 1)
    m_block = 1 << (length.bit_length() - 1)

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in K.chunks(batch.column(1), CHUNK):
                if len(data) < length:
                    continue
                p = np.flatnonzero(K.left_over(offsets) >= length)
                if not len(p):
                    continue
                h = _levels(data, m_block)
                own = K.owners(h[gram], w)[p]
                first, last = K.runs(p, own)
                lo, hi, a = p[first], p[last], own[first]
                row = np.searchsorted(offsets, lo, "right") - 1
                block = _span(h, m_block, lo, hi - lo + length, length + w - 1)
                block = K.mix(block, (a - lo).astype(np.uint64))
                held.append((_span(h, m_core, a, core, core), block, rid[i:j][row], lo - offsets[row], hi - lo + 1))
                size += len(lo)
                if size >= BATCH:
                    yield batch_array(*(np.concatenate(x) for x in zip(*held, strict=True)), number)
                    number, held, size = number + 1, [], 0
        if held:
            yield batch_array(*(np.concatenate(x) for x in zip(*held, strict=True)), number)

    return run


class Family:
    """Levels of sorted suffix entries; level k stems from 2**k batches."""

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.status: list[np.ndarray] = []
        self.n = 0

    def add(self, core: np.ndarray, block: np.ndarray, status: np.ndarray) -> None:
        """core is sorted; status holds what the batch itself has found."""
        ids, status = np.arange(self.n, self.n + len(core)), status.copy()
        self.n += len(core)
        for _, c, b, old in self.levels:
            lo, hi = np.searchsorted(c, core, "left"), np.searchsorted(c, core, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            lo, hi = lo[hit], hi[hit]
            # entries of a core lie in the order of their blocks: the ends tell whether there is only one
            mixed = np.r_[0, np.cumsum(self._of(old) == MIXED)]
            alike = (b[lo] == block[hit]) & (b[hi - 1] == block[hit]) & (status[hit] != MIXED) & (mixed[hi] == mixed[lo])
            marks = np.zeros(len(c) + 1, np.int64)
            np.add.at(marks, lo, 1)
            np.add.at(marks, hi, -1)
            met = np.cumsum(marks[:-1]) > 0
            marks[:] = 0
            np.add.at(marks, lo[~alike], 1)
            np.add.at(marks, hi[~alike], -1)
            apart = np.cumsum(marks[:-1]) > 0
            status[hit] = np.maximum(status[hit], np.where(alike, FULL, MIXED))
            self._raise(old[met & ~apart], FULL)
            self._raise(old[apart], MIXED)
        self.status.append(status)
        self.levels.append((0, core, block, ids))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (k, *a), (_, *b) = self.levels.pop(), self.levels.pop()
            c, bl, i = (np.concatenate(x) for x in zip(b, a, strict=True))
            order = np.lexsort((bl, c))
            self.levels.append((k + 1, c[order], bl[order], i[order]))

    def _flat(self) -> np.ndarray:
        if len(self.status) > 1:
            self.status = [np.concatenate(self.status)]
        return self.status[0]

    def _of(self, ids: np.ndarray) -> np.ndarray:
        return self._flat()[ids]

    def _raise(self, ids: np.ndarray, to: int) -> None:
        if len(ids):
            flat = self._flat()
            flat[ids] = np.maximum(flat[ids], to)


def _shard(batches):
    """Rows lie by batch, then core and block: each batch's array joins the family in turn."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    batch, core, block, status = (t.column(k).to_numpy() for k in ("batch", "core", "block", "status"))
    family, cut = Family(), np.r_[0, np.flatnonzero(batch[1:] != batch[:-1]) + 1, len(batch)]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        family.add(core[i:j], block[i:j], status[i:j].astype(np.int8))
    found = family._flat()
    keep = np.flatnonzero(found > NONE)
    yield from t.select(["rid", "lo", "run"]).take(pa.array(keep)).append_column("status", pa.array(found[keep])).to_batches()


def _dense(length: int):
    m = 1 << (length.bit_length() - 1)
    small = max(1, m // 4)

    def out(held):
        h, g, rid, p = (np.concatenate(x) for x in zip(*held, strict=True))
        order, new = K.groups(h, g)
        which = np.cumsum(new) - 1
        n = np.bincount(which)
        h, g, rid, p = h[order], g[order], rid[order], p[order]
        alone = n[which] == 1
        # repeats within the batch are decided: runs of positions; one of each goes on for the other batches
        r, q = rid[~alone], p[~alone]
        o = np.lexsort((q, r))
        r, q = r[o], q[o]
        f = np.ones(len(r), bool)
        f[1:] = (r[1:] != r[:-1]) | (q[1:] != q[:-1] + 1)
        f = np.flatnonzero(f)
        e = np.r_[f[1:], len(r)] - 1 if len(f) else f
        s = np.flatnonzero(new)
        yield pa.record_batch([pa.array(np.zeros(len(f), bool)), pa.array(r[f]), pa.array(q[f]), pa.array(r[f]), pa.array(q[f].astype(np.int32)), pa.array((q[e] - q[f] + 1).astype(np.int32)), pa.array(np.ones(len(f), bool))], NAMES)
        yield pa.record_batch([pa.array(np.ones(len(s), bool)), pa.array(h[s].view(np.int64)), pa.array(g[s].view(np.int64)), pa.array(rid[s]), pa.array(p[s].astype(np.int32)), pa.array(np.ones(len(s), np.int32)), pa.array(~alone[s])], NAMES)

    NAMES = ["ship", "h", "g", "rid", "lo", "run", "known"]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            rid, asked = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for i, j, data, offsets in K.chunks(batch.column(1), CHUNK):
                part = asked.slice(i, j - i)
                row = np.repeat(np.arange(j - i), part.value_lengths().to_numpy(zero_copy_only=False))
                flat = part.flatten()
                lo, run = (flat.field(k).to_numpy().astype(np.int64) for k in ("lo", "run"))
                p = np.repeat(lo + offsets[row] - np.r_[0, np.cumsum(run)[:-1]], run) + np.arange(run.sum())
                h = _levels(data, m)
                row = np.repeat(row, run)
                held.append((_span(h, m, p, length, length), _span(h, small, p, length, length) >> np.uint64(32), rid[i:j][row], p - offsets[row]))
                size += len(p)
                if size >= BATCH:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            ids, texts, found = batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)
            kept, removed = [], []
            for i in range(batch.num_rows):
                text, runs = texts[i].as_py() or b"", found[i]
                s = []
                if runs.is_valid and len(runs):
                    lo, n = (runs.values.field(k).to_numpy().astype(np.int64) for k in ("lo", "run"))
                    o = np.argsort(lo, kind="stable")
                    for a, b in zip(lo[o].tolist(), (lo + n - 1 + length)[o].tolist(), strict=True):
                        if s and a <= s[-1][1]:
                            s[-1][1] = max(s[-1][1], b)
                        else:
                            s.append([a, b])
                    at, rest = 0, []
                    for a, b in s:
                        rest.append(text[at:a])
                        at = b
                    rest.append(text[at:])
                    text = b"".join(rest)
                removed.append([{"start": a, "end": b} for a, b in s])
                kept.append(text)
            yield pa.record_batch([ids, pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "kept", "spans"])

    return run


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document ``doc_id, n_bytes, kept`` (binary) and ``spans`` (removed byte ranges) for ``docs(doc_id, text)``."""
    if length < 2:
        raise ValueError("length must be at least 2")
    spark = docs.sparkSession
    d = C.keyed(docs)
    long = d.where(F.octet_length("text") >= length)
    entries = C.table(long.select("rid", "text").mapInArrow(_index(length), ENTRY), "suffixes")
    # shards follow the entries, so that a task's family stays within memory at any size
    n = max(C.parts(spark), -(-entries.where("ship").count() // SHARD))
    scanned = entries.where("ship").select("batch", "core", "block", "status", "rid", "lo", "run").repartition(n, "core").sortWithinPartitions("batch", "core", "block").mapInArrow(_shard, "rid long, lo int, run int, status byte")
    # repeats within a batch are sure, whatever its entry meets; if that is told apart, it stands for all of them
    local = entries.where(f"NOT ship OR status = {FULL}").select("rid", "lo", "run", "status")
    found = C.table(scanned.unionByName(local), "matches")
    C.drop(entries)
    del entries, scanned, local  # else their shuffles stay
    C.release(spark)

    asked = found.where(f"status = {MIXED}").groupBy("rid").agg(F.collect_list(F.struct("lo", "run")).alias("asked"))
    # the asked ranges go first and stay small: the join needs no copy of documents without any
    texts = long.select("rid", "text").join(asked, "rid").select("rid", "text", "asked")
    dense = texts.mapInArrow(_dense(length), "ship boolean, h long, g long, rid long, lo int, run int, known boolean")
    # one shuffle and no copy on disk: what is decided travels along under its own place as key; rows of a key: one for each batch
    dense = dense.repartition(n, "h").withColumn("c", F.count("*").over(Window.partitionBy("h", "g", "ship"))).where("NOT ship OR (c > 1 AND NOT known)")
    sure = found.where(f"status = {FULL}").select("rid", "lo", "run").unionByName(dense.select("rid", "lo", "run"))
    runs = C.table(sure.groupBy("rid").agg(F.collect_list(F.struct("lo", "run")).alias("runs")), "repeats")
    C.drop(found)
    del found, asked, texts, dense, sure
    C.release(spark)
    out = d.join(runs, "rid", "left").select("doc_id", "text", "runs").mapInArrow(_cut(length), "doc_id long, kept binary, spans array<struct<start:long,end:long>>")
    return out.withColumn("n_bytes", F.octet_length("kept").cast("long") + F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])).select("doc_id", "n_bytes", "kept", "spans")


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    r = suffix_array_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.octet_length("kept").cast("long")
    return r.select("doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), kept.alias("n_kept"), "spans")
