"""Draws and orders from md5, many at once: what a replicate needs is computed in the task that draws it, so no draw is shuffled.

``md5(seed|replicate|number)`` is one block of md5 for all of them; here it runs over arrays, equal to any SQL engine's. A task of
:func:`replicated` reads a few numbers of each unit (some 16 bytes), as a replicate draws from all of them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import order

#: Hashes computed at once.
WIDTH = 8192
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def letters(texts: list[str]) -> np.ndarray:
    """Texts of one length as rows of bytes."""
    return np.frombuffer("".join(texts).encode(), np.uint8).reshape(len(texts), -1)


def md5(heads: np.ndarray, tails: np.ndarray) -> list[np.ndarray]:
    """The digest of each head followed by each tail (rows of bytes, 55 at most together), as four big-endian words of shape (heads, tails)."""
    length = heads.shape[1] + tails.shape[1]
    if length > 55:
        raise ValueError("one block of md5 holds 55 bytes")

    def words(rows: np.ndarray, at: int) -> np.ndarray:
        full = np.zeros((len(rows), 64), np.uint8)
        full[:, at : at + rows.shape[1]] = rows
        return full.view("<u4").astype(np.uint32)

    x, y = words(heads, 0), words(tails, heads.shape[1])
    fixed = [0] * 16
    fixed[length // 4] |= 0x80 << (8 * (length % 4))
    fixed[14] |= 8 * length
    shape = (len(heads), len(tails))
    w = []
    for i in range(16):
        of_head, of_tail = 4 * i < heads.shape[1], 4 * i + 4 > heads.shape[1] and 4 * i < length
        w.append((x[:, i, None] if of_head else np.uint32(0)) | (y[None, :, i] if of_tail else np.uint32(0)) | np.uint32(fixed[i]))
    a, b, c, d = (np.full(shape, k, np.uint32) for k in _START)
    t = np.empty(shape, np.uint32)
    for i in range(64):
        turn, g = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif turn == 1:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif turn == 2:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        if np.ndim(w[g]):
            np.add(t, w[g], out=t)
            np.add(t, np.uint32(_K[i]), out=t)
        else:
            np.add(t, np.uint32((_K[i] + int(w[g])) & 0xFFFFFFFF), out=t)
        s = _TURNS[turn][i % 4]
        np.left_shift(t, np.uint32(s), out=a)
        np.right_shift(t, np.uint32(32 - s), out=t)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [(v + np.uint32(k)).byteswap() for v, k in zip((a, b, c, d), _START, strict=True)]


def _alike(numbers: range, most: int) -> Iterator[range]:
    """Neighbouring numbers with as many digits, ``most`` at once."""
    i = numbers.start
    while i < numbers.stop:
        end = min(numbers.stop, i + most, 10 ** len(str(i)))
        yield range(i, end)
        i = end


def places(seed: str, reps: range, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each replicate the places (from 0) of n draws with replacement out of n units, in the order of the draws."""
    slots = [(s, letters([str(i) for i in s])) for s in _alike(range(n), WIDTH)]
    for some in _alike(reps, max(1, WIDTH // max(1, n))):
        heads, out = letters([f"{seed}|{r}|" for r in some]), np.empty((len(some), n), np.int64)
        for s, tails in slots:
            out[:, s.start : s.stop] = np.floor(md5(heads, tails)[0] / 4294967296.0 * n)
        yield from zip(some, out, strict=True)


def blocks(batches, by: str):
    """The rows of each value of a sorted number column as one table."""
    held, t = [], None
    for batch in batches:
        at = batch.column(by).to_numpy()
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
            if len(part):
                if t is not None and at[part[0]] != t:
                    yield t, pa.Table.from_batches(held)
                    held = []
                t = at[part[0]]
                held.append(batch.slice(part[0], len(part)))
    if held:
        yield t, pa.Table.from_batches(held)


def replicated(units: DataFrame, unit: str, reps: int, seed: str, prepared: Callable, kinds: str) -> DataFrame:
    """``rep`` and the columns ``kinds`` for each replicate of as many draws with replacement as there are ``units`` (one row for each distinct
    number ``unit``): ``prepared`` takes their columns in the units' order and returns a function from the places drawn to a row."""
    units = units.persist()
    spark, n = units.sparkSession, units.count()
    parts = min(reps, 3 * spark.sparkContext.defaultParallelism)
    step = -(-reps // parts)
    names = [k.split()[0] for k in kinds.split(", ")]

    def go(batches):
        for t, rows in blocks(batches, "t"):
            rows = rows.sort_by("index")
            row = prepared({c: rows.column(c).to_numpy(zero_copy_only=False) for c in rows.column_names})
            mine = range(int(t) * step + 1, min(reps, int(t) * step + step) + 1)
            got = [(rep, *row(at)) for rep, at in places(seed, mine, n)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), *[pa.array([g[i + 1] for g in got], from_pandas=True).cast({"double": pa.float64(), "long": pa.int64()}[k.split()[1]]) for i, k in enumerate(kinds.split(", "))]], ["rep", *names])

    d = order.indexed(units, unit).drop(unit).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return d.repartitionById(parts, "t").sortWithinPartitions("t").mapInArrow(go, f"rep long, {kinds}")


def weighted(rows: DataFrame, unit: str, units: DataFrame, reps: int, seed: str, statistic: Callable, kinds: str) -> DataFrame:
    """``key, rep`` and the columns ``kinds`` for each ``key`` (a string) of ``rows(key, unit, ...)`` and each replicate of as many draws with
    replacement as there are ``units``; replicate 0 has all units once.

    A task has some replicates: it counts how often each draws each unit, once for all keys, whose rows then pass by one key after the other.
    ``statistic`` takes a key's rows and the draws of their units (rows x replicates), and returns a list of values for each column."""
    units = order.indexed(units.select(unit).distinct(), unit).persist()
    spark, n = units.sparkSession, units.count()
    parts = min(reps, 3 * spark.sparkContext.defaultParallelism)
    step = -(-reps // parts)
    names = [k.split()[0] for k in kinds.split(", ")]

    def go(batches):
        for t, some in tables(batches, "t"):
            mine = range(int(t) * step + 1, min(reps, int(t) * step + step) + 1)
            drawn = np.array([np.bincount(at, minlength=n) for _, at in places(seed, mine, n)], np.int32).reshape(len(mine), n).T
            known = [*mine]
            if t == 0:
                drawn, known = np.concatenate([np.ones((n, 1), np.int32), drawn], 1), [0, *known]
            for key, own in some:
                got = statistic(own, drawn[own.column("index").to_numpy()])
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(known)), pa.array(known, pa.int64()), *[pa.array(g) for g in got]], ["key", "rep", *names])

    d = rows.join(units, unit).drop(unit).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))))
    return d.repartitionById(max(parts, 1), "t").sortWithinPartitions("t", "key", "index").mapInArrow(go, f"key string, rep long, {kinds}")


def tables(batches, by: str):
    """Each value of a number column with its rows by ``key``, one table after the other; rows are sorted by both."""

    def pieces():
        for batch in batches:
            at, keys = batch.column(by).to_numpy(), batch.column("key").to_pylist()
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or at[i] != at[start] or keys[i] != keys[start]:
                    yield (int(at[start]), keys[start]), batch.slice(start, i - start)
                    start = i

    def keyed():
        for k, some in itertools.groupby(pieces(), key=lambda x: x[0]):
            yield k, pa.Table.from_batches([b for _, b in some])

    for t, some in itertools.groupby(keyed(), key=lambda x: x[0][0]):
        yield t, ((k, x) for (_, k), x in some)
