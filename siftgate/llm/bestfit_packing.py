"""Best-fit packing by exact-complement hashing.

Lengths are whole numbers up to the capacity, so all that planning needs is how many pieces there are of each
length: a histogram of at most ``capacity`` rows, whatever the corpus. The plan opens a sequence with the longest
length left and looks for lengths that fill its gap exactly: one, a pair, a triple (through the sums of single
lengths and of pairs that are available), as often as the counts allow. Only where no combination fits, the
longest length that fits goes in (best fit) and the search starts over for the gap that remains. A plan is a
list of patterns with the number of times each is used.

Pieces then get a number within their length (counts per bucket, prefix sums, a rank inside the bucket), and a
number falls into a range of a pattern's slots: sequence and offset follow without any search.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 2048
END = 0
#: Words whose ids a worker remembers.
CACHE = 700_000
#: Buckets in which the pieces of a length are ranked.
BUCKETS = 1024


#: How a byte-level BPE of this family splits texts (a fixed value of the public format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(tokenizer_path: str):
    """A function from text to ids for a byte-level BPE file of the library tokenizers.

    Merging is left to tiktoken, with the vocabulary of that file: the ids are the same (tests compare them) at a third
    of the time. Any other kind of tokenizer is used as it is.
    """
    import json

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(x for x in range(256) if x not in set(plain))}
    split = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and not spec.get("normalizer"):
        import tiktoken

        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


class _Ids(dict):
    """Token ids of a stretch of text that starts with a blank, as little-endian 32-bit words.

    The pattern always splits before a blank that stands alone between two other characters, so such stretches
    are independent of each other.
    """

    def __init__(self, tokenizer_path: str):
        super().__init__()
        self.encode = encoder(tokenizer_path)

    def __missing__(self, stretch: str) -> bytes:
        out = np.array(self.encode(stretch), "<u4").tobytes()
        if len(self) < CACHE and len(stretch) < 32:
            self[stretch] = out
        return out


_touching = re.compile(r" \s|\s ").search


def stretches(text: str) -> list[str]:
    """Splits before each blank; a text with blanks next to other white space stays whole."""
    if _touching(text) or "\0" in text:
        return [text]
    return text.replace(" ", "\0 ").split("\0")


def _pieces(path: str, capacity: int):
    cache: list[_Ids] = []
    end = np.array([END], "<u4").tobytes()

    def go(batches):
        if not cache:
            cache.append(_Ids(path))
        ids = cache[0]
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            out = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                data = b"".join(map(ids.__getitem__, stretches(texts[i].as_py() or ""))) + end
                n = len(data) // 4
                first = n % capacity or capacity
                at = [0, *range(first, n + 1, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(memoryview(data)[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return go


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, descending) and how often each is used, from the number of pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        if not 0 < k <= capacity:
            raise ValueError(f"length {k} is not between 1 and {capacity}")
        left[k] = v
    out: list[tuple[tuple[int, ...], int]] = []

    def uses(pattern: list[int]) -> int:
        return min(int(left[x]) // pattern.count(x) for x in set(pattern))

    def fill(gap: int, taken: list[int]) -> list[int] | None:
        """One, two or three available lengths that sum to gap."""
        have = left.copy()
        for x in taken:
            have[x] -= 1
        if gap <= capacity and have[gap] > 0:
            return [gap]
        lens = np.flatnonzero(have[: gap + 1] > 0)
        if not len(lens):
            return None
        rest = gap - lens
        pair = lens[(have[rest] > np.where(rest == lens, 1, 0)) & (rest <= lens)]
        if len(pair):
            x = int(pair[np.argmax(np.minimum(have[pair], have[gap - pair]))])
            return [x, gap - x]
        for x in lens[::-1].tolist():
            have[x] -= 1
            r, two = gap - x, np.flatnonzero(have[: gap - x + 1] > 0)
            if len(two):
                other = r - two
                ok = two[(have[other] > np.where(other == two, 1, 0)) & (other <= two)]
                if len(ok):
                    y = int(ok[np.argmax(np.minimum(have[ok], have[r - ok]))])
                    return [x, y, r - y]
            have[x] += 1
        return None

    while (lens := np.flatnonzero(left)).size:
        pattern = [int(lens[-1])]
        while (gap := capacity - sum(pattern)) > 0:
            if more := fill(gap, pattern):
                pattern += more
                break
            have = left[: gap + 1].copy()
            for x in pattern:
                if x <= gap:
                    have[x] -= 1
            fits = np.flatnonzero(have > 0)
            if not fits.size:
                break
            pattern.append(int(fits[-1]))
        n = uses(pattern)
        for x in pattern:
            left[x] -= n
        out.append((tuple(sorted(pattern, reverse=True)), n))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, in order: first number of a range of its pieces, first sequence of the range, offset in it."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        at = 0
        for x in pattern:
            out.setdefault(x, []).append((used.get(x, 0), sequence, at))
            used[x] = used.get(x, 0) + n
            at += x
        sequence += n
    return out


def _place(table: dict[int, list[tuple[int, int, int]]]):
    starts = {k: [x[0] for x in v] for k, v in table.items()}

    def go(batches):
        for batch in batches:
            seq, off = [], []
            for x, n in zip(batch.column("length").to_pylist(), batch.column("number").to_pylist(), strict=True):
                first, sequence, at = table[x][bisect_right(starts[x], n) - 1]
                seq.append(sequence + n - first)
                off.append(at)
            yield pa.record_batch([*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return go


OUT = "doc_id long, piece int, start long, length long, ids_crc32 long"


def numbered(pieces: DataFrame) -> DataFrame:
    """``number``: 0, 1, ... within each length. Pieces of a hot length are ranked in many buckets."""
    p = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    counts = p.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("length", "bucket", before.alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    return p.withColumn("rank", rank).join(counts, ["length", "bucket"]).withColumn("number", F.col("base") + F.col("rank") - 1)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of ``docs(doc_id, text)``: ids (as a checksum), place in its document, sequence and offset there.

    A document is the ids of its text and one id 0; longer ones than the capacity are cut from the end, so that
    the first piece may be shorter. Null and empty texts are the id 0 alone. Repeated rows and ids are packed as
    often as they occur; null ids are kept; columns besides doc_id and text are ignored; an empty table gives no
    rows. The plan on the driver holds at most ``capacity`` counts and about as many patterns.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = C.table(base.mapInArrow(_pieces(str(tokenizer_path), capacity), OUT), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    return numbered(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(_place(table), OUT + ", sequence_id long, offset long")


def op4_bestfit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
