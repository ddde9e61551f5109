"""Media columns: texts as lossless 8-bit grey PNG images in a binary column, read back and fingerprinted.

The writer makes the signature, IHDR, IDAT (zlib over filtered rows) and IEND, each with its CRC. The reader walks the
chunks, tests every CRC, inflates IDAT and undoes all five row filters with numpy. The fingerprint: area means on
a 32 x 32 grid, its cosine transform, the 8 x 8 lowest frequencies, one bit each for being above their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 576
PAD = 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRID, LOW = 32, 8
_k = np.arange(GRID)
COSINE = np.cos(np.pi / GRID * (_k[None, :] + 0.5) * _k[:LOW, None]) * np.sqrt(np.where(_k[:LOW, None] == 0, 1, 2) / GRID)


class BrokenImage(ValueError):
    """The bytes aren't an image that this module can read."""


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray, level: int = 1) -> bytes:
    """PNG of a uint8 array (rows, columns); each row takes the filter none, sub or up with the least sum."""
    rows, width = pixels.shape
    sub, up = pixels.copy(), pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    up[1:] -= pixels[:-1]
    three = np.stack([pixels, sub, up])
    cost = np.minimum(three, 0 - three).sum(2, dtype=np.int64)
    best = cost.argmin(0)
    out = np.empty((rows, width + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = three[best, np.arange(rows)]
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + chunk(b"IEND", b"")


def unfilter(rows: np.ndarray) -> np.ndarray:
    """rows: filter type and filtered samples of each row."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    i, n = 0, len(rows)
    while i < n:
        kind = int(kinds[i])
        j = i + 1
        while j < n and kinds[j] == kind:
            j += 1
        if kind == 1:
            np.cumsum(out[i:j], axis=1, dtype=np.uint8, out=out[i:j])
        elif kind == 2:
            if i:
                out[i] += out[i - 1]
            np.cumsum(out[i:j], axis=0, dtype=np.uint8, out=out[i:j])
        elif kind in (3, 4):
            for r in range(i, j):
                above = out[r - 1].astype(int) if r else np.zeros(out.shape[1], int)
                a = c = 0
                for x in range(out.shape[1]):
                    b = int(above[x])
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        p = a + b - c
                        guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                    a, c = (int(out[r, x]) + guess) & 255, b
                    out[r, x] = a
        elif kind:
            raise BrokenImage(f"row filter {kind}")
        i = j
    return out


def decode(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG; :class:`BrokenImage` for anything else or a wrong checksum."""
    if data[:8] != SIGNATURE:
        raise BrokenImage("signature")
    at, head, body, over = 8, None, [], False
    while at < len(data) and not over:
        if at + 12 > len(data):
            raise BrokenImage("cut off")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(part) != n or at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(part, zlib.crc32(kind)):
            raise BrokenImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            over = True
        elif not kind[0] & 32:
            raise BrokenImage(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if not head or not over or head[2:] != (8, 0, 0, 0, 0):
        raise BrokenImage("header")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise BrokenImage("stream") from e
    if len(raw) != head[1] * (head[0] + 1):
        raise BrokenImage("size")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def fingerprint(pixels: np.ndarray) -> bytes:
    """64 bits of the low frequencies."""
    rows, width = pixels.shape
    # area means through sums over whole cells; an image with fewer rows than the grid repeats them
    total = np.zeros((rows + 1, width + 1), np.int64)
    np.cumsum(np.cumsum(pixels, 0, dtype=np.int64), 1, out=total[1:, 1:])
    edge = lambda n: (np.floor(np.arange(GRID) * n / GRID).astype(int), np.maximum(np.ceil((np.arange(GRID) + 1) * n / GRID).astype(int), 1))
    (r0, r1), (c0, c1) = edge(rows), edge(width)
    sums = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    low = (COSINE @ (sums / ((r1 - r0)[:, None] * (c1 - c0)[None, :])) @ COSINE.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _media(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        images, marks, n, payloads = [], [], [], []
        for i in range(batch.num_rows):
            data = texts[i].as_py() or b""
            whole = data + bytes([PAD]) * (-len(data) % WIDTH if data else WIDTH)
            images.append(encode(np.frombuffer(whole, np.uint8).reshape(-1, WIDTH)))
            back = decode(images[-1])
            marks.append(fingerprint(back))
            n.append(len(data))
            back = back.tobytes()
            payloads.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:])))
        size, sha, tail = zip(*payloads, strict=True) if payloads else ((), (), ())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(images, pa.binary()), pa.array(marks, pa.binary()), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64())], ["doc_id", "n_bytes", "image", "feature", "payload_bytes", "payload_sha256", "tail_crc32"])


def media_columns(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``image`` (PNG, binary), ``feature`` (64 bits, binary) and what was read back.

    Null texts are empty; an empty text is one row of padding. Equal texts give equal values; ids may be null or
    repeated; columns besides doc_id and text are ignored; an empty table gives no rows. No shuffle. Memory: a
    few copies of one text.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_media, "doc_id long, n_bytes long, image binary, feature binary, payload_bytes long, payload_sha256 string, tail_crc32 long")


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    m = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("image").cast("long").alias("media_bytes"), F.sha2("image", 256).alias("media_sha256"), F.lower(F.hex("feature")).alias("feature"))
