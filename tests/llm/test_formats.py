import io
import random
import zlib

import numpy as np
import pytest

from siftgate.llm import bestfit_packing, media_columns, warc


def test_png_round_trip_and_checksums():
    rnd = np.random.default_rng(1)
    for rows in (1, 2, 40):
        x = rnd.integers(0, 256, (rows, 576)).astype(np.uint8)
        data = media_columns.encode(x)
        assert (media_columns.decode(data) == x).all()
        broken = bytearray(data)
        broken[60] ^= 1
        with pytest.raises(media_columns.BrokenImage):
            media_columns.decode(bytes(broken))


def test_warc_stream_of_one_member():
    records = [warc.make_record(i, f"http://a/{i}", bytes([65 + i]) * i * 700, refers_to=3 if i == 2 else None) for i in range(4)]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    whole = z.compress(b"".join(records)) + z.flush()
    assert list(warc.split_records(warc.inflate(io.BytesIO(whole), 37))) == records
    with pytest.raises(warc.BrokenArchive):
        list(warc.split_records(warc.inflate(io.BytesIO(whole[:-9]), 37)))


def test_plan_uses_every_piece_once_and_fits():
    rnd = random.Random(2)
    counts = {}
    for _ in range(3000):
        n = rnd.choice([2048, rnd.randrange(1, 400), rnd.randrange(1, 2049)])
        counts[n] = counts.get(n, 0) + 1
    patterns = bestfit_packing.plan(counts)
    used = {}
    for p, n in patterns:
        assert sum(p) <= 2048
        for x in p:
            used[x] = used.get(x, 0) + n
    assert used == counts
    least = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert sum(n for _, n in patterns) <= least * 1.01 + 1
