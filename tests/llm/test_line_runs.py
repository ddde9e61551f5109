import hashlib
import random

import xxhash

import brute
from siftgate.llm import line_dedup

EVERY = line_dedup.EVERY


def chunks(ls):
    """First and last line of each content-defined chunk, by the rule as it is stated."""
    r = []
    for a, b in zip(ls, ls[1:]):
        x = xxhash.xxh64_intdigest(b.encode(), seed=xxhash.xxh64_intdigest(a.encode(), seed=42))
        r.append(x - 2**64 if x >= 2**63 else x)
    opens = [i for i in range(len(r)) if i == 0 or r[i] % EVERY == 0 or i > 1 and (r[i - 2] >> 16) % EVERY == 0]
    closes = [i for i in range(len(r)) if i == len(r) - 1 or (r[i] >> 16) % EVERY == 0]
    for i in opens:
        if after := [e for e in closes if e >= i]:
            yield i, after[0] + 1


def kept(rows):
    """Plain version: ``doc_id``, lines, removed lines, removed stretches, digest of what is kept."""
    texts = [(d, brute.BIG if d is None else d, None if t is None else t.split("\n")) for d, t in rows]
    first, own = {}, []
    for r, (_, o, ls) in enumerate(texts):
        found = [(i, j, "\n".join(ls[i : j + 1])) for i, j in chunks(ls or [])]
        own.append([x for x in found if brute.words(x[2])])
        for i, j, body in own[-1]:
            first[body] = min(first.get(body, (o, r, i, j)), (o, r, i, j))
    for r, (d, _, ls) in enumerate(texts):
        gone = set()
        for i, j, body in own[r]:
            if first[body][1] != r or i > first[body][3]:
                gone |= set(range(i, j + 1))
        rest = "\n".join(x for i, x in enumerate(ls or ()) if i not in gone)
        yield d, len(ls or ()), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(rest.encode()).hexdigest()


def rows_of(r):
    return [(x.doc_id, 0 if x.text_before is None else x.text_before.count("\n") + 1, x.n_removed_lines, len(x.removed), hashlib.sha256((x.text or "").encode()).hexdigest()) for x in r.collect()]


def test_repeated_passages_lose_a_line_at_each_end_on_average(spark):
    """Passages of n lines between lines of each text's own: what goes lies within the passage, ends are left by the boundaries."""
    rows = []
    for n in (2, 4, 8, 16):
        for k in range(60):
            passage = [f"passage {n} {k} line {i}" for i in range(n)]
            rows += [(len(rows) + j, "\n".join([f"own {n} {k} {j} a", f"own {n} {k} {j} b", *passage, f"own {n} {k} {j} c", f"own {n} {k} {j} d"])) for j in (0, 1)]
    r = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.text.count("own") == 4 for x in r)
    assert all(x.n_removed_lines == 0 for x in r if x.doc_id % 2 == 0)
    for i, (n, least) in enumerate(((2, 0.1), (4, 0.4), (8, 0.7), (16, 0.85))):
        got = sum(x.n_removed_lines for x in r if i * 120 <= x.doc_id < (i + 1) * 120) / (60 * n)
        assert least <= got <= 1, (n, got)


def test_chunks_are_content_defined_and_of_several_lines(spark, sf):
    """Three lines on average in long texts; boundaries within a passage don't move with what stands around it."""
    text = [f"line {i}" for i in range(3000)]
    sizes = [j - i + 1 for i, j in chunks(text)]
    assert 2.8 < sum(sizes) / len(sizes) < 3.2 and max(sizes) > 6 and sizes.count(2) < 0.6 * len(sizes)
    inner = {(i, j) for i, j in chunks(text) if 100 < i and j < 2900}
    assert inner == {(i - 7, j - 7) for i, j in chunks([f"before {i}" for i in range(7)] + text + ["behind"]) if 107 < i and j < 2907}
    found = line_dedup.line_dedup(spark.createDataFrame([(0, "\n".join(text)), (1, "\n".join(["own", *text, "own too"]))], "doc_id long, text string")).where("doc_id = 1").first()
    assert found.n_removed_lines > 2990


def test_line_dedup_equals_plain_chunks(spark, monkeypatch):
    rnd = random.Random(11)
    rows = [(i * 7 % 61, "\n".join(rnd.choice(["a", "b", "c d", "e", "", " ", f"u{rnd.random()}"]) for _ in range(rnd.randrange(0, 12)))) for i in range(61)]
    rows += [(100, "x\nx\nx"), (101, "y\ny\ny\ny\ny"), (102, None), (103, ""), (104, "\n\n"), (105, "\n\n"), (106, "p\nq\n"), (107, "p\nq\n"), (None, "p\nq\nr"), (108, "q\nr")]
    rows += [(200, "\n".join(f"long line {i % 700}" for i in range(5000))), (201, "w " * 300_000 + "\nsecond\nthird"), (202, "second\nthird")]
    r = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert brute.order(rows_of(r)) == brute.order(kept(rows))


def test_op5_equals_plain_chunks(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert brute.order(line_dedup.op5_line_dedup(spark, sf).collect()) == brute.order(kept(rows))


def test_unequal_texts_of_equal_hash_stay(spark, monkeypatch):
    """With a hash that is the same for all chunks, bytes alone decide."""
    monkeypatch.setattr(line_dedup, "CHUNKS", line_dedup.CHUNKS.replace("xxhash64(c.body)", "7L"))
    rows = [(i, f"a{i % 3}\nb{i % 3}") for i in range(9)]
    r = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: x.text for x in r.collect()} == {i: rows[i][1] if i < 3 else "" for i in range(9)}
