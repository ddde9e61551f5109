import hashlib
import random

import pytest

import brute
from siftgate.llm import line_dedup, minhash_dedup, substring_dedup, suffix_dedup

ODD = [(300, None), (301, ""), (302, "a" * 300), (303, " \n\t "), (None, "x y z " * 30), (None, "x y z " * 30), (5, "q" * 50), (5, "r s " * 40), (5, "r s " * 40)]


def sample(letters, blank=""):
    rnd = random.Random(len(letters))
    rows = [(i, blank.join(rnd.choice(letters) for _ in range(rnd.randrange(0, 200)))) for i in range(50)]
    rows += [(100 + i, rows[i * 3][1]) for i in range(10)] + [(200 + i, rows[i][1][:90] + blank + rows[i + 1][1]) for i in range(20)]
    return rows + ODD


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, 1, 2, None) for d, t in rows], "doc_id long, text string, rid int, h int, core string")


@pytest.mark.parametrize(("letters", "length"), [("ab", 20), ("abcdefghijklmnop \né", 5)])
def test_suffix_array_dedup(spark, monkeypatch, letters, length):
    monkeypatch.setattr(suffix_dedup, "BATCH", 500)
    rows = sample(letters)
    r = suffix_dedup.suffix_array_dedup(frame(spark, rows), length).selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept)", "cast(size(spans) as long)", "sha2(kept, 256)")
    assert brute.order(r.collect()) == brute.order(brute.op1(rows, length))


@pytest.mark.parametrize(("letters", "window"), [("ab", 20), ("abcdefghijkl", 3)])
def test_substring_dedup(spark, letters, window):
    rows = sample(letters, " ")
    r = substring_dedup.substring_dedup(frame(spark, rows), window).selectExpr("doc_id", "n_words", "aggregate(spans, 0L, (a, s) -> a + s.end - s.start)", "sha2(kept, 256)")
    assert brute.order(r.collect()) == brute.order(brute.op2(rows, window))


def test_contract_queries(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert brute.order(suffix_dedup.op1_suffix_array_dedup(spark, sf).drop("n_kept", "spans").collect()) == brute.order(brute.op1(rows, 400))
    assert brute.order(substring_dedup.op2_substring_dedup(spark, sf).drop("spans").collect()) == brute.order(brute.op2(rows, 13))
    assert brute.order(minhash_dedup.op8_minhash_dedup(spark, sf).collect()) == brute.order(brute.op8(rows))


def test_family_equals_plain_grouping():
    import numpy as np

    rnd = np.random.default_rng(3)
    core, block = rnd.integers(0, 40, 300).astype(np.int64), rnd.integers(0, 2, 300).astype(np.int64)
    family, ids = suffix_dedup.Family(), []
    for s in range(0, 300, 20):
        _, keep = np.unique(core[s : s + 20], return_index=True)  # a batch has each core once
        keep += s
        o = keep[np.lexsort((block[keep], core[keep]))]
        family.add(core[o], block[o], np.zeros(len(o), np.int8))
        ids.append(o)
    ids = np.concatenate(ids)
    for i, status in zip(ids, family._flat(), strict=True):
        same = [j for j in ids if core[j] == core[i]]
        assert status == (0 if len(same) == 1 else 1 if len({block[j] for j in same}) == 1 else 2)
    ranks = [x[0] for x in family.levels]
    assert ranks == sorted(set(ranks), reverse=True)


def near(n=40):
    rnd = random.Random(9)
    rows = []
    for g in range(8):
        base = [f"W{rnd.randrange(500)}" for _ in range(120)]
        for _ in range(n // 8):
            w = list(base)
            for _ in range(rnd.randrange(0, 6)):
                w[rnd.randrange(120)] = f"z{rnd.randrange(10**6)}"
            rows.append((len(rows) * 7 % 41 + 50 * g, " ".join(w)))
    return rows + [(1000, "one two"), (1001, "ONE two"), (1002, "one two three"), *ODD]


@pytest.mark.parametrize("percent", [85])
def test_minhash_dedup(spark, percent):
    rows = near()
    r = minhash_dedup.minhash_dedup(frame(spark, rows), percent=percent)
    assert brute.order(r.collect()) == brute.order(brute.op8(rows, percent))


def test_one_of_each_takes_one_row_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, "other words here are these five")]
    assert sorted(r.doc_id for r in minhash_dedup.one_of_each(frame(spark, rows)).collect()) == [1, 3, 4]


def cluster(n, seed, words=200, most=9):
    """``n`` near copies of one text, a few far ones that join them in a chain, and texts that merely share half of it."""
    rnd = random.Random(seed)
    base = [f"w{seed}{rnd.randrange(10**6)}" for _ in range(words)]
    rows = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(1, most)):
            w[rnd.randrange(words)] = f"z{rnd.randrange(10**6)}"
        rows.append(" ".join(w))
    for k in range(12):
        w = list(base)
        w[: 2 * k + 2] = [f"far{seed}{i}" for i in range(2 * k + 2)]
        rows.append(" ".join(w))
    return rows + [" ".join(base[: words // 2] + [f"own{rnd.randrange(10**6)}" for _ in range(words // 2)]) for _ in range(60)]


@pytest.mark.parametrize("percent", [80, 90])
def test_large_groups_equal_brute_force(spark, monkeypatch, percent):
    """Buckets far beyond the size that is paired out, with blocks so small that every kind of pair of blocks occurs."""
    monkeypatch.setattr(minhash_dedup, "BIG", 4)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    texts = cluster(150, 1) + cluster(40, 2, most=30)
    rows = [(i * 7919 % 10007, t) for i, t in enumerate(texts)]
    r = minhash_dedup.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)
    assert brute.order(r.collect()) == brute.order(brute.op8(rows, percent))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(minhash_dedup.components(links).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_line_dedup(spark):
    block = "\n".join(f"shared line {i} of the licence" for i in range(12))
    own = ["\n".join(f"doc {d} line {i}" for i in range(9)) for d in range(5)]
    rows = [(d, f"{own[d]}\n{block}\nend of {d}\nand {d}") for d in range(5)] + [(9, block), (10, None), (11, ""), (12, "\n\n\n"), (13, "\n\n\n"), (14, "single"), (15, "single"), (None, "null id\nfirst\n" + block), (3, f"{own[3]}\n{block}\nend of 3\nand 3")]
    df = frame(spark, rows)
    got = line_dedup.line_dedup(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].text == rows[0][1] and not by[0][0].removed
    assert by[10][0].text is None and by[11][0].text == "" and by[12][0].text == "\n\n\n" and by[15][0].text == "single"
    for d in (1, 2, 4):
        # at most lines beside a boundary that is missing at an end of the shared block stay
        assert sum("shared" in x for x in by[d][0].text.split("\n")) <= 2 and all(f"doc {d} line {i}" in by[d][0].text for i in range(9))
    # the second of two repeated rows loses all of its chunks
    assert sorted(len(r.text) > 100 for r in by[3]) == [False, True]
    again = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in line_dedup.line_dedup(df).collect()}
    assert again == {hashlib.sha256((r.text or "").encode()).hexdigest() for r in got}
    kept = line_dedup.dedup_documents(df.withColumn("n_chars", __import__("pyspark.sql.functions", fromlist=["x"]).length("text").cast("long")))
    assert kept.columns == [*df.columns, "n_chars"] and all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)


def test_line_dedup_is_native(spark, sf, capsys):
    line_dedup.op5_line_dedup(spark, sf).explain()
    assert "Python" not in capsys.readouterr().out


def test_empty_tables(spark):
    e = frame(spark, [])
    for f in (suffix_dedup.suffix_array_dedup, substring_dedup.substring_dedup, minhash_dedup.minhash_dedup, minhash_dedup.one_of_each, line_dedup.line_dedup, line_dedup.dedup_documents):
        assert f(e).collect() == []


def test_links_of_blocks_join_the_same_rows_as_all_links():
    import pyarrow as pa

    rnd = random.Random(4)
    sets = []
    for _ in range(200):
        b = rnd.randrange(4) * 1000
        s = {b + x for x in range(200)}
        for _ in range(rnd.randrange(45)):
            s.discard(b + rnd.randrange(200))
            s.add(10**6 + rnd.randrange(10**6))
        sets.append(s)
    own = [rnd.randrange(4) for _ in sets]

    def parts(links):
        name = list(range(len(sets)))
        for a, b in links:
            name = [name[a] if x == name[b] else x for x in name]
        return len(set(name))

    def near(a, b):
        both = len(sets[a] & sets[b])
        return 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)

    every = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if near(i, j)}
    got = set()
    for x in range(4):
        for y in range(x, 4):
            ids = [i for i in range(len(sets)) if own[i] in (x, y)]
            cols = {"c": ids, "own": [own[i] for i in ids], "x": [x] * len(ids), "y": [y] * len(ids), "known": ids, "shingles": pa.array([sorted(sets[i]) for i in ids], pa.list_(pa.int64()))}
            t = minhash_dedup._compare(80)(pa.table(cols))
            got |= {(min(p), max(p)) for p in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)}
    assert got <= every and parts(got) == parts(every)
    assert len(got) < len(every)  # not a forest of the whole: pairs of blocks don't know of each other
