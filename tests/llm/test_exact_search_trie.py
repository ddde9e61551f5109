"""Exact dedup, ranked search and the conversation trie against plain versions, with odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from siftgate.llm import exact_dedup, lexical_search, prefix_trie
from test_operators import ODD, documents, whole_rows

BIG = 2**63 - 1


# exact dedup


def plain_copies(rows):
    groups = defaultdict(list)
    for n, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), BIG if d is None else d, n, d))
    for text, g in groups.items():
        keep = min(g)
        for x in g:
            yield x[3], keep[3], len(g), x == keep, hashlib.sha256(text.encode()).hexdigest()


def copies(n):
    rnd = random.Random(n)
    rows = [(i, "".join(rnd.choice("ab \t\n\x0b\x0c\r") for _ in range(rnd.randrange(9)))) for i in range(n)]
    return rows + [(n + i, f"a text of its own, {i} é") for i in range(n)] + [(2 * n + i, "the same text" + " " * (i % 3)) for i in range(n)]


@pytest.mark.parametrize("slice_rows", [exact_dedup.SLICE, 150])
def test_exact_dedup_equals_brute_force(spark, slice_rows):
    rows = copies(200)
    got = exact_dedup.exact_dedup(documents(spark, rows, False).repartition(7), slice_rows)
    assert Counter(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == Counter(plain_copies(rows))


def test_a_hash_without_a_copy_is_told_apart_in_two_passes(spark):
    rows = exact_dedup.digests(exact_dedup.C.keyed(documents(spark, [(i, f"text {i // 2 if i < 100 else i}") for i in range(20_000)], False)))
    told = exact_dedup.marked(rows)
    assert told.count() == 20_000
    assert told.where("suspect AND doc_id < 100").count() == 100
    assert told.where("suspect AND doc_id >= 100").count() < 20_000 * 0.03


def test_exact_dedup_of_odd_rows(spark):
    docs = documents(spark, ODD)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.kept): r for r in got}
    assert {d for d in (1, 2, 3) if (d, True) in by} == {3}  # null, empty and white space are equal; the longest stays
    assert by[(1, False)].keep_id == 3 and by[(1, False)].group_size == 3
    assert by[(7, True)].group_size == 2 and (7, False) in by
    assert by[(None, True)].keep_id is None and (None, False) in by
    kept = exact_dedup.dedup_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    given = whole_rows(docs)
    assert all(r in given for r in whole_rows(kept))
    empty = docs.limit(0)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.dedup_documents(empty).count() == 0


# ranked search


def terms(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)


def plain_search(docs, items, top):
    have = [(d, n, Counter(terms(t))) for n, (d, t) in enumerate(docs)]
    have = [(d, n, c) for d, n, c in have if c]
    n_docs, total = len(have), sum(sum(c.values()) for _, _, c in have)
    df = Counter(x for _, _, c in have for x in c)
    for i, t in items:
        found = []
        for d, n, c in have:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(terms(t)) if x in c)
            if s > 0:
                found.append((-s, BIG if d is None else d, n, d))
        yield from ((i, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:top], 1))


def lexicon(n):
    """Common words, rare words and copies; some documents are long."""
    rnd = random.Random(5)
    some = lambda k: " ".join(f"w{int(rnd.paretovariate(0.7)) % 800}" for _ in range(k))
    docs = [(i, some(rnd.choice((3, 20, 60, 400)))) for i in range(n)]
    docs += [(n + i, docs[i % 5][1].upper() + "!") for i in range(80)]
    items = [(i, some(12)) for i in range(30)] + [(30 + i, docs[i][1]) for i in range(5)]
    return docs, items


@pytest.mark.parametrize("chunk", [2_000, lexical_search.CHUNK])
def test_search_equals_brute_force(spark, chunk):
    docs, items = lexicon(300)
    index = lexical_search.Index(documents(spark, docs), chunk)
    got = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"), top=7)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == sorted(plain_search(docs, items, 7))


def test_shards_with_a_proof_stay_at_their_tier(spark):
    docs, items = lexicon(300)
    docs += [(10_000 + i, "nothing in common " * 30) for i in range(200)]
    items = [(i, f"rare{i} common") for i in range(10)] + [(99, "w1")]
    docs += [(20_000 + i, f"rare{i} " * 5) for i in range(10) for _ in range(1)]
    index = lexical_search.Index(documents(spark, docs, False).repartition(1), 2_000)
    tiers = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"), top=1, proofs=True)
    n = Counter(r.tier for r in tiers.collect())
    assert n[1] > n[2] + n[3] > 0 and sum(n.values()) == index.shards.count() * len(items)
    got = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"), top=1)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == sorted(plain_search(docs, items, 1))


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    docs, items = lexicon(60)
    index = lexical_search.Index(documents(spark, docs, False))
    asked = spark.createDataFrame(items, "item_id long, text string")
    whole = whole_rows(lexical_search.search(index, asked))
    monkeypatch.setattr(lexical_search, "ITEMS", 4)
    assert whole_rows(lexical_search.search(index, asked)) == whole and whole


def test_search_of_odd_rows(spark):
    docs = documents(spark, [*ODD, (11, "Übung.übung 9z"), (12, "übung-9Z no")])
    items = [(1, None), (2, "!!"), (3, "übung"), (3, "No, ID: here"), (None, "9Z 9z"), (5, "absent")]
    asked = spark.createDataFrame([(*x, "own") for x in items], "item_id long, text string, score string")
    got = lexical_search.search(lexical_search.Index(docs), asked).select("item_id", "rank", "doc_id", "score").collect()
    plain = plain_search([*ODD, (11, "Übung.übung 9z"), (12, "übung-9Z no")], items, 50)
    assert Counter(map(tuple, got)) == Counter(plain)
    assert lexical_search.search(lexical_search.Index(docs.limit(0)), asked).count() == 0
    assert lexical_search.search(lexical_search.Index(docs), asked.limit(0)).count() == 0


# conversation trie


def plain_trie(convs):
    nodes = defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append((c, len(path) == d))
    kids = defaultdict(set)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c, last in sorted(members) if last)
        yield (min(members)[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(members), len(kids[p]), sum(not kids[q] for q in below),
               sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest())


def plain_rebuilt(rows):
    own = defaultdict(list)
    for n, (c, turn, role, text) in enumerate(rows):
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [x[1] for x in sorted(t)] for c, t in own.items()}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        yield c, own.get(c - c % 5, [])[:h] + turns[h:]


KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("limit", [1, 7, 40, prefix_trie.LIMIT])
def test_trie_equals_brute_force(spark, limit):
    rnd = random.Random(3)
    convs = {i: [("user", rnd.choice("abé"))] * rnd.randrange(2) + [("bot", rnd.choice("xy")) for _ in range(rnd.randrange(6))] for i in range(60)}
    # a beginning of a third of all, of which many go on alike; copies; one that is much longer than the limit
    convs |= {100 + i: [("user", "hot")] * 3 + [("bot", rnd.choice("pq"))] * (i % 4) for i in range(40)}
    convs |= {200 + i: [("user", "copy"), ("bot", "copy")] for i in range(20)} | {300: [("user", str(i % 3)) for i in range(50)]}
    convs |= {12: [], 5: []}
    data = [(c, t, *x) for c, path in convs.items() for t, x in enumerate(path)]
    turns = prefix_trie.paths(spark.createDataFrame(data, KIND))
    none = spark.createDataFrame([(c,) for c, p in convs.items() if not p], "conv_id long").selectExpr("conv_id", "CAST(array() AS array<struct<d:string,b:bigint>>) AS path")
    got = prefix_trie.trie(turns.unionByName(none), limit)
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == Counter(plain_trie(convs))


def test_rebuilt_conversations_and_odd_rows(spark):
    rnd = random.Random(8)
    rows = [(c, t, rnd.choice(("user", "bot", None)), rnd.choice(("a", "b", None, "", "lang " * 5000))) for c in range(40) if c % 10 != 5 for t in range(rnd.randrange(1, 12))]
    rows += [(3, None, "user", "no turn"), (3, None, "user", "no turn"), (4, 1, "user", "tie"), (4, 1, "bot", "tie"), (None, 1, "user", "of nobody")]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], KIND + ", path string, `top` string").repartition(5)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(turns)), 20)
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == Counter(plain_trie(dict(plain_rebuilt(rows))))
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(turns.limit(0)))).count() == 0
