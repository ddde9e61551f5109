"""Brute-force versions and odd inputs of the operators that no SQL stands beside."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from siftgate.llm import bestfit_packing, common, line_dedup, media_columns, minhash_dedup, mixing, quality_classifier, quality_rules, substring_dedup, suffix_dedup, warc

#: Names that operators use themselves, or have used.
CLASHES = "rid h core gone chunks removed text_before log_weight held kept key _text bin _bin number _number rank _rank copies target size _cut _source _before _copy source_size carried0 carried1 count n x asked lines cut copy name".split()
LONG = "word " * 40_000 + "end"
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "no id here at all"), (None, "no id here at all"), (7, "twice the same row"), (7, "twice the same row"), (8, LONG), (9, "x" * 100_000)]


def documents(spark, rows, clashes=True):
    """Rows as a table of documents with columns of every name that could clash."""
    more = CLASHES if clashes else []
    data = [(d, t, "en", "s1", None if t is None else len(t), *[f"{c}!" for c in more]) for d, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in more))


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def whole_rows(df):
    return Counter(tuple(r) for r in df.collect())


# columns of the caller


@pytest.mark.parametrize("stage", ["quality", "lines", "near", "mix"])
def test_stages_return_the_callers_columns_untouched(spark, stage):
    rnd = random.Random(1)
    rows = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(40)) + f"\nline {i}\nlast {i}") for i in range(40)] + ODD
    docs = documents(spark, rows)
    out = {
        "quality": lambda: quality_classifier.kept_documents(docs, labels_of(spark)),
        "lines": lambda: line_dedup.dedup_documents(docs),
        "near": lambda: minhash_dedup.one_of_each(docs),
        "mix": lambda: mixing.mixed_documents(docs),
    }[stage]()
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    given = whole_rows(docs)
    assert all(r in given for r in whole_rows(out))
    if stage == "quality":  # no clean labels: all stay
        assert whole_rows(out) == given
    assert {r.doc_id for r in out.collect()} >= set(range(10, 40))


def test_reports_have_a_row_per_document_whatever_its_columns(spark):
    docs, labels = documents(spark, ODD), labels_of(spark)
    for f in (suffix_dedup.suffix_array_dedup, substring_dedup.substring_dedup, line_dedup.line_dedup, minhash_dedup.minhash_dedup, media_columns.media_columns, lambda d: quality_rules.quality_rules(d, labels), lambda d: quality_classifier.importance_resample(d, labels)):
        assert Counter(r.doc_id for r in f(docs).collect()) == Counter(d for d, _ in ODD)
    assert {r.doc_id for r in bestfit_packing.pack(docs).collect()} == {d for d, _ in ODD}


def test_empty_tables(spark):
    docs, labels = documents(spark, []), labels_of(spark)
    # (the deduplicating operators: test_dedup)
    for f in (media_columns.media_columns, bestfit_packing.pack, mixing.mixed_documents, lambda d: quality_rules.quality_rules(d, labels), lambda d: quality_classifier.importance_resample(d, labels), lambda d: quality_classifier.kept_documents(d, labels)):
        assert f(docs).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.warc_round_trip(pages).collect() == []


# op3


def plain_features(t):
    w, t = brute.words(t), t or ""
    ls = [x for x in t.split("\n") if brute.words(x)]
    n = len(w)
    share = lambda a, b: a / b if b else 0.0
    c = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    rep = sum(brute.covered(n, [i for i in range(n - 7) if c[tuple(w[i : i + 8])] > 1], 8))
    chars = sum(map(len, w))
    return {
        "symbols": share(sum(t.count(x) for x in "#*$%&|<>"), n), "dup_lines": share(len(ls) - len(set(ls)), len(ls)), "repeats": share(rep, n),
        "capitals": share(sum("A" <= x <= "Z" for x in t), chars), "exclamations": share(t.count("!"), n),
        "echoes": share(sum(a == b for a, b in zip(w, w[1:])), n), "length": share(chars, 10 * n),
    }, n < 20 or 100 * rep > 30 * n


def plain_rules(docs, labels):
    """``kept`` per row, and the factor of each certified language."""
    q = quality_rules
    worst = {}
    for d, quality, _ in labels:
        if quality is not None:
            worst[d] = min(quality, worst.get(d, 1))
    f = [(d, lang or "", *plain_features(t)) for d, t, lang in docs]
    steps = [(d, lang, {r: min(math.ceil(v * q.STEPS), q.MOST) for r, v in x.items()}, base) for d, lang, x, base in f]
    good = [(lang, s, int(hashlib.md5(str(d).encode()).hexdigest()[0], 16) % 4) for d, lang, s, base in steps if not base and worst.get(d) == 1]
    cuts, tested = {}, {}
    for lang in {g[0] for g in good}:
        a, b = [s for x, s, p in good if x == lang and p == 0], [s for x, s, p in good if x == lang and p]
        if a and b:
            tested[lang] = b
            cuts[lang] = {r: max(q.LEAST, min(v for v in {s[r] for s in a} if sum(s[r] > v for s in a) <= q.TAIL * len(a))) for r in q.RULES}
    chosen = {}
    for lang, b in tested.items():
        for m in q.FACTORS:
            cut = {r: math.ceil(m * c) for r, c in cuts[lang].items()}
            k, n = sum(any(s[r] > cut[r] for r in cut) for s in b), len(b)
            p = Fraction(str(q.RISK))
            tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k <= n * p else 1
            if tail > Fraction(str(q.DELTA)) / len(tested):
                break
            chosen[lang] = (m, cut)
    rejected = lambda lang, s: lang in chosen and any(s[r] > chosen[lang][1][r] for r in s)
    return [(d, base, not base and not rejected(lang, s)) for d, lang, s, base in steps], {k: v[0] for k, v in chosen.items()}


def test_op3_equals_plain_rules(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want, chosen = plain_rules(docs, labels)
    got = quality_rules.op3_quality_rules(spark, sf).collect()
    assert brute.order([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]) == brute.order(brute.op3([x[:2] for x in docs]))
    assert brute.order([(r.doc_id, r.base_failed, r.kept) for r in got]) == brute.order(want)
    assert chosen and any(r.failed and not r.base_failed for r in got)  # some language is certified, and its rules reject


def test_rules_of_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(d, t, None if i % 2 else "en") for i, (d, t) in enumerate(ODD)], "doc_id long, text string, lang string")
    labels = labels_of(spark, [(7, 1, 0), (7, None, 0), (None, 1, 0), (8, 0, None)])
    got = quality_rules.quality_rules(docs, labels).collect()
    assert len(got) == len(ODD) and all(r.kept == (not r.base_failed) for r in got)
    assert {r.doc_id: r.n_words for r in got}[8] == 40_001


# op4


def plain_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]


def packed_well(rows, got, ids, capacity=2048):
    want = Counter()
    for d, t in rows:
        x = ids(t)
        first = len(x) % capacity or capacity
        cuts = [0, *range(first, len(x) + 1, capacity)]
        want.update((d, i, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= capacity
    return len(at), -(-sum(at.values()) // capacity)


def test_op4_ids_pieces_and_places(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    used, least = packed_well(rows, bestfit_packing.op4_bestfit_packing(spark, sf).collect(), plain_ids())
    assert used <= least + 1


def test_packing_of_odd_rows(spark):
    rows = [*ODD, (20, "  two  blanks and\tmore \n\n x"), (21, "don't it's 12345 ÄÖ 日本語 🙂🙂"), (22, " a\x0bb\x0c c")]
    packed_well(rows, bestfit_packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain_ids())


# op6


def plain_image(t):
    """Rows of 576 samples, stored as PNG: read back by another path (bytes of the file, without the library's decoder)."""
    data = (t or "").encode()
    return data + b"\xff" * (-len(data) % 576 if data else 576)


def unpng(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, width, height = 8, b"", 0, 0
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        assert int.from_bytes(data[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + part)
        if kind == b"IHDR":
            width, height = int.from_bytes(part[:4], "big"), int.from_bytes(part[4:8], "big")
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    raw, out = zlib.decompress(body), []
    for y in range(height):
        kind, row = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            a, b, c = (row[x - 1] if x else 0), (out[-1][x] if y else 0), (out[-1][x - 1] if x and y else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row[x] = (row[x] + (0, a, b, (a + b) // 2, paeth)[kind]) & 255
        out.append(row)
    return b"".join(map(bytes, out))


def test_op6_equals_plain_images(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 1000, "text").limit(60).collect()] + [r for r in ODD if r[0] != 8]
    got = media_columns.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {}
    for d, t in rows:
        by.setdefault(d, []).append(t)
    for r in got:
        t = by[r.doc_id][0]
        whole = plain_image(t)
        assert unpng(bytes(r.image)) == whole
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert len(r.feature) == 8
    assert len({(r.image, r.feature) for r in got if r.doc_id == 7}) == 1


# op7


def test_kth_key_equals_a_sort(spark):
    rnd = random.Random(3)
    for values in ([rnd.gauss(0, 5) for _ in range(3000)], [1.5] * 50, [0.0, 1.0] * 40 + [0.5], [-1e300, 1e300, 0.0, 1e-300], [7.0]):
        keys = spark.createDataFrame([(x,) for x in values], "key double").cache()
        for k in {1, 2, len(values) // 2, len(values) - 1} & set(range(1, len(values) + 1)):
            cut = quality_classifier.kth_key(keys, k)
            assert sum(x >= cut for x in values) == sum(x >= sorted(values, reverse=True)[k - 1] for x in values)
        assert quality_classifier.kth_key(keys, 0) == math.inf and quality_classifier.kth_key(keys, len(values)) == -math.inf


def test_draw_is_the_top_k_and_favours_the_target(spark):
    rnd = random.Random(5)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choice(good if i % 3 else bad) for _ in range(60))) for i in range(600)]
    labels = labels_of(spark, [(i, int(bool(i % 3)), 0) for i in range(400)] + [(1, None, 0), (2, 1, 1), (None, 1, 0)])
    docs = documents(spark, rows, clashes=False)
    for k in (0, 1, 150, 600):
        r = quality_classifier.importance_resample(docs, labels, k=k).collect()
        top = sorted((x.key for x in r), reverse=True)[:k]
        assert sorted((x.key for x in r if x.kept), reverse=True) == top
    r = {x.doc_id: x for x in quality_classifier.importance_resample(docs, labels).collect()}
    kept = {i for i, x in r.items() if x.kept}
    assert len([i for i in kept if i % 3 == 0]) <= 4 and len([i for i in kept if i % 3]) >= 390
    again = {x.doc_id: x.key for x in quality_classifier.importance_resample(docs, labels).collect()}
    assert again == {i: x.key for i, x in r.items()}


def test_the_budget_is_a_share_and_no_threshold(spark):
    """Half of the labelled documents are clean, none of the others is: a threshold would keep a sixth of all, the budget draws half."""
    rnd = random.Random(6)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choice(good if i < 600 and i % 2 else bad) for _ in range(60))) for i in range(1800)]
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(600)])
    r = quality_classifier.importance_resample(documents(spark, rows, clashes=False), labels).collect()
    kept = [x for x in r if x.kept]
    assert 0.4 * 1800 < len(kept) < 0.6 * 1800
    assert sum(x.doc_id < 600 and x.doc_id % 2 for x in kept) >= 295
    assert min(x.key for x in kept) > max(x.key for x in r if not x.kept)


def test_rows_without_an_id_draw_apart(spark):
    docs = documents(spark, [(None, f"text {i}") for i in range(20)], clashes=False)
    r = quality_classifier.importance_resample(docs, labels_of(spark), k=5).collect()
    assert sum(x.kept for x in r) == 5


def test_log_weights_equal_plain_sums(spark):
    """Texts of few words, so that no two n-grams share a bucket."""
    rows = [(i, " ".join("abcdefgh"[(i * j) % 8] for j in range(1, 12))) for i in range(1, 40)]
    labels = labels_of(spark, [(i, 1, 0) for i in range(1, 12)])
    r = {x.doc_id: x.log_weight for x in quality_classifier.importance_resample(documents(spark, rows, clashes=False), labels).collect()}
    aim = {i for i in range(1, 12) if int(hashlib.md5(str(i).encode()).hexdigest()[-1], 16) % 2 == 0}
    kinds = (lambda w: w, lambda w: list(zip(w, w[1:])))
    want = dict.fromkeys(r, 0.0)
    for grams in kinds:
        raw, target = Counter(), Counter()
        for i, t in rows:
            raw.update(grams(t.split()))
            target.update(grams(t.split()) if i in aim else [])
        scale = target.total() / raw.total()
        for i, t in rows:
            want[i] += sum(math.log((target[g] + quality_classifier.PRIOR) / (raw[g] * scale + quality_classifier.PRIOR)) for g in grams(t.split()))
    assert all(abs(want[i] - r[i]) < 1e-4 for i in r)


# op10


def plain_targets(sizes, weights=(5, 2, 1), limit=3):
    """By hand: share, cap what is above, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, Fraction(sum(sizes.values())), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > limit * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in open_})
            break
        target.update({s: Fraction(limit * sizes[s]) for s in over})
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", [1, 3])
def test_mix_meets_plain_targets(spark, seed):
    rnd = random.Random(seed)
    sources = [None, "a", "b", "c", "ä", "Z", ""][: 3 + 2 * (seed - 1)]
    rows = [(i if i % 50 else None, rnd.choice([sources[0]] * 6 + sources), rnd.choice([0, 1, 5, 80, rnd.randrange(400)])) for i in range(3000)] + [(5, "zero words", 0)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 0.02 * float(want[s]) + 800 for s in sizes)
    again = Counter((r.doc_id, r.source, r.size, r.copies) for r in mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, source string, size long")).collect())
    assert again == Counter((r.doc_id, r.source, r.size, r.copies) for r in got)


def test_op10_takes_words_near_each_target(spark, sf):
    docs = {r.doc_id: (r.source, len(brute.words(r.text))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = mixing.op10_mixing(spark, sf).collect()
    assert {r.doc_id: r.size for r in got} == {d: n for d, (_, n) in docs.items()} and len(got) == len(docs)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[docs[r.doc_id][0]] += r.size
        taken[docs[r.doc_id][0]] += r.taken
    want = plain_targets(sizes)
    for r in got:
        s = docs[r.doc_id][0]
        assert abs(r.target - want[s]) < 1e-6 * float(want[s]) and r.source_size == sizes[s] and (not r.size or r.taken % r.size == 0) and r.taken <= 3 * r.size
    assert all(abs(taken[s] / float(want[s]) - 1) < 0.15 for s in sizes)


# op9


def test_warc_of_odd_pages(spark):
    body = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a", body), (5, None, body), (3, "http://c", body), (4, "http://d", "short"), (6, "http://e", "short"), (7, "http://f", None), (8, "http://g", ""), (None, "http://h", "no id"), (9, "http://i", "y" * 400_000), (10, "http://j\r\nX-Evil: 1", "z" * 2000)]
    got = warc.warc_round_trip(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, refers_to int")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert {k: (by[k].record_type, by[k].refers_to) for k in (1, 3, 5)} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None)}
    assert all(by[k].record_type == "response" and by[k].refers_to is None for k in (4, 6, 7, 8, 9, 10, None))
    for k, _, html in rows:
        data = (html or "").encode()
        assert (by[k].payload_bytes, by[k].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())


# pipeline


def test_pipeline_stages_at_sf001(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet")
    docs, before = given, {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs
        docs = common.table(stage(spark, docs, sf), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == given.dtypes
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_classifier.importance_resample(before["quality classifier"], labels)
    assert {r.doc_id for r in scored.where("kept").collect()} == {r.doc_id for r in before["line dedup"].collect()}
    cut = {r.doc_id: r for r in line_dedup.line_dedup(before["line dedup"]).collect()}
    assert {r.doc_id: r.text for r in before["minhash near-dedup"].collect()} == {d: r.text for d, r in cut.items() if not r.n_removed_lines or brute.words(r.text)}
    rows = [(r.doc_id, r.text) for r in before["minhash near-dedup"].collect()]
    assert {r.doc_id for r in before["mixing sources"].collect()} == {x[0] for x in brute.op8(rows, 80) if x[3]}
    copies = {r.doc_id: r.copies for r in mixing.mix(mixing.sized(before["mixing sources"]).select("doc_id", "source", "size")).collect()}
    assert Counter(r.doc_id for r in before["best-fit packing"].collect()) == Counter({d: n for d, n in copies.items() if n})
    rows = [(r.doc_id, r.text) for r in before["best-fit packing"].collect()]
    used, least = packed_well(rows, docs.collect(), plain_ids())
    assert used <= least + 1
    assert before["line dedup"].where(F.col("doc_id").isNull()).count() == 0


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").collect() == []
