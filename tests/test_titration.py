import hashlib
import math
import re


from siftgate.operators import passages

SEED = "s"


def _tables(spark):
    text = lambda n, tag: " ".join(f"{tag}{i}" + "." * (i % 9 == 8) for i in range(n))
    items = spark.createDataFrame([(i, text(16, f"i{i}w")) for i in (1, 2)], "item_id long, text string")
    docs = [(1, "en", text(3200, "a")), (2, "en", text(900, "b")), (3, "fr", text(300, "c")), (4, "de", text(20, "d"))]
    return passages.anchors(items), spark.createDataFrame(docs, "doc_id long, lang string, text string")


def test_all_bins_are_filled_or_reported(spark):
    a, docs = _tables(spark)
    assert {(r.doc_id, r.reach) for r in passages.hosts(docs).collect()} == {(1, 4096), (3, 256)}
    got = {(r.lang, r.bin) for r in passages.titration(a, docs, SEED).collect()}
    assert got == {("en", b) for b in passages.BINS} | {("fr", b) for b in (64, 96, 128, 256)}
    none = passages.unfilled(a, docs, SEED).collect()
    assert {(r.lang, r.bin) for r in none} == {("fr", b) for b in (512, 1024, 2048, 4096)} | {("de", b) for b in passages.BINS}
    assert len(none) == 2 * 12 * 3


def _spliced(host, budget, q, payload):
    """The reference's rule: whole sentences while the words last, the last one cut; slot floor(q * (m + 1))."""
    frame, used = [], 0
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", host.strip())):
        w = s.split()
        frame.append(s if used + len(w) <= budget else " ".join(w[: budget - used]))
        used += min(len(w), budget - used)
        if used == budget:
            break
    slot = min(len(frame), int(q * (len(frame) + 1)))
    return slot, " ".join([*frame[:slot], payload, *frame[slot:]])


def test_payloads_stand_between_sentences_and_short_frames_collide(spark):
    # sentences of 60 words, one with a line break: a frame of bin 64 (34 words) is a piece of one of them
    host = " ".join(("\n" if i == 70 else "") + f"h{i}" + "." * (i % 60 == 59) for i in range(3200))
    item = " ".join(f"p{i}" for i in range(16))
    a = passages.anchors(spark.createDataFrame([(1, item)], "item_id long, text string"))
    cells = passages.titration(a, spark.createDataFrame([(1, "en", host)], "doc_id long, lang string, text string"), SEED).where("pair = 'flip'")
    got = {(r.bin, r.position): (r.slot, r.text_a) for r in cells.collect()}
    assert got == {(b, n): _spliced(host, math.ceil(b / 1.3) - 16, q, item) for b in passages.BINS for n, q in (("early", 0.05), ("middle", 0.5), ("late", 0.95))}
    slots = cells.groupBy("bin", "slot").count().where("count > 1").select("bin").collect()
    assert 64 in {r.bin for r in slots} and 4096 not in {r.bin for r in slots}


def _drawn(seed, item, lang, n, kept):
    """Draws without replacement, bound by bound."""
    u = lambda b: int(int(hashlib.md5(f"{seed}|{item}|{lang}|{b}".encode()).hexdigest()[:8], 16) / 2**32 * b)
    have = []
    for b in range(max(n - kept, 0) + 1, n + 1):
        have.append(b - 1 if u(b) in have else u(b))
    return sorted(have, key=lambda p: hashlib.md5(f"{seed}|{item}|{lang}|{p}".encode()).hexdigest())


def test_hosts_are_drawn_by_places_without_a_crossing(spark):
    sizes = {"en": 1000, "de": 5, "fr": 2}
    pool = spark.createDataFrame([(1000 * k + 7 * i, lang) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)], "doc_id long, lang string")
    a = spark.createDataFrame([(i,) for i in range(30)], "item_id long")
    got = passages.draw(a, pool, SEED)
    want = {(i, lang, r + 1, 1000 * k + 7 * p) for i in range(30) for k, (lang, n) in enumerate(sizes.items()) for r, p in enumerate(_drawn(SEED, i, lang, n, 4))}
    assert {tuple(r) for r in got.select("item_id", "lang", "r", "doc_id").collect()} == want and len(want) == 30 * (4 + 4 + 2)
    assert len({w[3] for w in want if w[1] == "en"}) > 90  # no host is favoured
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Cross") == 1 and "doc_id" not in plan[plan.index("Cross") :].split("\n")[1]  # anchors x domains only


def test_plans_hold_no_caches(spark):
    a, docs = _tables(spark)
    for df in (a, passages.titration(a, docs, SEED), passages.unfilled(a, docs, SEED)):
        assert "InMemory" not in df._jdf.queryExecution().optimizedPlan().toString()
