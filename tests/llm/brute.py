"""Plain versions of the contracts."""

import hashlib
import re
from collections import Counter

BIG = 2**63 - 1


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, list) else (False, "", str(x)) for x in r))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def covered(n, starts, length):
    mark, last = bytearray(n), 0
    for i in starts:
        s = max(i, last)
        mark[s : i + length] = b"\1" * (i + length - s)
        last = i + length
    return mark


def op1(rows, length):
    c = Counter()
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[i : i + length] for i in range(len(b) - length + 1))
    for d, t in rows:
        b = (t or "").encode()
        m = covered(len(b), [i for i in range(len(b) - length + 1) if c[b[i : i + length]] > 1], length)
        yield d, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest()


def op2(rows, length):
    least, docs = {}, [(d, BIG if d is None else d, [w.encode() for w in words(t)]) for d, t in rows]
    for _, o, w in docs:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            least[k] = min(least.get(k, BIG), o)
    for d, o, w in docs:
        m = covered(len(w), [i for i in range(len(w) - length + 1) if least[tuple(w[i : i + length])] < o], length)
        yield d, len(w), sum(m), hashlib.sha256(b" ".join(x for x, y in zip(w, m, strict=True) if not y)).hexdigest()


def op3(rows):
    for d, t in rows:
        t = t or ""
        w = words(t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = sum(covered(len(w), [i for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1], 8))
        lines = [x for x in t.split("\n") if words(x)]
        yield d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w)


def shingles(t, size=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def op8(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    at: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in at[x] if j < i)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), BIG), BIG if d is None else d)
    for i, (d, _) in enumerate(rows):
        c = least[find(i)]
        c = None if c == BIG else c
        yield d, len(sets[i]), c, d == c
