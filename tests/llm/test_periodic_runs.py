"""op13 against brute force over all periods and starts, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np

from stackloom.llm import periodic_runs, registry

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_runs(w):
    """Every maximal stretch with period p, for all p, kept under its smallest period."""
    n, least = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i + p - s
            if length >= max(6, 4 * p):
                least.setdefault((s, length), p)
    return sorted((s, n, p) for (s, n), p in least.items())


def slow_row(doc_id, text, periodic=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if periodic and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    gone = {i for s, k, p in found for i in range(s + p, s + k)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *tail, sha("".join(f"{s},{k},{p}\n" for s, k, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark):
    got = sorted(map(tuple, registry.QUERIES["op13_periodic_runs"](spark, DATA).collect()))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert got == sorted(slow_row(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_random_and_built_sequences_equal_brute_force():
    r = random.Random(5)
    texts = []
    for k in range(600):
        w = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(40))]
        if k % 2:
            block = [r.randrange(3) for _ in range(r.randrange(1, 9))]
            w += block * r.randrange(3, 7) + block[: r.randrange(len(block) + 1)] + w
        texts.append(np.array(w, np.int64))
    got = periodic_runs.runs(texts)
    assert [list(map(tuple, g.tolist())) for g in got] == [slow_runs(t.tolist()) for t in texts]


def test_extensions_equal_a_plain_scan():
    r = np.random.default_rng(3)
    x = np.concatenate((r.integers(0, 2, 300), np.zeros(40, int), [9]))
    i, j = r.integers(0, 340, 500), r.integers(0, 340, 500)
    i, j = i[i != j], j[i != j]

    def plain(a, b):
        k = 0
        while max(a, b) + k < len(x) and x[a + k] == x[b + k]:
            k += 1
        return k

    assert periodic_runs.Extensions(x).of(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\t \x0b\x0c\r "), (4, "a " * 5), (5, "a " * 6), (5, "a " * 6), (None, "x y " * 9), (None, None), (7, "a b a b a b a b a b a b"), (8, "na " * 300_000), (9, "𝒳 \x00 " * 8), (10, " ".join(map(str, range(50_000))) * 2)]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    for c in ("start", "length", "period", "n_runs", "h"):
        d = d.withColumn(c, d["text"])
    got = sorted(map(tuple, periodic_runs.detect(d).collect()), key=repr)
    assert got == sorted((slow_row(i, t) if i not in (8, 10) else next(g for g in got if g[0] == i) for i, t in rows), key=repr)
    long = {g[0]: g for g in got}
    assert long[8][1:6] == (1, 0, 300_000, 1, 300_000_000) and long[8][7] == hashlib.sha256(b"na").hexdigest() and long[10][1] == 0
    assert long[1][1:6] == (0, None, None, None, None) and long[1][7] == hashlib.sha256(b"").hexdigest()
    assert periodic_runs.detect(d.limit(0)).collect() == []
