"""op11 against DuckDB and brute force: exact bounds, ties, and odd rows."""

import hashlib

import duckdb
import numpy as np

from stackloom.llm import registry, vector_codes
from stackloom.llm.common import Scratch

DATA = "/root/testdata/sf0.001"


def slow(rows, parts=16, entries=64, rounds=2):
    """Plain Lloyd rounds with a full scan each; rows are (vec_id, vector, label) with whole vectors."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = [[int(np.floor(256 * float(x))) for x in r[1]] for r in rows]
    w = len(q[0]) // parts
    x = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for v in q]
    books = [[x[e][p] for e in range(min(entries, len(x)))] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(v[p], books[p]) for v in x]
            for e in range(len(books[p])):
                own = [v[p] for v, a in zip(x, of, strict=True) if a == e]
                if own:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    codes = [[near(v[p], books[p]) for p in range(parts)] for v in x]
    errors = [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(x, codes, strict=True)]
    total = {}
    for r, e in zip(rows, errors, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for k in c), e, total[r[2]], sha) for r, c, e in zip(rows, codes, errors, strict=True)), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_sql_and_brute_force(spark):
    mine = registry.QUERIES["op11_vector_codes"](spark, DATA)
    assert mine.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    assert got(mine) == sorted(duck.sql(registry.ORACLE_SQL["op11_vector_codes"]).fetchall(), key=repr) == slow([(r["vec_id"], r["embedding"], r["label"]) for r in rows])


def test_bounds_and_ties_on_few_values():
    """Small integers make many ties; six rounds persist bounds, and each round's codes equal a full scan of all entries."""
    r = np.random.default_rng(2)
    for width, span in ((1, 4), (2, 3), (3, 40), (4, 4000)):
        x = r.integers(-span, span, (700, 3, width))
        books, state, scans = vector_codes.Books(np.ascontiguousarray(x[:9].transpose(1, 0, 2))), None, []
        for _ in range(6):
            *state, n = vector_codes.assign(x, books, state)
            scans.append(n)
            d = ((x[:, :, None] - books.entries[None]) ** 2).sum(3)
            assert (state[0] == d.argmin(2)).all()
            assert (state[1].astype(float) ** 2 >= d.min(2) * (1 - 1e-9)).all()
            second = np.sort(d, 2)[:, :, 1]
            assert (np.maximum(state[2].astype(float), 0) ** 2 <= second * (1 + 1e-9)).all()
            counts = np.stack([np.bincount(state[0][:, p], minlength=9) for p in range(3)])
            sums = np.stack([[x[state[0][:, p] == e, p].sum(0) for e in range(9)] for p in range(3)])
            books = books.after(counts, sums)
        assert scans[0] == 2100 and (span < 1000 or scans[-1] < 1000)


def test_large_components_stay_exact():
    x = np.array([[(1 << 26) - 1, -(1 << 26)], [3, 4], [-(1 << 26), 1 << 26], [(1 << 26) - 2, -(1 << 26)]])
    a, first, second = vector_codes.scan(x, x[[0, 1, 3]])
    assert a.tolist()[:2] == [0, 1] and a[3] == 2 and first[3] == 0 and second[0] == 1
    assert first[2] == min(sum((int(s) - int(t)) ** 2 for s, t in zip(x[2], x[k], strict=True)) for k in (0, 1, 3))


def test_odd_rows(spark):
    v = lambda *x: [float(k) for k in x] + [0.0] * (16 - len(x))
    rows = [(1, v(1, 2), 5), (1, v(1, 2), 5), (2, None, 5), (3, v(float("nan")), 5), (4, v(float("inf")), None), (5, [None] + [0.0] * 15, 1), (6, [-0.001] * 16, None), (None, v(-1), None), (None, v(-2), 7), (8, v(0.5, -0.5, 1e-9), 7)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("q", "code", "upper", "n", "key", "of"):
        d = d.withColumn(c, d["vec_id"])
    whole = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    assert got(vector_codes.compress(d)) == slow(whole)
    assert got(vector_codes.compress(d, entries=3)) == slow(whole, entries=3)
    assert vector_codes.compress(d.limit(0)).collect() == [] and vector_codes.compress(d.where("vec_id = 2")).collect() == []
    other = spark.createDataFrame([(0, v(1), 1), (1, [1.0, 2.0], 1), (2, [], 1)], "vec_id long, embedding array<double>, label int")
    assert [r[1] is None for r in got(vector_codes.compress(other))] == [False, True, True]
    assert [r[1:3] for r in got(vector_codes.compress(other.where("vec_id > 0")))] == [(None, None)] * 2


def test_decode_gives_near_vectors_and_many_labels_join_alike(spark, monkeypatch):
    d = spark.read.parquet(f"{DATA}/embeddings.parquet")
    with Scratch(spark) as scratch:
        state, books = vector_codes.train(d, scratch)
        near = {r["vec_id"]: np.array(r["approx"]) for r in vector_codes.decode(vector_codes.compress(d), books).collect()}
        rows = {r["vec_id"]: np.array(r["embedding"]) for r in d.collect()}
        assert all(np.abs(near[k] - rows[k]).mean() < 0.1 for k in rows) and state.count() == len(rows)
    want = got(vector_codes.compress(d))
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 0)
    assert got(vector_codes.compress(d)) == want
