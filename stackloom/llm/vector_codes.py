"""Compression of vectors to short codes: a codebook for each of their parts, trained by Lloyd rounds with Hamerly's bounds.

Components are integers, so distances are exact. Of every part of every vector the number of its nearest entry is persisted with an upper
bound of the distance to it and a lower bound of the distance to any other. A round moves the bounds by what the entries
moved; only where the upper bound is not strictly below the lower one (or below half the way to the closest other entry), also
after it is made exact, are all entries looked at again. A tie is no strict bound, so it always ends in a full scan, which gives it to
the lower index. Bounds are single floats, rounded away from the true distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import BROADCAST_ROWS, Scratch, keep, spread

#: Equal parts of a vector, entries of a part's codebook, and rounds of training.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components become floor(SCALE * x); beyond this bound (262,144 of the vector's own units) they count as the bound, so that sums of squares fit.
SCALE, LIMIT = 256, 1 << 26
_STATE = "vec_id long, label string, q array<int>, code array<short>, upper array<float>, lower array<float>"


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def exact(*arrays: np.ndarray) -> type:
    """The type in which squared distances are exact: floats, which multiply faster, if all stay below 2**53."""
    most = max((float(np.abs(a).max(initial=0)) for a in arrays), default=0)
    return np.float64 if 4 * arrays[0].shape[-1] * most * most < 2**53 else np.int64


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower of equals), squared distance to it and to the second nearest (infinite if there is none) of each row."""
    kind = exact(x, book)
    x, book = x.astype(kind), book.astype(kind)
    d = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    a = d.argmin(1)
    at = np.arange(len(x))
    first = d[at, a].astype(np.int64)
    d = d.astype(np.float64)
    d[at, a] = np.inf
    return a, first, d.min(1, initial=np.inf)


@dataclass
class Books:
    """Codebooks (parts x entries x components of a part), with what the bounds need: how far entries moved, and half the gaps between them."""

    entries: np.ndarray
    moved: np.ndarray | None = None

    def __post_init__(self) -> None:
        p, k, _ = self.entries.shape
        gaps = np.full((p, k, k), np.inf)
        for i, b in enumerate(self.entries):
            gaps[i] = np.sqrt(((b[:, None] - b[None]) ** 2).sum(2))
        gaps[:, np.arange(k), np.arange(k)] = np.inf
        self.half = _below(gaps.min(2) / 2)
        if self.moved is not None:
            self.moved = _above(self.moved).astype(np.float64)
            order = np.sort(self.moved, 1)
            most, second = order[:, -1:], order[:, -2:-1] if k > 1 else np.zeros((p, 1))
            self.others = np.where(self.moved == most, np.where((self.moved == most).sum(1, keepdims=True) > 1, most, second), most)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def after(self, counts: np.ndarray, sums: np.ndarray) -> Books:
        """Each entry at the floor of its parts' mean; one without parts stays."""
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        return Books(new, np.sqrt(((new - self.entries) ** 2).sum(2).astype(np.float64)))


def assign(x: np.ndarray, books: Books, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds (rows x parts) of integer parts (rows x parts x components), from those of the round before if there are any; and the number of full scans."""
    n, parts, _ = x.shape
    if state is None:
        code, upper, lower = np.zeros((n, parts), np.int16), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
    else:
        code, upper, lower = (s.copy() for s in state)
    scans = 0
    for p in range(parts):
        book, a = books.entries[p], code[:, p]
        if state is None:
            todo = np.arange(n)
        else:
            upper[:, p], lower[:, p] = _above(upper[:, p] + books.moved[p][a]), _below(lower[:, p] - books.others[p][a])
            bound = np.maximum(lower[:, p], books.half[p][a])
            todo = np.flatnonzero(~(upper[:, p] < bound))
            upper[todo, p] = _above(np.sqrt(((x[todo, p] - book[a[todo]]) ** 2).sum(1)))
            todo = todo[~(upper[todo, p] < bound[todo])]
        if len(todo):
            scans += len(todo)
            code[todo, p], first, second = scan(x[todo, p], book)
            upper[todo, p], lower[todo, p] = _above(np.sqrt(first)), _below(np.sqrt(second))
    return code, upper, lower, scans


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label as a string, and integer components q of the rows whose vector is there and has finite components only."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), v * SCALE))).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & ~odd).select(F.col("vec_id").cast("long"), F.col("label").cast("string"), whole.alias("q"))


def _lists(x: np.ndarray, ok: np.ndarray) -> pa.ListArray:
    """Rows of ``x`` as lists where ``ok``, empty lists elsewhere."""
    ends = np.cumsum(ok * x.shape[1]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(1, np.int32), ends))), pa.array(x.ravel()))


def _rows(b: pa.RecordBatch, name: str, ok: np.ndarray, *shape: int) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)


def _step(state: DataFrame, books: Books) -> DataFrame:
    """Codes and bounds of all vectors for ``books``. Vectors of another length than the codebooks' have no code: empty lists."""
    parts, _, width = books.entries.shape
    seen = "code" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column(b.schema.get_field_index("q"))
            ok = pc.list_value_length(q).to_numpy(zero_copy_only=False) == parts * width
            before = (_rows(b, "code", ok, parts), _rows(b, "upper", ok, parts), _rows(b, "lower", ok, parts)) if seen else None
            code, upper, lower, _ = assign(_rows(b, "q", ok, parts, width).astype(np.int64), books, before)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), q, _lists(code, ok), _lists(upper, ok), _lists(lower, ok)], ["vec_id", "label", "q", "code", "upper", "lower"])

    return state.mapInArrow(run, _STATE)


def _means(state: DataFrame, books: Books) -> Books:
    """The codebooks' next entries: counts and sums are made where the rows are, one set of a bounded size for each task."""
    parts, entries, width = books.entries.shape
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((width, parts * entries), np.int64)
        for b in batches:
            ok = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False) > 0
            code, x = _rows(b, "code", ok, parts).astype(np.int64), _rows(b, "q", ok, parts, width)
            at = (code + np.arange(parts) * entries).ravel()
            counts += np.bincount(at, minlength=len(counts))
            for i in range(width):
                sums[i] += np.bincount(at, x[:, :, i].ravel(), len(counts)).astype(np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at]), *(pa.array(s[at]) for s in sums)], ["at", "n", *names])

    sums = state.select("q", "code").mapInArrow(run, ", ".join(["at long", "n long", *(f"{c} long" for c in names)]))
    counts, totals = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
    for r in sums.groupBy("at").agg(F.sum("n"), *(F.sum(c) for c in names)).collect():  # a row for each entry
        counts[r[0]], totals[r[0]] = r[1], r[2:]
    return books.after(counts.reshape(parts, entries), totals.reshape(parts, entries, width))


def _errors(state: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code, error of all vectors: the final assignment, with its exact distances."""
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pc.list_value_length(b.column(b.schema.get_field_index("code"))).to_numpy(zero_copy_only=False) > 0
            x = _rows(b, "q", ok, parts, width).astype(np.int64)
            code = assign(x, books, (_rows(b, "code", ok, parts), _rows(b, "upper", ok, parts), _rows(b, "lower", ok, parts)))[0]
            error = ((x - books.entries[np.arange(parts), code]) ** 2).sum((1, 2))
            text, total = np.full(len(ok), None, object), np.zeros(len(ok), np.int64)
            text[ok], total[ok] = [bytes(c).hex() for c in code.astype(np.uint8)], error
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(total, mask=~ok)], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, "vec_id long, label string, code string, error long")


def seeds(whole: DataFrame, parts: int, entries: int) -> Books | None:
    """Codebooks of the vectors of the smallest ids; rows of one id by their components, null ids last. None where no vector can be cut.

    The first of them sets the length that all vectors should have.
    """
    first = lambda d: [np.array(r["q"], np.int64) for r in d.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()]
    rows = first(whole)
    if rows and any(len(r) != len(rows[0]) for r in rows):
        rows = first(whole.where(F.size("q") == len(rows[0])))
    if not rows or not len(rows[0]) or len(rows[0]) % parts:
        return None
    return Books(np.ascontiguousarray(np.stack(rows).reshape(len(rows), parts, -1).transpose(1, 0, 2)))


def train(vectors: DataFrame, scratch: Scratch, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books] | None:
    """The trained codebooks, and the state of all vectors (integers, codes, bounds) as the last round left it, in ``scratch``. At most 256 entries."""
    state: DataFrame = integers(vectors)
    books = seeds(state, parts, entries)
    if books is None:
        return None
    for i in range(rounds):
        new = scratch.save(_step(state, books))
        if i:
            scratch.drop(state)
        state, books = new, _means(new, books)
    return state if rounds else scratch.save(_step(state, books)), books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of ``vectors`` (vec_id, embedding, label) whose vector is whole.

    Null vectors and those with a null or non-finite component are dropped. A vector of another length than that of the smallest id, or all
    if that can't be cut in ``parts``, has a null code and error. Repeated rows and ids get a row each, and count as often;
    null ids are kept and seed last; null labels are one label; with fewer vectors than ``entries`` the codebooks are shorter. An empty
    table gives an empty result. Extra columns are not read.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        got = train(vectors, scratch, parts, entries, rounds)
        if got is None:
            null = [F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"))]
            return keep(integers(vectors).select("vec_id", *null, F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256")))
        state, books = got
        rows = scratch.save(_errors(state, books))
        scratch.drop(state)
        key = F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("")).alias("key")
        totals = scratch.save(rows.groupBy(key).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
        labels, rows = totals.count(), rows.withColumn("of", key)
        if labels <= BROADCAST_ROWS:
            out = rows.join(F.broadcast(totals), F.col("of") == F.col("key"))
        else:
            out = spread(rows, "of", totals, "key", "n", F.col("vec_id"), rows.count())
        return keep(out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")))


def decode(coded: DataFrame, books: Books) -> DataFrame:
    """vec_id and approx, the vector that a code stands for, in the vectors' own units (the middle of each integer's range); null for a null code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(len(books.entries))
        for b in batches:
            got = [None if c is None else ((books.entries[at, np.frombuffer(bytes.fromhex(c), np.uint8)].ravel() + 0.5) / SCALE).tolist() for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.float64()))], ["vec_id", "approx"])

    return coded.select("vec_id", "code").mapInArrow(run, "vec_id long, approx array<double>")


def compress_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL with the rows of compress(): every assignment compares all entries."""
    nearest = lambda k: f"a{k} AS (SELECT r, p, min(d * {entries} + e) % {entries} AS e, min(d) AS d FROM (SELECT r, p, e, sum((x - c) * (x - c)) AS d FROM v JOIN b{k} USING (p, i) GROUP BY r, p, e) GROUP BY r, p)"
    steps = []
    for k in range(rounds):
        steps += [
            nearest(k),
            f"m{k} AS (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{k} USING (r, p) GROUP BY p, e, i)",
            f"b{k + 1} AS (SELECT p, e, i, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c FROM b{k} LEFT JOIN m{k} USING (p, e, i))",
        ]
    return f"""
    WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding, len(embedding) // {parts} AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    u AS (SELECT r, w, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) - 1 AS j FROM k),
    v AS (SELECT r, j // w AS p, j % w AS i, floor(256 * y)::BIGINT AS x FROM u),
    b0 AS (SELECT p, r AS e, i, x AS c FROM v WHERE r < {entries}),
    {", ".join(steps)},
    {nearest(rounds)},
    f AS (SELECT r, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
    s AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds})
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN f USING (r) CROSS JOIN s"""
