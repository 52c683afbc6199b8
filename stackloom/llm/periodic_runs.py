"""Periodic runs of words, by a harmonic grid of longest common extensions.

A run of period p and at least 4p words holds four neighbouring multiples of p, so for each p the words at jp and (j+1)p are
compared: the longest common extensions of the two positions forward and backward give the whole run. An extension is a range
minimum over the common prefixes of a suffix array; the backward ones come from the array of the reversed words. Grid points
whose words (and those p further on) already differ can't lie in a run that is long enough and are not asked for. The words
of many texts share one array, parted by words that occur once, so no extension leaves its text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that share one suffix array (a longer text has one to itself), and grid points or extensions that are worked on together.
TOGETHER, GRID = 1 << 17, 1 << 20
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Extensions:
    """Longest common extensions within one sequence, whose last item occurs once.

    The suffix array comes from prefix doubling; the ranks of each doubling give the common prefixes of its neighbours.
    """

    def __init__(self, items: np.ndarray):
        n = len(items)
        ranks = [np.unique(items, return_inverse=True)[1].astype(np.int64)]
        while ranks[-1].max(initial=0) < n - 1:
            step = 1 << (len(ranks) - 1)
            key = ranks[-1] * (n + 1)
            key[: n - step] += ranks[-1][step:] + 1
            order = np.argsort(key)
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
            ranks.append(new)
        self.rank = ranks.pop()
        array = np.empty(n, np.int64)
        array[self.rank] = np.arange(n)
        shared, a, b = np.zeros(max(n - 1, 0), np.int64), array[:-1], array[1:]
        for level in range(len(ranks) - 1, -1, -1):
            same = ranks[level][a + shared] == ranks[level][b + shared]
            shared[same] += 1 << level
        self.least = [shared.astype(np.int32)]  # least[k][i]: the minimum of 2**k common prefixes from i on
        while 2 << (len(self.least) - 1) <= len(shared):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at i and j, pair by pair; i and j differ."""
        out = np.empty(len(i), np.int64)
        for s in range(0, len(i), GRID):
            a, b = self.rank[i[s : s + GRID]], self.rank[j[s : s + GRID]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                at = np.flatnonzero(level == k)
                out[s + at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return out


def grid(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions jp and periods p for which a run of period p may hold jp and the three multiples after it."""
    n, found, p = len(items), [], 1
    while p <= n // LEAST_PERIODS:
        last = p
        while last < n // LEAST_PERIODS and (last + 1 - p) * (n // p + 1) < GRID:
            last += 1
        periods = np.arange(p, last + 1)
        each = np.maximum((n - 1) // periods - (LEAST_PERIODS - 2), 0)  # j with (j + 3)p < n
        period = np.repeat(periods, each)
        at = (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * period
        for step, ahead in [(k, 0) for k in range(LEAST_PERIODS - 1)] + [(k, 1) for k in range(LEAST_PERIODS - 2)]:
            x = at + step * period + ahead  # the word after a grid point lies in the run too, if p > 1 and one more period follows
            same = items[x] == items[x + period]
            if ahead:
                same |= period == 1
            at, period = at[same], period[same]
        found.append((at, period))
        p = last + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (start, length, period), by start and then period, of the runs of each text, given as arrays of word numbers of 0 or more."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    points = {i: g for i, t in enumerate(texts) if len(t) >= LEAST_WORDS and len((g := grid(t))[0])}
    group: list[int] = []
    for i in [*points, None]:
        if group and (i is None or sum(len(texts[k]) for k in group) + len(texts[i]) > TOGETHER):
            _runs_of(texts, group, points, out)
            group = []
        if i is not None:
            group.append(i)
    return out


def _runs_of(texts: list[np.ndarray], group: list[int], points: dict, out: list[np.ndarray]) -> None:
    sizes = np.array([len(texts[i]) + 1 for i in group])
    base = np.cumsum(sizes) - sizes + 1  # a word that occurs once stands before, between and after the texts
    items = np.zeros(sizes.sum() + 1, np.int64)
    items[np.concatenate(([0], base + sizes - 1))] = -1 - np.arange(len(group) + 1)
    for i, b in zip(group, base, strict=True):
        items[b : b + len(texts[i])] = texts[i]
    n = len(items)
    of = np.repeat(np.arange(len(group)), [len(points[i][0]) for i in group])
    p = np.concatenate([points[i][1] for i in group])
    at = np.concatenate([points[i][0] for i in group]) + base[of]
    ahead = Extensions(items).of(at, at + p)
    back = Extensions(items[::-1]).of(n - at, n - at - p)  # of the words before both
    start, length = at - back - base[of], ahead + back + p
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
    of, start, length, p = (x[long] for x in (of, start, length, p))
    order = np.lexsort((p, length, start, of))
    rows = np.column_stack((of, start, length, p))[order]
    first = np.ones(len(rows), bool)  # of the periods of one stretch; all others are its multiples
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(group) + 1))
    for k, i in enumerate(group):
        out[i] = rows[cuts[k] : cuts[k + 1], 1:]


def periodic(items: np.ndarray, h: int | None) -> np.ndarray:
    """The words' numbers with a periodic end where ``h`` is a multiple of ten: word i of it becomes word a + (i - a) % p."""
    n = len(items)
    if h is None or h % 10 or not n:
        return items
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return items[np.where(i < a, i, a + (i - a) % p)]


def collapse(texts: list[bytes | None], ids: list[int | None] | None = None) -> Iterator[tuple[np.ndarray, bytes]]:
    """Of each text its runs and its words, joined by a space, without what a run repeats of its first period.

    With ``ids``, the words are first made periodic as the id's checksum says.
    """
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    items = []
    for k, t in enumerate(texts):
        w = (t or b"").split()  # at \x20 and \x09 to \x0D, as bytes are split
        x = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
        items.append(x if ids is None or ids[k] is None else periodic(x, zlib.crc32(str(ids[k]).encode())))
    names = list(number)
    for x, found in zip(items, runs(items), strict=True):
        change = np.zeros(len(x) + 1, np.int64)
        np.add.at(change, found[:, 0] + found[:, 2], 1)
        np.add.at(change, found[:, 0] + found[:, 1], -1)
        yield found, b" ".join([names[k] for k in x[np.cumsum(change[:-1]) == 0].tolist()])


def detect(docs: DataFrame) -> DataFrame:
    """Of every row of ``docs`` its number of runs, the longest one, and digests of all runs and of the text without repeats.

    Rows are looked at where they stand: nothing is shuffled. A null or empty text has no words and so no runs; a null id leaves its
    text as it is; very long texts are taken whole, with memory in proportion; repeated rows get a row each; of runs of equal
    length the first, then that of the smaller period, is given. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for i, (found, kept) in zip(ids, collapse(b.column(1).to_pylist(), ids), strict=True):
                best = (None,) * 4
                if len(found):
                    s, n, p = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
                    best = (s, n, p, 1000 * n // p)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
                rows.append((i, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)
