"""Toxicity by a subsequence string kernel and a support vector machine.

The units of a sentence are its words, in lower case, with what is no letter left out; letters that stand alone in a row are one
unit, too, and of a letter many times in a row two stay. The kernel of two units counts the subsequences of three and four letters (word boundaries are letters as well) that both have, each
weighted by DECAY for every letter that it leaps over in either, so a word with inserted or missing letters still resembles itself. Landmark
units give a Nyström map, in which a support vector machine is trained. The kernel is a product of (hashed) subsequence weights, so the
landmarks' coefficients fold into one weight for each subsequence, and texts are scored by table look-ups.

Labels are of texts, not of words: a toxic text has a toxic word somewhere, a clean one few or none (multiple instances). Statistics of
letter groups point to first witnesses in the sentences of toxic texts, the machine then names better ones and harder counterexamples;
witnesses count with a letter inserted, too. A text's score is the chance that at least one of its highest units is toxic, each by a logistic function.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import textkernels as tk
from stackloom.llm.common import Scratch, held_out

#: Bounds, in expectation, of the labelled rows of either label that are learned from; landmarks; the machine's ridge.
SAMPLE, LANDMARKS, RIDGE = {1: 2000, 0: 8000}, 600, 1e-4
#: A prediction is 1 from here.
THRESHOLD = 0.7
#: Weight of a leap; letters and widest span of a subsequence; buckets of their hashes (a power of two).
DECAY, SPANS, BUCKETS = 0.6, {3: 5, 4: 6}, 1 << 18
#: Offsets and weight of each way to take a subsequence from a position on, and the squared norm of what one position has.
PATTERNS = [((0, *rest), DECAY ** (rest[-1] + 1 - k)) for k, span in SPANS.items() for rest in combinations(range(1, span), k - 1)]
NORM = sum(w * w for _, w in PATTERNS)
#: Four letters in a row, for the first statistics.
PLAIN = [((0, 1, 2, 3), 1.0)]
PAD = 6
#: Code points and letters that are worked on together; units, and landmarks, likewise.
TOGETHER, ROWS, SOME = 1 << 20, 4096, 64
#: Units of a text that its score depends on (the highest ones), and letters that are kept of a unit that is learned from.
TOP, KEPT = 8, 40
#: Of these, the ones that a clean and a toxic text of the sample give to learn from.
KEEP = (3, 8)
#: A unit of a toxic text is a witness if it scores above the highest units of this share of clean texts: by the first statistics, by a machine.
CLEAN = (0.9, 0.96)
#: The score of a unit that is not there.
NONE = -9.0
#: Stands for an inserted letter in what is learned from; subsequences leap over it.
INSERTED = "\U0010fffe"
#: Share of labels that may be wrong.
NOISE = 0.03
_K, _M, _SHIFT = np.uint32(0x01000193), np.uint32(0x9E3779B1), np.uint32(32 - (BUCKETS.bit_length() - 1))
_GAP, _HALF = np.uint32(0xFFFFFFFF), np.uint32(15)
_SPACE = {32: True, 9: True, 10: True, 11: True, 12: True, 13: True, 0x85: True, 0xA0: True, 0x2028: True, 0x3000: True}


@dataclass
class Stream:
    """Letters of texts with 0 between units; ``first`` and ``last`` bound the units (from the 0 before, to the 0 after), ``of`` is their text."""

    letters: np.ndarray
    first: np.ndarray
    last: np.ndarray
    of: np.ndarray


def stream(texts: list[str | None]) -> Stream:
    codes = [tk.points((t or "").lower()) for t in texts]
    gap = np.full(PAD, _GAP, np.uint32)
    c = np.concatenate([gap, *(x for t in codes for x in (t, gap))])
    doc = np.repeat(np.arange(len(texts) + 1, dtype=np.int32), [PAD, *(len(t) + PAD for t in codes)])
    sep = c == _GAP
    letter = np.zeros(len(c), bool)
    letter[~sep] = tk.alpha(c[~sep])
    space = np.isin(c, np.array(list(_SPACE), np.uint32))
    keep = letter | space | sep
    c, doc, sep, space = c[keep], doc[keep], sep[keep], space[keep]
    keep = ~space
    keep[1:] |= ~(space | sep)[:-1]
    c, doc = np.where(space | sep, 0, c)[keep].astype(np.uint32), doc[keep]
    z = c == 0
    alone = np.zeros(len(c), bool)  # a boundary between two single letters
    alone[2:-2] = z[2:-2] & z[:-4] & z[4:] & ~z[1:-3] & ~z[3:-1]
    c, doc = c[~alone], doc[~alone]
    again = np.zeros(len(c), bool)  # of one letter many times in a row two stay
    again[2:] = (c[2:] != 0) & (c[2:] == c[1:-1]) & (c[2:] == c[:-2])
    c, doc = c[~again], doc[~again]
    zeros = np.flatnonzero(c == 0)
    unit = np.flatnonzero(np.diff(zeros) > 1)
    return Stream(c, zeros[unit], zeros[unit + 1], doc[zeros[unit] + 1] - 1)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that share a stream."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + PAD
        if size and size + n > TOGETHER:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def _left(c: np.ndarray) -> np.ndarray:
    """From each position the letters to the next boundary, PAD at most: no subsequence goes beyond it."""
    at = np.where(c == 0, np.arange(len(c)), len(c) + PAD)
    left = np.full(len(c), PAD, np.int8)
    left[:-1] = np.minimum(np.minimum.accumulate(at[::-1])[::-1][1:] - np.arange(len(c) - 1), PAD)
    return left


def _buckets(c: np.ndarray, left: np.ndarray, n: int, patterns: list) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern the buckets of the subsequences that begin at the first n positions, which of them stay within their unit, and their weight."""
    powers = [c * _K ** np.uint32(k) for k in range(4)]
    for offsets, weight in patterns:
        h = powers[0][offsets[-1] : offsets[-1] + n] + np.uint32(len(offsets))
        for k, o in enumerate(reversed(offsets[:-1]), 1):
            h = h + powers[k][o : o + n]
        h = (h ^ (h >> _HALF)) * _M
        yield (h ^ (h >> _HALF)) * _M >> _SHIFT, left[:n] >= offsets[-1], weight


def unit_scores(s: Stream, table: np.ndarray, patterns: list = PATTERNS) -> np.ndarray:
    """The kernel expansion's value of each unit, without the machine's offset."""
    c, left = s.letters, _left(s.letters)
    total = np.zeros(len(c) + 1)
    for k in range(0, len(c) - PAD, TOGETHER):
        n = min(TOGETHER, len(c) - PAD - k)
        for bucket, within, weight in _buckets(c[k : k + n + PAD], left[k : k + n], n, patterns):
            total[k + 1 : k + n + 1] += table[bucket] * (within * np.float32(weight))
    total = np.cumsum(total)
    return (total[s.last] - total[s.first]) / np.sqrt((s.last - s.first) * sum(w * w for _, w in patterns))


def tops(s: Stream, scores: np.ndarray, texts: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The highest scores of each text (NONE where it has fewer units) and their units (-1)."""
    value, unit = np.full((texts, top), NONE), np.full((texts, top), -1)
    order = np.lexsort((-scores, s.of))
    of = s.of[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    take = rank < top
    value[of[take], rank[take]], unit[of[take], rank[take]] = scores[order][take], order[take]
    return value, unit


def spelled(s: Stream, unit: int) -> str:
    """The letters of a unit, the first KEPT of them."""
    return "".join(map(chr, s.letters[s.first[unit] + 1 : min(s.last[unit], s.first[unit] + 1 + KEPT)].tolist()))


def features(unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a unit's subsequences, divided by its norm, as unit_scores() sums them; an INSERTED letter has none."""
    c = np.concatenate((np.zeros(1, np.uint32), tk.points(unit), np.zeros(PAD + 1, np.uint32)))
    n = len(unit) + 1
    known = c != ord(INSERTED)
    got = []
    for (bucket, ok, weight), (offsets, _) in zip(_buckets(c, _left(c), n, PATTERNS), PATTERNS, strict=True):
        for o in offsets:
            ok = ok & known[o : o + n]
        got.append((bucket[ok], np.full(ok.sum(), weight)))
    return np.concatenate([b for b, _ in got]).astype(np.int32), np.concatenate([w for _, w in got]) / np.sqrt(n * NORM)


@dataclass
class Model:
    table: np.ndarray  # a weight for each bucket
    offset: float
    slope: float  # of a unit's logistic function
    centre: float

    def probability(self, top: np.ndarray) -> np.ndarray:
        """That at least one of a text's units is toxic."""
        return any_of(top + self.offset, self.slope, self.centre)


def any_of(top: np.ndarray, slope: float, centre: float) -> np.ndarray:
    return 1 - np.prod(1 / (1 + np.exp(np.clip(slope * (top - centre), -50, 50))), 1)


def link(top: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and centre of the logistic function that make the labels likeliest, by ever finer grids."""
    best, width = (8.0, 0.25), (7.5, 1.25)
    for _ in range(4):
        grid = [(s, c) for s in np.linspace(best[0] - width[0], best[0] + width[0], 16) for c in np.linspace(best[1] - width[1], best[1] + width[1], 16)]

        def loss(g: tuple[float, float]) -> float:
            p = NOISE + (1 - 2 * NOISE) * any_of(top, *g)
            return float(-(weight * np.log(np.where(y > 0, p, 1 - p))).sum())

        best = min((g for g in grid if g[0] > 0.4), key=loss)
        width = (width[0] / 5, width[1] / 5)
    return float(best[0]), float(best[1])


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by Newton steps over the support vectors; the last column of x is the constant."""
    n = x.shape[1]
    beta = np.zeros(n)
    for _ in range(30):
        sv = y * (x @ beta.astype(x.dtype)) < 1
        h, g = ridge * weight.sum() * np.eye(n), np.zeros(n)
        for s in range(0, len(x), ROWS):
            part = x[s : s + ROWS][sv[s : s + ROWS]].astype(np.float64)
            w = weight[s : s + ROWS][sv[s : s + ROWS]]
            h += (part * w[:, None]).T @ part
            g += part.T @ (w * y[s : s + ROWS][sv[s : s + ROWS]])
        new = np.linalg.solve(h, g)
        if np.allclose(new, beta, atol=1e-6):
            break
        beta = new
    return beta


def kernels(units: list, marks: list) -> np.ndarray:
    """The kernel of each unit with each landmark, both given as features(); a few landmarks at a time, so that their weights stay small."""
    out = np.zeros((len(units), len(marks)))
    for s in range(0, len(marks), SOME):
        some = marks[s : s + SOME]
        used = np.unique(np.concatenate([b for b, _ in some]))
        at = np.full(BUCKETS, len(used), np.int32)
        at[used] = np.arange(len(used))
        lm = np.zeros((len(used) + 1, len(some)))
        for j, (b, w) in enumerate(some):
            np.add.at(lm, (at[b], j), w)
        for i, (b, w) in enumerate(units):
            rows = at[b]
            on = rows < len(used)
            out[i, s : s + SOME] = w[on] @ lm[rows[on]]
    return out


def inserted(unit: str) -> list[str]:
    """A unit with an unknown letter after its second and its middle letter; none of a short unit."""
    return [unit[:k] + INSERTED + unit[k:] for k in dict.fromkeys((2, len(unit) // 2))] if len(unit) >= 4 else []


def train(units: list[str], y: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """The table and offset of a machine that tells units of label 1 from those of -1. Landmarks are taken in turn from either label, frequent units first."""
    count: dict[tuple[int, str], float] = {}
    for u, k in zip(units, y.tolist(), strict=True):
        count[k, u] = count.get((k, u), 0) + 1
        for v in inserted(u) if k > 0 else []:
            count[k, v] = count.get((k, v), 0) + 1
    order = sorted(count, key=lambda x: (-count[x], zlib.crc32(x[1].encode()), x))
    each = [[u for k, u in order if k == label] for label in (1, -1)]
    half = landmarks // 2
    marks = list(dict.fromkeys([*each[0][: max(half, landmarks - len(each[1]))], *each[1][: max(half, landmarks - len(each[0]))]]))
    found = [features(u) for u in marks]
    value, vector = np.linalg.eigh(kernels(found, found))
    ok = value > 1e-6 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])
    each_unit = list(count)
    x = np.ones((len(each_unit), root.shape[1] + 1), np.float32)
    for s in range(0, len(x), ROWS):
        x[s : s + ROWS, :-1] = kernels([features(u) for _, u in each_unit[s : s + ROWS]], found) @ root
    label, n = np.array([c for c, _ in each_unit], float), np.sqrt([count[u] for u in each_unit])
    for c in (1, -1):
        n[label == c] /= n[label == c].sum()  # labels weigh alike
    beta = machine(x, label, n, ridge)
    table = np.zeros(BUCKETS)
    for (b, w), c in zip(found, root @ beta[:-1], strict=True):
        np.add.at(table, b, w * c)
    return table.astype(np.float32), float(beta[-1])


def _labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: dict[int, int]) -> tuple[DataFrame, dict[int, float]]:
    """Text, label, key of the labelled rows that are learned from, and the share of each label's rows that was taken."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(folds=3, remainder=1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, sample[k] / n) for k, n in counts.items()}
    if len(share) < 2:
        return docs.limit(0), share
    part = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    picked = marked.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30)) < part * (1 << 30)).distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by the sample
    return scratch.save(rows.select("text", "toxic", F.xxhash64("doc_id", "text").alias("key"))), share


def _groups(sample: DataFrame) -> np.ndarray:
    """A table of how far four letters in a row are commoner in toxic texts than chance would have it; 0 where they are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            texts, labels = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), np.int64)
            for first, last in pieces(texts):
                s = stream(texts[first:last])
                (bucket, within, _), *_ = _buckets(s.letters, _left(s.letters), len(s.letters) - PAD, PLAIN)
                of = np.full(len(s.letters) - PAD, -1)
                for lo, hi, k in zip(s.first, s.last, s.of, strict=True):
                    of[lo:hi] = k
                on = within & (of >= 0)
                got = np.unique(of[on] * BUCKETS + bucket[on])
                np.add.at(n, (labels[first + got // BUCKETS], got % BUCKETS), 1)
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], ["bucket", "clean", "toxic"])

    counts = sample.mapInArrow(run, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic > 1")
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    table = np.zeros(BUCKETS, np.float32)
    for r in counts.collect():  # BUCKETS rows at most
        usual = (r["toxic"] + r["clean"]) * share
        table[r["bucket"]] = np.sqrt(max(0.0, r["toxic"] * np.log(r["toxic"] / usual)))
    return table


def _witnesses(sample: DataFrame, table: np.ndarray, patterns: list) -> list:
    """(key, toxic, scores, units) of every sampled text: its highest units, and of a clean text also one at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels, keys = (c.to_pylist() for c in b.columns)
            scores, units = [], []
            for first, last in pieces(texts):
                s = stream(texts[first:last])
                value, unit = tops(s, unit_scores(s, table, patterns), last - first)
                scores += value.tolist()
                begin = np.searchsorted(s.of, np.arange(last - first + 1))
                for i in range(last - first):
                    own, n = [int(u) for u in unit[i] if u >= 0], int(begin[i + 1] - begin[i])
                    units.append([spelled(s, u) for u in own[: KEEP[labels[first + i]]] + ([begin[i] + keys[first + i] % n] if n and not labels[first + i] else [])])
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(scores, pa.list_(pa.float64())), pa.array(units, pa.list_(pa.string()))], ["key", "toxic", "scores", "units"])

    rows = sample.mapInArrow(run, "key long, toxic int, scores array<double>, units array<string>").collect()
    return sorted(rows, key=lambda r: (r["key"], r["toxic"], r["units"]))


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE, rounds: int = 3) -> Model | None:
    """Learns from labelled rows outside the held-out fold, ``sample`` of each label at most (in expectation, by a hash of the id); None unless both labels occur.

    The driver gets the letter groups' table and a few units of each sampled text, never the texts. ``rounds`` machines are trained, each but the first on
    what its predecessor has found.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows, share = _labelled(docs, labels, scratch, sample)
        if len(share) < 2:
            return None
        table, patterns, offset = _groups(rows), PLAIN, 0.0
        hard: list[tuple[str, int]] = []
        for k in range(rounds):
            found, units = _witnesses(rows, table, patterns), []
            tops_ = sorted(r["scores"][0] for r in found if not r["toxic"])
            least = tops_[int(CLEAN[k > 0] * (len(tops_) - 1))] if tops_ else NONE
            for r in found:
                if r["toxic"]:
                    units += [(u, 1) for i, (u, v) in enumerate(zip(r["units"], r["scores"], strict=False)) if v > least or not (i or k)]
                else:
                    units += [(u, -1) for u in r["units"]]
            hard += [u for u in units if u[1] < 0]
            both = [u for u in units if u[1] > 0] + hard
            y = np.array([c for _, c in both])
            if len(set(y.tolist())) < 2:
                return None
            table, offset = train([u for u, _ in both], y, landmarks, ridge)
            patterns = PATTERNS
        last = _witnesses(rows, table, PATTERNS)
        x, y = np.array([r["scores"] for r in last]).reshape(-1, TOP), np.array([r["toxic"] for r in last])
        return Model(table, offset, *link(x + offset, y, np.array([1 / share[c] for c in y.tolist()])))


def scored(texts: list[str | None], model: Model | None) -> np.ndarray:
    """Scores of whole texts, many of them in one stream; 0 without a model."""
    out = np.zeros(len(texts))
    if model is None:
        return out
    for first, last in pieces(texts):
        s = stream(texts[first:last])
        out[first:last] = model.probability(tops(s, unit_scores(s, model.table), last - first)[0])
    return out


def predict(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; whole texts, in the order and partitions they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = scored(b.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(folds=3, remainder=1).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows and scores every row of ``docs``.

    Null and empty texts, and texts without a letter, have no unit and get the score of that, near 0; without both labels every score is 0. Very
    long texts are scored whole, with memory in proportion; repeated rows are scored each; a repeated label counts once, a
    document with both labels as both. Extra columns of either table are not read.
    """
    return predict(docs, fit(docs, labels))
