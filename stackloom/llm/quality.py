"""Document quality by a regularised quadratic discriminant.

Each class has its own mean and a covariance shrunk towards its diagonal and towards the pooled one; a text's
score is the posterior of label 1 from the difference of the two Gaussian log densities, whose Mahalanobis
distances use Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import textkernels as tk
from stackloom.llm.common import Scratch, held_out, keep

FEATURES = ("chars", "words", "word_length", "letters", "upper", "digits", "symbols", "bars", "exclaims", "distinct", "repeats", "lines", "short")
THRESHOLD, SHRINK, POOL = 0.3, 0.05, 0.05


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; zeros where it has no character."""
    t = text or ""
    n = len(t)
    if not n:
        return [0.0] * len(FEATURES)
    codes = tk.points(t)
    letter, space = tk.alpha(codes), (codes == 32) | ((codes >= 9) & (codes <= 13))
    starts, ends = tk.runs(~space)
    w = max(1, len(starts))
    h = tk.span_hashes(codes, starts, ends)
    lines = t.split("\n")
    plain = letter | space
    stop = (codes == 46) | (codes == 44)
    digit = (codes >= 48) & (codes <= 57)

    def share(x: float, of: float, usual: float, weight: float) -> float:
        """A share as an angle, which spreads values near 0 and 1; drawn to the usual value where a text has little to count."""
        return float(np.arcsin(np.sqrt(min(1.0, (x + usual * weight) / (of + weight)))))

    return [
        float(np.log1p(n)),
        float(np.log1p(len(starts))),
        float(np.log1p(((ends - starts).sum() + 5 * 10) / (len(starts) + 10))),
        share(letter.sum(), n, 0.8, 60),
        share(tk.upper(codes).sum(), letter.sum(), 0.03, 60),
        share(digit.sum(), n, 0, 400),
        share((~(plain | stop | digit)).sum(), n, 0, 60),
        share((codes == 124).sum(), w, 0, 10),
        share((codes == 33).sum(), w, 0, 10),
        share(len(np.unique(h)), w, 0.8, 20),
        share(len(lines) - len(set(lines)), len(lines), 0, 10),
        float(np.log1p((n + 600) / (len(lines) + 2))),
        share(((ends - starts) <= 3).sum(), w, 0.45, 20),
    ]


@dataclass
class Model:
    means: np.ndarray
    factors: np.ndarray  # inverses of the lower Cholesky factors
    offsets: np.ndarray  # log prior less half the log determinant


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text, read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in np.ascontiguousarray(x.T))], ["doc_id", *FEATURES])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{f} double" for f in FEATURES)]))


def fit(stats: DataFrame, labels: DataFrame, shrink: float = SHRINK, pool: float = POOL) -> Model | None:
    """Class moments over all labelled rows outside the held-out fold, summed where the rows are; None unless both labels occur."""
    d = len(FEATURES)
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long"), "quality")
    sums = [F.sum(f) for f in FEATURES] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i in range(d) for j in range(i, d)]
    rows = stats.join(marked, "doc_id").groupBy("quality").agg(F.count("*"), *sums).collect()
    if len(rows) < 2:
        return None
    means, covs, ns = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
    for r in rows:
        q, n, m, s = r[0], r[1], np.array(r[2 : 2 + d]), np.zeros((d, d))
        s[np.triu_indices(d)] = r[2 + d :]
        s = (s + s.T - np.diag(np.diag(s))) / n
        means[q], ns[q] = m / n, n
        covs[q] = s - np.outer(means[q], means[q])
    pooled = (covs * ns[:, None, None]).sum(0) / ns.sum()
    factors, offsets = [], []
    for q in (0, 1):
        c = (1 - pool) * covs[q] + pool * pooled
        c = (1 - shrink) * c + shrink * np.diag(np.diag(c)) + 1e-4 * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(ns[q] / ns.sum()) - np.log(np.diag(low)).sum())
    return Model(means, np.array(factors), np.array(offsets))


def score(stats: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; without a model every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]])
            p = np.full(len(x), 0.5)
            if model:
                log = [model.offsets[q] - 0.5 * (((x - model.means[q]) @ model.factors[q].T) ** 2).sum(1) for q in (0, 1)]
                p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", held_out().alias("held_out"), *FEATURES).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every row of ``docs``. Statistics are written once (texts are read once) and dropped at the end.

    Null and empty texts have zero statistics and get the score of these; very long ones are measured whole; repeated rows are
    scored each, and a label that is repeated counts as often. Extra columns of either table are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        stats = scratch.save(measure(docs))
        return keep(score(stats, fit(stats, labels)))
