"""Language identification by a string kernel.

The blended-spectrum presence kernel counts the character n-grams (of the lengths ``SPANS``) that two
texts share, each once, and is normalised by the counts of either text. Landmark texts give a
Nyström map; one-versus-rest ridge regression is solved in that map. As the kernel is a product of presence
vectors, the weights of all landmarks fold into one matrix (n-gram bucket x language), and a batch of texts
is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import textkernels as tk
from stackloom.llm.common import held_out

#: Lengths of the n-grams, and buckets that the n-grams of one length are hashed into.
SPANS, BUCKETS = (2, 3, 4), 1 << 14
WIDTH = len(SPANS) * BUCKETS
#: Bound of the training sample in all, landmarks, and ridge.
SAMPLE, LANDMARKS, RIDGE = 2400, 192, 1e-3
UNKNOWN = "und"
#: Least score of a decision. Below it are texts of a word or two, and those that are numbers and signs for the most part; of the
#: held-out rows at sf0.1 it keeps 0.998.
LEAST = 0.3
#: Rows of one matrix product.
ROWS = 64
_SPACE = np.array([32], np.uint32)
_K1, _K2, _K3, _SHIFT = np.uint32(0x9E3779B1), np.uint32(0x01000193), np.uint32(0x85EBCA6B), np.uint32(32 - (BUCKETS.bit_length() - 1))


def grams(text: str | None) -> np.ndarray | None:
    """Buckets of the n-grams of a text, with repeats; None where there is no letter."""
    codes = tk.points((text or "").lower())
    letter = tk.alpha(codes)
    if not letter.any():
        return None
    first = letter.copy()
    first[1:] |= letter[:-1]  # one space for a run of other characters
    codes = np.concatenate((_SPACE, np.where(letter, codes, _SPACE)[first], _SPACE)) * _K1
    out, h = [], codes
    for n in range(2, max(SPANS) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * _K2 + codes[n - 1 :]
        if n in SPANS:
            out.append((h * _K3 >> _SHIFT) + np.uint32(SPANS.index(n) * BUCKETS))
    return np.concatenate(out)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # WIDTH x (languages + 1); the last column is one, so it counts a text's n-grams


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Learns from texts and non-null languages of rows outside the held-out fold; None if there are none.

    ``sample`` bounds (in expectation) the labelled rows used, shared equally by the languages and picked by
    a hash of the id. Executors turn them into n-gram buckets, so the driver gets no text.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    each = max(16, sample // len(langs))
    part = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, each / counts[k]))])
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part[F.col("lang")] * (1 << 30)).select("doc_id", "lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [grams(t) for t in b.column(2).to_pylist()]
            got = [None if g is None else np.unique(g).tobytes() for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], ["doc_id", "lang", "g"])

    rows = picked.mapInArrow(features, "doc_id long, lang string, g binary").where("g is not null").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["g"]))
    sets = [np.frombuffer(r["g"], np.uint32) for r in rows]
    # landmarks in turn from each language
    turn: dict[str, int] = {}
    order = []
    for i, r in enumerate(rows):
        turn[r["lang"]] = turn.get(r["lang"], 0) + 1
        order.append((turn[r["lang"]], r["lang"], i))
    marks = [i for _, _, i in sorted(order)[:landmarks]]
    lm = np.zeros((len(marks), WIDTH), np.float32)
    for j, i in enumerate(marks):
        lm[j, sets[i]] = 1 / np.sqrt(len(sets[i]))
    by_gram = np.ascontiguousarray(lm.T)
    k = np.stack([by_gram[s].sum(0) / np.sqrt(len(s)) for s in sets]).astype(np.float64)  # rows x landmarks
    value, vector = np.linalg.eigh(k[marks])
    ok = value > 1e-8 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])
    phi = k @ root
    y = np.array([[r["lang"] == x for x in langs] for r in rows], np.float64)
    y /= np.maximum(1, y.sum(0)) * len(langs) / len(rows)  # languages weigh alike
    gram = phi.T @ phi
    beta = np.linalg.solve(gram + ridge * len(rows) * np.eye(len(gram)), phi.T @ np.minimum(y, 1))
    w = lm.T @ (root @ beta).astype(np.float32)
    return Model(langs, np.concatenate([w, np.ones((WIDTH, 1), np.float32)], 1))


def scored(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, ``ROWS`` of them in one matrix product. Texts without a letter get UNKNOWN and 0."""
    lang, value = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return lang, value
    p = np.zeros((ROWS, WIDTH), np.float32)
    for s in range(0, len(texts), ROWS):
        got = [(i, g) for i in range(s, min(s + ROWS, len(texts))) if (g := grams(texts[i].as_py())) is not None]
        for j, (_, g) in enumerate(got):
            p[j, g] = 1
        out = p[: len(got)] @ model.weights
        out = out[:, :-1] / np.sqrt(out[:, -1:])
        for j, (i, g) in enumerate(got):
            p[j, g] = 0
            best = int(out[j].argmax())
            lang[i], value[i] = model.langs[best], min(1.0, max(0.0, float(out[j, best])))
    return lang, value


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; whole texts, in the order and partitions they come in.

    Null texts and texts without a letter get ``und`` and 0; so do all rows where nothing could be learned. Very long texts count by
    their distinct n-grams, all of them. Repeated rows are scored each; ties go to the first language by name. Extra columns are not read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, value = scored(b.column(2), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(value)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the labelled rows of ``docs`` and predicts all of them."""
    return predict(docs, fit(docs))


def keep_identified(docs: DataFrame, least: float = LEAST, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs``, with their columns, whose language is known with a score of ``least`` or more and, if they are given, is one of ``languages``.

    Rows without a letter, and those with too little text of any language for a decision, go. An unknown ``lang`` is filled with the
    prediction. Rows are decided where they stand, so no text is shuffled; where nothing could be learned, no row stays.
    """
    model = fit(docs)
    names = docs.columns

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, value = scored(b.column(names.index("text")), model)
            ok = (value >= least) & np.array([x != UNKNOWN and (languages is None or x in languages) for x in lang], bool)
            known = b.column(names.index("lang"))
            filled = pa.array([p if k is None else k for k, p in zip(known.to_pylist(), lang, strict=True)], known.type)
            yield b.set_column(names.index("lang"), "lang", filled).filter(pa.array(ok))

    return docs.mapInArrow(passed, docs.schema)
