"""Near-duplicate join on the Jaccard similarity of word shingles, with Bayesian pruning of candidates.

Equal texts, by digest, are one class and are compared once, through one row. Texts that share a bucket of a MinHash band
are candidates. They meet in groups: the texts of a component of buckets, or those of one bucket where that moves
fewer copies, as in a component that chance has chained together. A group is cut into blocks, and each pair of blocks is one
unit of work: for its pairs that share a band (in a bucket's group: no earlier one, so that each pair counts once), MinHash
values are compared a few at a time, and a pair is dropped as soon as the posterior probability that it reaches the
threshold falls below a tolerance; the rest is verified exactly on the shingles. A unit returns counts of links and a
spanning forest of them, not the pairs, so a group of n copies moves and returns rows in proportion to n for each block,
however many pairs it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import textkernels as tk
from stackloom.llm.common import ID, Scratch, groups, keep, small, spread
from stackloom.llm.graph import components

#: Words of a shingle, threshold as a fraction, bands and rows of a band, hashes compared at a time, tolerance, texts of a block.
K, LEAST, BANDS, ROWS, STEP, TOLERANCE, BLOCK = 5, (4, 5), 24, 5, 15, 1e-6, 128
HASHES = BANDS * ROWS
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each hash function over the shingles, in pieces that fit the cache."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for s in range(0, len(shingles), 1024):
        h = shingles[s : s + 1024]
        np.minimum(out, ((h * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(1), out=out)
    return out.astype(np.uint32)


def bands(sketches: np.ndarray) -> np.ndarray:
    """The bucket of each band, for each row of a matrix of sketches."""
    rows = sketches.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for r in range(ROWS):
        h = tk.mix(h + rows[:, :, r])
    return h.view(np.int64)


def fewest(tolerance: float = TOLERANCE, least: tuple[int, int] = LEAST) -> list[int]:
    """For each number of hashes compared, the fewest matches for which P(similarity >= threshold) is at least the tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), so that probability is the one of
    at most m successes in n + 1 draws at the threshold.
    """
    t, out = least[0] / least[1], [0]
    for n in range(1, HASHES + 1):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two sketch matrices that no step drops."""
    match = np.zeros(len(i), np.int64)
    for s in range(0, HASHES, STEP):
        match = match + (a[i, s : s + STEP] == b[j, s : s + STEP]).sum(1)
        ok = match >= need[s + STEP]
        i, j, match = i[ok], j[ok], match[ok]
        if not len(i):
            break
    return i, j


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """Whether each pair of sorted shingle sets has the least Jaccard similarity, by whole numbers."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(i) <= 2 * len(sets):
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    else:  # many pairs: incidence matrices over a piece of the vocabulary at a time
        rows = np.repeat(np.arange(len(sets)), size)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        both = np.zeros((len(sets), len(sets)))
        for s in range(0, int(column[-1]) + 1, 4096):
            lo, hi = np.searchsorted(column, (s, s + 4096))
            m = np.zeros((len(sets), 4096), np.float32)
            m[rows[lo:hi], column[lo:hi] - s] = 1
            both += m @ m.T
        shared = np.rint(both[i, j]).astype(np.int64)
    return shared * least[1] >= (size[i] + size[j] - shared) * least[0]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what the given pairs connect, without circles."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            up[a] = b
            out.append((x, y))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text) to (doc_id, h, bands), for texts with a word."""
    for b in batches:
        sets = [tk.shingles(t.as_py(), K) for t in b.column(2)]
        has = np.array([len(s) > 0 for s in sets], bool)
        flat = bands(np.array([minhash(s) for s in sets if len(s)], np.uint32)).ravel()
        made = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(has)) for c in b.columns[:2]), made], ["doc_id", "h", "bands"])


def _member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a text by its sketch and shingles; a node that comes again is left out."""
    seen: set[int] = set()
    for b in batches:
        nodes = b.column(b.schema.get_field_index("node")).to_pylist()
        new = [n not in seen and not seen.add(n) for n in nodes]
        b = b if all(new) else b.filter(pa.array(new))
        s = [tk.shingles(t.as_py(), K) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([minhash(x).tobytes() for x in s], pa.binary()), pa.array([x.tobytes() for x in s], pa.large_binary()).cast(pa.binary())], [*b.schema.names[1:], "sketch", "shingles"])


def sharing(buckets: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: int | None = None) -> np.ndarray:
    """Which pairs share a band; with ``bucket`` given, which have it as the first band that they share."""
    same = buckets[i] == buckets[j]
    some = same.any(1)
    return some if bucket is None else some & (buckets[i, same.argmax(1)] == bucket)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, n) of each pair of blocks: n links of text a where b is null, else an edge of the forest."""
    need = fewest()
    for t in groups(batches, ["bucket", "unit", "x", "y"]):
        ids, first = np.unique(t["node"].to_numpy(), return_index=True)
        t = t.take(pa.array(first))
        copies, block = t["copies"].to_numpy(), t["block"].to_numpy()
        bucket, unit, x, y = (t[c][0].as_py() for c in ("bucket", "unit", "x", "y"))
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint32).reshape(-1, HASHES)
        if x == y:
            i, j = np.triu_indices(len(ids), 1)
        else:
            left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        ok = sharing(bands(sketch), i, j, unit if bucket else None)
        i, j = survivors(sketch, sketch, i[ok], j[ok], need)
        if not len(i):
            continue
        sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
        ok = verified(sets, i, j)
        i, j = i[ok], j[ok]
        n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        linked = np.flatnonzero(n)
        edges = forest(len(ids), i, j)
        a = np.concatenate((ids[linked], ids[[e[0] for e in edges]] if edges else ids[:0]))
        b = [None] * len(linked) + [int(ids[e[1]]) for e in edges]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.concatenate((n[linked], np.zeros(len(edges)))).astype(np.int64))], ["a", "b", "n"])


def digest(text: str = "text"):
    return F.unhex(F.md5(F.col(text).cast("string").cast("binary")))


def places(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """node, places: the groups (unit, bucket or component, blocks) in which each text of ``buckets`` (node, band, lo, n) is compared.

    A component's texts meet as one group or, where that sends fewer copies to pairs of blocks, bucket by bucket.
    """
    near = scratch.save(components(buckets.where("node <> lo").select(F.col("node").alias("u"), F.col("lo").alias("v")), scratch))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("long")
    of_node = buckets.groupBy("node").agg(F.sum(blocks("n")).alias("apart")).withColumnRenamed("node", "node_")
    near = scratch.save(near.join(of_node, F.col("node") == F.col("node_")).drop("node_"))
    groups_ = near.groupBy(F.col("root").alias("root_")).agg(F.count("*").alias("size"), F.sum("apart").alias("apart_"))
    at = scratch.save(spread(near, "root", groups_, "root_", "size", F.col("node"), near.count()).select("node", "root", blocks("size").alias("blocks"), (F.col("apart_") < F.col("size") * blocks("size")).alias("by_bucket")))
    whole = at.where(~F.col("by_bucket")).select("node", F.struct(F.col("root").alias("unit"), F.lit(False).alias("bucket"), "blocks").alias("place"))
    single = buckets.join(at.where("by_bucket").select(F.col("node").alias("node_")), F.col("node") == F.col("node_"), "left_semi").select("node", F.struct(F.col("band").alias("unit"), F.lit(True).alias("bucket"), blocks("n").alias("blocks")).alias("place"))
    return whole.unionByName(single).groupBy("node").agg(F.collect_set("place").alias("places"))


def classified(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h) of ``docs``, h being the digest of the text, and a row (h_, rep, copies, first, n_links) for each text.

    ``rep`` is the smallest doc_id of the text, and ``first`` the smallest (null last) doc_id and text of its class. Both are written.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("h", digest())
    keyed = scratch.save(d.select("doc_id", "h"))
    classes = scratch.save(keyed.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).select(F.col("h").alias("h_"), "rep", "copies", F.monotonically_increasing_id().alias("node")))
    one = (F.col("h") == F.col("h_")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    banded = scratch.save(d.where("h is not null").select("doc_id", "h", "text").mapInArrow(_sketch, "doc_id long, h binary, bands array<long>"))
    texts = classes.count()
    # rows that repeat id and text, or copies without any id, are one from here on
    texts_ = scratch.save(banded.join(small(classes, texts), one).groupBy("node").agg(F.first("bands").alias("bands"), F.count("*").alias("same")))
    rows = texts_.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy(F.col("band").alias("band_")).agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi")
    buckets = scratch.save(spread(rows, "band", shared, "band_", "n", F.col("node"), BANDS * texts).select("node", "band", "lo", "n"))
    at = places(buckets, scratch).withColumnRenamed("node", "node_")
    members = scratch.save(at.join(classes, F.col("node_") == F.col("node")).drop("node_").join(texts_.select("node", "same"), "node").select("h_", "rep", "node", "copies", "places", "same"))

    def made(members: DataFrame) -> DataFrame:
        """The sketch and shingles of each row with a member's text and id; repeated ones once a task."""
        sizes = members.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
        rows = d.join(small(members, sizes[0], sizes[1]), one).select("text", "node", "copies", "places")
        return rows.mapInArrow(_member, "node long, copies long, places array<struct<unit:bigint,bucket:boolean,blocks:bigint>>, sketch binary, shingles binary")

    rows, again = made(members.where("same = 1")), members.where("same > 1")
    if again.take(1):
        rows = rows.unionByName(made(again).dropDuplicates(["node"]))
    rows = rows.withColumn("p", F.explode("places")).select("node", "copies", "p.*", "sketch", "shingles").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("node", "copies", "block", "bucket", "unit", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "sketch", "shingles")
    order = ("bucket", "unit", "x", "y")
    found = scratch.save(rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compare, "a long, b long, n long"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    linked = components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    linked = scratch.save(linked.join(classes, "node").select("node", "root", F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("doc_id"), F.col("h_").alias("h")).alias("own")))
    roots = linked.groupBy(F.col("root").alias("root_")).agg(F.min("own").alias("first"), F.count("*").alias("size"))
    firsts = spread(linked, "root", roots, "root_", "size", F.col("node"), linked.count()).select(F.col("node").alias("node_"), "first")
    info = classes.join(links, F.col("node") == F.col("a"), "left").join(firsts, F.col("node") == F.col("node_"), "left")
    own = F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("doc_id"), F.col("h_").alias("h"))
    return keyed, scratch.save(info.select("h_", "rep", "copies", F.coalesce("first", own).alias("first"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))


def _rows(keyed: DataFrame, info: DataFrame) -> DataFrame:
    """Every row with its text's; a text of very many copies is dealt over several tasks."""
    return spread(keyed.withColumn("by", F.xxhash64("doc_id", F.spark_partition_id())), "h", info, "h_", "copies", F.col("by"), keyed.count(), "left")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, class_id, n_links of every row.

    ``text_id`` is the smallest doc_id with an equal text, ``class_id`` the smallest that is linked with the row, directly
    or in a chain, and ``n_links`` the number of other rows with an equal or similar text. Texts of fewer than five
    words are compared as one shingle; texts without a word are linked to equal ones only, null texts to none; very long ones
    are compared whole. Rows that share an id are told apart by their text. Rows with a null id count as copies but have a
    null class if no other row of it has an id. Extra columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        out = _rows(*classified(docs, scratch))
        return keep(out.select("doc_id", F.coalesce("rep", "doc_id").alias("text_id"), F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, with its columns, of each class of join(): that of the smallest id (null last), then of the smallest text digest; of
    rows that repeat both, one. Rows of null text stay."""
    names = ("__stackloom_h", "__stackloom_n")
    with Scratch(docs.sparkSession) as scratch:
        made = _rows(*classified(docs, scratch)).where("h is not null")
        made = keep(made.groupBy(F.col("doc_id").alias(ID), F.col("h").alias(names[0])).agg(F.count("*").alias(names[1]), F.first(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))).alias("chosen")))
    same = F.col("doc_id").eqNullSafe(F.col(ID)) & (digest() == F.col(names[0]))
    out = docs.join(small(keep(made.where("not chosen").select(ID, names[0]))), same, "left_anti")
    again = keep(made.where(F.col("chosen") & (F.col(names[1]) > 1)).select(ID, names[0]))
    rows = again.count()
    if rows:
        twice = docs.join(small(again, rows), same, "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(small(again, rows), same, "left_anti").unionByName(twice)
    return out
