"""Mixing sources to target weights by pivotal dependent rounding.

A source whose words are to be taken at a rate r takes each document floor(r) times, and once more with the
probability r - floor(r). These probabilities are rounded together: two documents at a time, words move at random
from one to the other until one of them is whole, which keeps the source's words and each document's chance. Buckets
of a source are rounded by themselves; what is left of each bucket, one document, meets in the next level of a
reduction tree, so a source of any size ends within one document of its target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import ID, Scratch, keep, small

MOST = 3.0
#: Documents of a bucket, and residuals that meet in one node of the tree.
BUCKET, FAN_IN, SEED = 1500, 1000, 7
WORDS = r"coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0)"


def targets(sizes: dict[str | None, int], weights=(1, 2, 3), most: float = MOST) -> dict[str | None, float]:
    """Target words of each source: shares of all words by weights that repeat over the sources in code point order, null
    last; none above ``most`` times its size, what is above goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    open_, left = list(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * sizes[s] for s in above}
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    return out


def pivot(sizes: np.ndarray, chance: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Rounds chances to 0 and 1, keeping the sum of sizes by chances; at most one stays between, none if ``last``."""
    p = chance.copy()
    draws = rng.random(len(p) + 1)
    at = -1  # the document that is not whole yet
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if at < 0:
            at = j
            continue
        a, b = sizes[at], sizes[j]
        up, down = min(a * (1 - p[at]), b * p[j]), min(a * p[at], b * (1 - p[j]))
        if draws[j] * (up + down) < down:
            p[at], p[j] = (1.0 if up == a * (1 - p[at]) else p[at] + up / a), (0.0 if up == b * p[j] else p[j] - up / b)
        else:
            p[at], p[j] = (0.0 if down == a * p[at] else p[at] - down / a), (1.0 if down == b * (1 - p[j]) else p[j] + down / b)
        for i in (at, j):
            p[i] = 0.0 if p[i] < 1e-12 else 1.0 if p[i] > 1 - 1e-12 else p[i]
        at = next((i for i in (at, j) if 0 < p[i] < 1), -1)
    if last and at >= 0:
        p[at] = float(draws[-1] < p[at])
    return p


def _node(level: int, seed: int):
    """Rounds one bucket of a source, in the order of hashed ids."""

    def node(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        source, bucket = (k.as_py() for k in key)
        rng = np.random.default_rng([seed, level, 0 if source is None else 1 + xxhash.xxh32_intdigest(source.encode()), bucket])
        p = pivot(t["size"].to_numpy().astype(np.float64), t["chance"].to_numpy(), rng, bucket == 0 and t["buckets"][0].as_py() == 1)
        return t.set_column(t.schema.get_field_index("chance"), "chance", pa.array(p))

    return node


def mix(docs: DataFrame, weights=(1, 2, 3), most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row.

    Documents fall into buckets by a hash of their id and text and are paired in the order of it, so reruns agree however the
    input is split, and rows of one id are spread. Null and empty texts have no words and take none; very long ones count whole; repeated rows
    are drawn each; an empty table gives an empty result. The totals of the sources come to the driver, one row each.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        sized = scratch.save(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.expr(WORDS).cast("long").alias("size"), F.xxhash64("doc_id", F.col("text").cast("string"), F.lit(seed)).alias("order")))
        totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        goal = targets({r["source"]: r["size"] for r in totals}, weights, most)
        rows = [(r["source"], r["size"], goal[r["source"]], min(most, goal[r["source"]] / r["size"]) if r["size"] else 0.0, max(1, -(-r["n"] // BUCKET))) for r in totals]
        plan = spark.createDataFrame(rows, "source_ string, source_size long, target double, rate double, buckets long")
        now = sized.join(small(plan, len(rows)), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
        now = now.select("*", F.floor("rate").cast("long").alias("base"), F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("chance")).withColumn("bucket", F.pmod(F.col("order"), F.col("buckets")))
        schema = now.schema
        level, widest, done = 0, max((r[4] for r in rows), default=1), []

        while True:
            now = scratch.save(now.groupBy("source", "bucket").applyInArrow(_node(level, seed), schema))
            between = (F.col("chance") > 0) & (F.col("chance") < 1)
            done.append(now.where(~between))
            if widest == 1:
                break
            widest, level = -(-widest // FAN_IN), level + 1
            now = now.where(between).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long")).withColumn("buckets", F.ceil(F.col("buckets") / FAN_IN).cast("long"))
        out = done[0]
        for x in done[1:]:
            out = out.unionByName(x)
        copies = F.when(F.col("size") > 0, F.col("base") + F.col("chance").cast("long")).otherwise(F.lit(0)).cast("long")
        return keep(out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies")))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with how often (``copies``) and the words that makes (``taken``).

    The texts are joined once, by id, and move only if there are too many ids to broadcast; rows that share an id all get the largest copies among them.
    """
    made = mix(docs)
    one = made.groupBy(F.col("doc_id").alias(ID)).agg(*(F.max(c).alias(c) for c in ("size", "source_size", "target", "taken", "copies"))).where("copies > 0")
    clash = [c for c in one.columns if c in docs.columns]
    return docs.drop(*clash).join(small(keep(one)), F.col("doc_id").eqNullSafe(F.col(ID))).drop(ID)
