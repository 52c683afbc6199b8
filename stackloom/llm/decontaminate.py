"""Benchmark decontamination, in DataFrame expressions only.

Items are cut into parts of ``PART`` words, and windows of that size lie at every word of every document. Parts and
windows have SimHash fingerprints of 64 bits, whose ``RADIUS + 1`` blocks are joined: fingerprints within the radius
agree in one block at least, so the join loses none of them. A document and an item that so meet are verified exactly:
windows of the item's size at every start, by the share of the item's shingles, with their weights, that a window has.

Parts rather than whole items, as whole ones would need a radius no block can serve: at a similarity of 0.8 about
a fifth of the bits differ, which leaves blocks of three or four bits. A window of m shingles at 0.8 has at most d = m / 5
that do not fit, so what fits stands in few unbroken runs, the longest with a whole part of an item whose parts start
often enough (see ``stride``). Its fingerprint is at distance 0 then; the radius adds parts with edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm.common import ID, Scratch, keep, small
from stackloom.llm.native import grams, hashes, let, words

#: Words of a shingle and least similarity.
K, LEAST = 5, 0.8
#: Words of a part, Hamming radius, and the bits of each block.
PART, RADIUS = 7, 2
BLOCKS = (21, 21, 22)
#: A row of the documents (rows may share an id), and an item with its length and shingles.
ROW = ["doc_id", "digest", "item_id", "item_digest", "len", "m"]


def shingles(h: Column, k: int = K) -> Column:
    """Shingle hashes of an array of word hashes; one of all words if there are fewer than k."""
    return F.when(F.size(h) >= k, grams(h, k)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def rolled(h: Column, k: int) -> Column:
    """Hashes of all k words in a row of an array of word hashes (bound by let), equal to those of shingles()."""
    if k == K:
        return grams(h, K)
    return F.transform(_starts(h, k), lambda x, i: F.xxhash64(F.slice(h, i + 1, F.lit(k))))


def _starts(h: Column, size: int) -> Column:
    return F.slice(h, F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(0)))


def _majority(a: Column, b: Column, c: Column) -> Column:
    return a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseOR(b)))


def windows(h: Column, size: int = PART) -> Column:
    """SimHash of the words of each window of ``size`` (at most 7) words, at every start: a bit is set if more than half of the words have it.

    All 64 bits are counted at once: three words give a sum bit and a carry, and two such triples and a seventh word are
    at least four of seven where two of the three carries are set. Smaller windows are filled up evenly with ones and zeros.
    """
    ones = (PART - size) // 2
    if size == PART:
        at = lambda v, i: F.get(v, i)
        sums = F.transform(h, lambda x, i: x.bitwiseXOR(at(h, i + 1)).bitwiseXOR(at(h, i + 2)))
        carries = F.transform(h, lambda x, i: _majority(x, at(h, i + 1), at(h, i + 2)))
        return let(sums, lambda s: let(carries, lambda c: F.transform(_starts(h, size), lambda x, i: _majority(at(c, i), at(c, i + 3), _majority(at(s, i), at(s, i + 3), at(h, i + 6))))))

    def one(x: Column, i: Column) -> Column:
        v = [F.get(h, i + j) for j in range(size)] + [F.lit(-1).cast("long")] * ones + [F.lit(0).cast("long")] * (PART - size - ones)
        s = [v[j].bitwiseXOR(v[j + 1]).bitwiseXOR(v[j + 2]) for j in (0, 3)]
        return _majority(_majority(*v[:3]), _majority(*v[3:6]), _majority(s[0], s[1], v[6]))

    return F.transform(_starts(h, size), one)


def keys(fp: Column) -> Column:
    """The blocks of a fingerprint, each with its number in the bits above it."""
    out, at = [], 0
    for b, bits in enumerate(BLOCKS):
        out.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(b << 32)))
        at += bits
    return F.array(*out)


def stride(m: Column, size: int, least: float = LEAST) -> Column:
    """Words from one part's start to the next such that every window that reaches ``least`` of an item has a whole part.

    At most d shingles do not fit. Two runs of shingles that fit are apart by four that do not, where no word of the item repeats; half of that
    is assumed here. So the longest of at most d / 2 + 1 runs has a share of the m - d that fit.
    """
    d = F.floor(m * (1 - least) + 1e-9)
    run = F.ceil((m - d) / (F.floor(d / 2) + 1)) + (K - 1)
    return F.greatest(run - size + 1, F.lit(1)).cast("int")


def parts(items: DataFrame, size: int, least: float = LEAST) -> DataFrame:
    """key, part (its fingerprint), item_id, item_digest of the items whose parts have ``size`` words."""
    mine = items.where(F.least("len", F.lit(PART)) == size)
    at = F.sequence(F.lit(0), F.col("len") - size, stride(F.col("m"), size, least))
    fps = mine.select("item_id", "item_digest", F.explode(let(windows(F.col("ih"), size), lambda f: F.transform(at, lambda o: F.get(f, o)))).alias("part"))
    return fps.distinct().select(F.explode(keys(F.col("part"))).alias("key"), "part", "item_id", "item_digest")


def coverage(found: DataFrame, least: float) -> DataFrame:
    """The columns of ROW, start and shared (weight of the item's shingles that the window at that start has), where that is enough.

    ``found`` holds ROW, the shingle, its weight in the item and a position in the document. A shingle counts in a window
    as often as the item has it: one at p, whose repeat that many places before is at q, counts for the starts from
    q + 1, or where the window ends with it, to p. Sums change at the ends of these ranges only, and a best window,
    the first of equal ones, is where one begins.
    """
    of_row = Window.partitionBy(*ROW)
    at = found.groupBy(*ROW, "shingle", "weight").agg(F.array_sort(F.collect_set("pos")).alias("ps"))
    at = at.withColumn("total", F.sum(F.least(F.size("ps"), F.col("weight"))).over(of_row)).where(F.col("total") / F.col("m") >= least)
    at = at.select(*ROW, "weight", "ps", F.posexplode("ps").alias("i", "p")).withColumn("q", F.get("ps", F.col("i") - F.col("weight").cast("int")))
    first = F.greatest(F.lit(0), F.col("p") - (F.col("len") - F.least("len", F.lit(K))), F.coalesce(F.col("q") + 1, F.lit(0)))
    ends = at.select(*ROW, F.explode(F.array(F.struct(first.alias("start"), F.lit(1).alias("n")), F.struct((F.col("p") + 1).alias("start"), F.lit(-1).alias("n")))).alias("e"))
    sums = ends.groupBy(*ROW, F.col("e.start").alias("start")).agg(F.sum("e.n").alias("n"))
    return sums.withColumn("shared", F.sum("n").over(of_row.orderBy("start"))).where(F.col("shared") / F.col("m") >= least).drop("n")


def candidates(docs: DataFrame, items: DataFrame, scratch: Scratch, least: float = LEAST) -> DataFrame:
    """doc_id, digest, item_id, item_digest, hamming: pairs with a window and a part whose fingerprints are within the radius."""
    out = None
    for size in sorted(r[0] for r in items.select(F.least("len", F.lit(PART))).distinct().collect()):  # one pass where no item has fewer than seven words
        of_items = scratch.save(parts(items, size, least))
        at = docs.select("doc_id", "digest", F.explode(let(hashes(words(F.col("text"))), lambda h: windows(h, size))).alias("fp")).select("doc_id", "digest", "fp", F.explode(keys(F.col("fp"))).alias("key"))  # noqa: B023
        apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("part")))
        met = at.join(small(of_items), "key").where(apart <= RADIUS).groupBy("doc_id", "digest", "item_id", "item_digest").agg(F.min(apart).alias("hamming"))
        out = met if out is None else out.unionByName(met)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, digest long, item_id long, item_digest long, hamming int")
    return scratch.save(out)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, start and words (of the window, in words), hamming (of the nearest part), similarity: the best window of each pair that reaches ``least``.

    Items without a word match nothing; items of fewer than five words match where all their words stand in a row. Null and empty
    texts have no words; very long ones are searched whole. Rows that share an id count as one document, with the best window of any of them; repeated items are one.
    Ties go to the first window. Extra columns are not read.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        items = benchmark.select(F.col("item_id").cast("long"), hashes(words(F.col("text"))).alias("ih"))
        items = items.where(F.size("ih") > 0).select("item_id", F.xxhash64("ih").alias("item_digest"), F.size("ih").alias("len"), shingles(F.col("ih")).alias("ish"), "ih").withColumn("m", F.size("ish"))
        items = scratch.save(items.dropDuplicates(["item_id", "item_digest"]))
        d = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), F.col("text").cast("string").alias("text"))
        pairs = candidates(d, items, scratch, least)
        rows = scratch.save(pairs.select(F.col("doc_id").alias("doc_id_"), F.col("digest").alias("digest_")).distinct())
        same = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("digest") == F.col("digest_"))
        read = scratch.save(d.join(small(rows), same).select("doc_id", "digest", hashes(words(F.col("text"))).alias("h")))
        anchors = scratch.save(items.select("item_id", "item_digest", "len", "m", F.explode("ish").alias("shingle")).groupBy(*ROW[2:], "shingle").agg(F.count("*").alias("weight")))
        found = None
        for k in sorted(r[0] for r in items.select(F.least("len", F.lit(K))).distinct().collect()):
            at = read.select("doc_id", "digest", F.posexplode(let(F.col("h"), lambda h: rolled(h, k))).alias("pos", "shingle")).join(small(anchors.where(F.least("len", F.lit(K)) == k)), "shingle")  # noqa: B023
            found = at if found is None else found.unionByName(at)
        if found is None:
            return keep(spark.createDataFrame([], "doc_id long, item_id long, start int, words int, hamming int, similarity double"))
        p = pairs.select(*(F.col(c).alias(f"{c}_") for c in pairs.columns))
        one = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("digest") == F.col("digest_")) & F.col("item_id").eqNullSafe(F.col("item_id_")) & (F.col("item_digest") == F.col("item_digest_"))
        met = coverage(found.join(small(p), one, "left_semi"), least).join(small(p), one)
        best = F.max(F.struct((F.col("shared") / F.col("m")).alias("similarity"), (-F.col("start")).alias("back"), F.col("len"), (-F.col("hamming_")).alias("h"))).alias("x")
        out = met.groupBy("doc_id", "item_id").agg(best)
        return keep(out.select("doc_id", "item_id", (-F.col("x.back")).alias("start"), F.col("x.len").alias("words"), (-F.col("x.h")).alias("hamming"), F.col("x.similarity").alias("similarity")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with their columns, see leaks(); texts move only if there are too many leaking ids to broadcast.

    A row whose id is that of a leaking one goes too; null ids are one id.
    """
    bad = keep(leaks(docs, benchmark).select(F.col("doc_id").alias(ID)).distinct())
    return docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col(ID)), "left_anti")
