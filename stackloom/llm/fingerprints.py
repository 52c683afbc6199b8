"""Document fingerprints by winnowing, in DataFrame expressions only.

Hashes of ``K`` words in a row are rolled over a text; of each window of ``WINDOW`` of them the smallest is kept, of
equal ones the rightmost, once. Any passage of K + WINDOW - 1 words that two texts share gives both a common hash. A
selected hash and its position are packed into one long (33 bits of hash above 30 bits of the position's complement),
so that the minimum of a window prefers the rightmost of equal hashes, and positions stay known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm.common import small
from stackloom.llm.native import grams, hashes, let, words

K, WINDOW = 3, 6
_TOP = (1 << 30) - 1
#: Documents of one bucket of the order by id, and most buckets.
BUCKET_ROWS, BUCKETS = 500, 200_000
_FIRST = -(1 << 62)
#: The type of a place in the order: an id above 60 bits of a hash.
KEY = "decimal(38,0)"


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The packed fingerprint of a text, by position. Texts of fewer than k words have one hash of all; without words, none."""

    def select(v: Column) -> Column:
        minima = F.transform(
            F.slice(v, F.lit(1), F.greatest(F.size(v) - (window - 1), F.lit(0))),
            lambda x, i: F.least(x, *(F.get(v, i + j) for j in range(1, window))),
        )
        return F.when(F.size(v) == 0, v).when(F.size(v) < window, F.array(F.array_min(v))).otherwise(F.array_distinct(minima))

    def pack(g: Column) -> Column:
        return F.transform(g, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 31), 30).bitwiseOR(F.lit(_TOP) - i))

    def rolled(h: Column) -> Column:
        return F.when(F.size(h) >= k, grams(h, k)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes(words(text)), lambda h: let(pack(rolled(h)), select))


def positions(fingerprint: Column) -> Column:
    """(hash, position of its first word) of a packed fingerprint."""
    return F.transform(fingerprint, lambda x: F.struct(F.shiftright(x, 30).alias("hash"), (F.lit(_TOP) - x.bitwiseAND(F.lit(_TOP))).cast("int").alias("position")))


def shown(fingerprint: Column) -> Column:
    """A packed fingerprint as text: ``hash:position`` of each, the hash in hex, by position, joined by commas."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(":", F.lower(F.hex(F.shiftright(x, 30))), (F.lit(_TOP) - x.bitwiseAND(F.lit(_TOP))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two packed fingerprints; 1 for two without any, 0 if one has none."""
    plain = lambda f: F.array_distinct(F.transform(f, lambda x: F.shiftright(x, 30)))
    return let(plain(a), lambda x: let(plain(b), lambda y: let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(n / (F.size(x) + F.size(y) - n)))))


def _bucket(key: Column, cuts: list) -> Column:
    """The number of cuts that are not above the key, by a search of two levels."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    rows = [[int(c) for c in cuts[i : i + step]] for i in range(0, len(cuts), step)]
    heads = F.from_json(F.lit(str([r[0] for r in rows])), f"array<{KEY}>")
    inner = F.from_json(F.lit(str(rows)), f"array<array<{KEY}>>")
    at = F.size(F.filter(heads, lambda c: c <= key))
    return let(at, lambda j: F.when(j == 0, F.lit(0)).otherwise((j - 1) * step + F.size(F.filter(F.get(inner, j - 1), lambda c: c <= key))))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and fingerprint of every row with those of the next one (``next_text``, ``next_fingerprint``) in descending id.

    Rows of one id are ordered by a hash of their text, null ids come last; the last row is followed by the first, a single
    row by itself. The order, of ids and hashes as one number, is cut into buckets at its quantiles, so no task sorts all rows, nor all
    of an id that very many rows share: texts are shuffled once, by bucket, and each bucket also gets a copy of the row that
    follows it.
    """
    own = F.shiftrightunsigned(F.xxhash64("text"), 4)
    key = (F.coalesce(F.col("doc_id"), F.lit(_FIRST)).cast(KEY) * F.lit(1 << 60).cast("decimal(19,0)")).cast(KEY) + own.cast("decimal(19,0)")
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key.cast(KEY))
    n = docs.count()
    parts = min(BUCKETS, n // BUCKET_ROWS)
    cuts: list = []
    if parts > 1:
        got = d.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], min(1_000_000, 20 * parts))).first()[0]
        cuts = sorted(set(got))
    d = d.withColumn("bucket", _bucket(F.col("key"), cuts))
    # a row a bucket at most, so BUCKETS rows at most
    heads = sorted(((r["bucket"], r["key"]) for r in d.groupBy("bucket").agg(F.max("key").alias("key")).collect()), reverse=True)
    spark = docs.sparkSession
    # the head of each bucket also ends the one above; the head of the top ends the lowest
    ends = spark.createDataFrame([(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)], f"key_ {KEY}, to_ int")
    tails = d.join(small(ends, len(heads)), F.col("key") == F.col("key_")).groupBy("doc_id", "key", "to_").agg(F.max("text").alias("text"))
    tails = tails.select("doc_id", "text", "key", F.col("to_").alias("bucket"), F.lit(True).alias("tail"))
    both = d.withColumn("tail", F.lit(False)).unionByName(tails).repartition("bucket")
    both = both.withColumn("fingerprint", winnow(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("tail", F.desc("key"), F.desc("text"))
    both = both.withColumns({"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)})
    return both.where(~F.col("tail")).drop("tail", "key", "bucket")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the beginning of the next document.

    Null texts are empty, empty ones have an empty fingerprint, very long ones are fingerprinted whole. Repeated rows are fingerprinted each.
    Extra columns are not read.
    """
    d = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    d = d.withColumn("edited_fp", winnow(F.col("edited")))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("fingerprint")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.size("fingerprint").alias("n_hashes"),
    )
