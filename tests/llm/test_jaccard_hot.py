"""op7 on rows that repeat id and text very often: one of them is compared."""

import os

from pyspark.sql import functions as F

from stackloom.llm import jaccard_join


def words(n, start=0):
    return " ".join(f"word{i}" for i in range(start, start + n))


def test_equal_rows_are_compared_once(spark, monkeypatch, tmp_path):
    held = []
    compare = jaccard_join._compare
    folder = str(tmp_path)

    def counted(batches):
        def seen():
            for b in batches:
                with open(f"{folder}/{id(b)}", "w") as f:
                    f.write(str(b.num_rows))
                yield b

        yield from compare(seen())

    monkeypatch.setattr(jaccard_join, "_compare", counted)
    a, b, other = words(100), words(100).replace("word50 ", "changed "), words(80, 1000)
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(a).alias("text"))
    rows = rows.unionByName(spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit(other).alias("text"))).unionByName(spark.createDataFrame([(3, b), (9, other.replace("word1040 ", "x ")), (11, "one"), (12, None)], "doc_id long, text string"))
    got = {(r["doc_id"], r["text_id"], r["class_id"], r["n_links"]): r["n"] for r in jaccard_join.join(rows).groupBy("doc_id", "text_id", "class_id", "n_links").agg(F.count("*").alias("n")).collect()}
    assert got == {(None, None, 3, 100_000): 100_000, (3, 3, 3, 100_000): 1, (7, 7, 7, 500): 500, (9, 9, 7, 500): 1, (11, 11, 11, 0): 1, (12, 12, 12, 0): 1}
    for f in os.listdir(folder):
        held.append(int(open(f"{folder}/{f}").read()))
    assert sum(held) == 4
