"""op12: the kernel against plain enumeration, the folded machine against its landmarks, held-out accuracy, gapped insults, odd rows."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.llm import registry, toxicity
from stackloom.llm.common import held_out

BIG = "/root/testdata/sf0.1"


def subsequences(unit):
    """Weight of every gapped subsequence of a unit with its boundaries, by enumeration."""
    s, out = f" {unit} ", {}
    for k, span in toxicity.SPANS.items():
        for at in combinations(range(len(s)), k):
            if at[-1] - at[0] < span:
                u = "".join(s[i] for i in at)
                out[u] = out.get(u, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1 - k)
    return out


def kernel(a, b):
    x, y = subsequences(a), subsequences(b)
    return sum(w * y[u] for u, w in x.items() if u in y) / (toxicity.NORM * np.sqrt((len(a) + 1) * (len(b) + 1)))


def hashed(a, b):
    v = np.zeros(toxicity.BUCKETS)
    bucket, w = toxicity.features(b)
    np.add.at(v, bucket, w)
    bucket, w = toxicity.features(a)
    return float(w @ v[bucket])


def test_kernel_equals_enumeration():
    for a, b in (("idiot", "idiot"), ("idiot", "idxiot"), ("worthless", "worthlles"), ("moron", "baron"), ("ab", "abc"), ("été", "étéé"), ("x", "y")):
        assert hashed(a, b) == pytest.approx(kernel(a, b), abs=1e-9)
    assert kernel("idiot", "idxiot") > 1.5 * kernel("idiot", "riot") > 0
    got = toxicity.features("id" + toxicity.INSERTED + "iot")[1]
    assert 0 < len(got) < len(toxicity.features("idxiot")[1])


def test_folded_table_gives_the_landmarks_scores():
    units, y = ["idiot", "moron", "clown", "idiots", "and", "there", "on", "more", "crowd"], np.array([1, 1, 1, 1, -1, -1, -1, -1, -1])
    table, offset = toxicity.train(units, y)
    s = toxicity.stream(["The idiots and, there; a moron!", None, "", "more on clown"])
    scores = toxicity.unit_scores(s, table) + offset
    names = [toxicity.spelled(s, k) for k in range(len(scores))]
    assert names == ["the", "idiots", "and", "there", "a", "moron", "more", "on", "clown"] and s.of.tolist() == [0] * 6 + [3] * 3
    for name, score in zip(names, scores.tolist(), strict=True):
        bucket, w = toxicity.features(name)
        assert score == pytest.approx(float(w @ table[bucket]) + offset, abs=1e-5)
    assert all((score > 0) == (name in ("idiots", "moron", "clown")) for name, score in zip(names, scores.tolist(), strict=True))
    value, unit = toxicity.tops(s, scores, 4, 2)
    assert {names[k] for k in unit[0]} == {"idiots", "moron"} and names[unit[3, 0]] == "clown" and (unit[1:3] == -1).all() and (value[1:3] == toxicity.NONE).all()


def test_streams_join_spaced_letters_and_leave_signs_out():
    names = lambda t: [toxicity.spelled(s, k) for s in [toxicity.stream([t])] for k in range(len(s.first))]
    assert names("you i d i o t, st*u-pid m.o.r.o.n no") == ["you", "idiot", "stupid", "moron", "no"]
    assert names("sooooo 1 2 a") == ["soo", "a"] and names(" \n") == names("12 !?") == []
    assert names("a b cd e") == ["ab", "cd", "e"]


def test_held_out_accuracy_and_gapped_insults(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.predict(docs, model).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hit >= 0.75 * sum(r["toxic"] for r in rows) and hit >= 0.95 * sum(r["predicted"] for r in rows)
    en = [r for r in rows if r["lang"] == "en"]
    assert sum(r["toxic"] == r["predicted"] for r in en) >= 0.98 * len(en)
    bad = ["what a stupid idiot", "you are an i.d.i.o.t", "so p a t h e t i c of them", "such a mo-ron", "this is w*o*r*t*h*l*e*s*s", "worthlless"]
    assert (toxicity.scored(bad, model) >= toxicity.THRESHOLD).all()
    assert (toxicity.scored(["the weather was nice and the day was long", "he is there and that is it", "", None, "12 !"], model) < 0.1).all()
    many = ["the day is long"] * 50 + bad[:1]
    assert toxicity.scored(many, model)[-1] == toxicity.scored(bad[:1], model)[0]


def test_query_and_odd_rows(spark):
    got = registry.QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert list(got[0].asDict()) == ["doc_id", "held_out", "score", "predicted"]
    words = ["good", "day", "house", "tree"]
    rows = [(k, " ".join(words) if k % 3 else f"{' '.join(words)} idiot") for k in range(60)] + [(100, None), (101, ""), (102, "!!"), (103, "tree " * 200_000 + "idiot"), (None, "an idiot"), (5, "house")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("key", F.lit(1)).withColumn("score", F.lit(2))
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 1) for k in range(60)] + [(None, 1, 1), (7, None, 1), (3, 1, 1)], "doc_id long, toxic int, n int").withColumn("text", F.lit("idiot"))
    out = toxicity.classify(d, labels).collect()
    assert len(out) == len(rows)
    for r, (k, t) in zip(out, rows, strict=True):
        assert r["predicted"] == ("idiot" in (t or "")), (k, r)
    assert {r["doc_id"]: r["held_out"] for r in out} == {r["doc_id"]: r["h"] for r in d.select("doc_id", held_out(folds=3, remainder=1).alias("h")).collect()}
    assert [r["score"] for r in toxicity.classify(d, labels.limit(0)).collect()] == [0.0] * len(rows)
    assert toxicity.classify(d.limit(0), labels).collect() == [] and toxicity.classify(d.limit(0), labels.limit(0)).collect() == []
