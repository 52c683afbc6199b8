"""Operators of the training-data pipeline against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stackloom.llm import common, decontaminate, fingerprints, jaccard_join, language_id, license_scan, mixing, pii, quality, registry, url_filter, warc
from stackloom.llm import textkernels as tk
from stackloom.llm.common import Scratch
from stackloom.llm.graph import components

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: What every operator must survive.
ODD = [(1, None), (2, ""), (3, "!!! ###"), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "wörd " * 30_000), (7, "\n\t \u3000\x00"), (None, "a text without an id, twice"), (None, "a text without an id, twice"), (8, "𝒳𝒴 \ud7ff émoji 😀 " * 3)]


def frame(spark, rows, extra=True):
    d = spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None if i == 4 else "s", len(t or "")) for i, t in rows], DOCS)
    if extra:  # names that the operators use themselves
        for c in ("size", "copies", "target", "taken", "key", "bucket", "h", "rep", "digest", "score", "start", "words", "doc_id_", "node"):
            d = d.withColumn(c, F.lit("x"))
    return d


def real(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def words(n, seed):
    r = random.Random(seed)
    return ["w" + str(r.randrange(4000)) for _ in range(n)]


def count(df):
    return len(df.collect())


def test_odd_rows_get_a_defined_result(spark):
    d, n = frame(spark, ODD), len(ODD)
    labels = spark.createDataFrame([(5, 1, 0), (4, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    lang = {r["doc_id"]: r for r in language_id.identify(d).collect()}
    assert [lang[i]["lang_pred"] for i in (1, 2, 3, 7)] == ["und"] * 4 and all(0 <= r["score"] <= 1 for r in lang.values())
    for got in (language_id.identify(d), license_scan.scan(d), mixing.mix(d), fingerprints.fingerprint(d), jaccard_join.join(d), pii.scan(d), quality.classify(d, labels)):
        assert count(got) == n
    assert count(pii.redact(d)) == n and pii.redact(d).columns == d.columns
    assert count(decontaminate.leaks(d, spark.createDataFrame([(0, None), (1, ""), (2, "one two three four five six")], "item_id long, text string"))) == 1
    assert {r["doc_id"] for r in language_id.keep_identified(d).collect()} & {1, 2, 3, 7} == set()
    kept = jaccard_join.one_of_each(d)
    assert kept.columns == d.columns and Counter(r["doc_id"] for r in kept.collect())[5] == 1
    assert "copies" in mixing.apply_mix(d).columns


def test_empty_tables(spark):
    d = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    outs = [language_id.identify(d), license_scan.scan(d), mixing.mix(d), fingerprints.fingerprint(d), jaccard_join.join(d), pii.scan(d), decontaminate.leaks(d, bench), quality.classify(d, labels), warc.round_trip(pages), url_filter.judge(pages), mixing.apply_mix(d), jaccard_join.one_of_each(d), decontaminate.decontaminate(d, bench)]
    assert [count(o) for o in outs] == [0] * len(outs)


def test_language_held_out_accuracy(spark):
    got = language_id.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").select("doc_id", "lang_pred")
    both = got.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(both) > 100 and sum(r["lang"] == r["lang_pred"] for r in both) / len(both) > 0.97


def test_folded_scores_equal_explicit_kernel_ridge(spark):
    """Scores by the kernel of every pair of texts and a dense solution of the ridge problem on the landmarks."""
    docs = real(spark, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"))
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    sets = {r["doc_id"]: set(language_id.grams(r["text"]).tolist()) for r in rows}
    kernel = lambda a, b: len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5
    fold = {r["doc_id"]: r["held_out"] for r in language_id.identify(docs).collect()}
    train = [(r["doc_id"], r["lang"]) for r in rows if r["lang"] and not fold[r["doc_id"]]]
    langs = sorted({x for _, x in train})
    turn, order = Counter(), []
    for i, x in train:
        turn[x] += 1
        order.append((turn[x], x, i))
    marks = [i for _, _, i in sorted(order)[:60]]
    k_nm = np.array([[kernel(i, m) for m in marks] for i, _ in train])
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    y = np.array([[x == z for z in langs] for _, x in train], float)
    y = np.minimum(y / (y.sum(0) * len(langs) / len(train)), 1)
    ridge = 1e-2
    alpha = np.linalg.pinv(k_nm.T @ k_nm + ridge * len(train) * k_mm, 1e-9) @ k_nm.T @ y  # landmarks may repeat
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.fit(docs, landmarks=60, ridge=ridge)).collect()}
    for r in rows:
        want = np.array([kernel(r["doc_id"], m) for m in marks]) @ alpha
        assert got[r["doc_id"]]["lang_pred"] == langs[int(want.argmax())] and abs(got[r["doc_id"]]["score"] - min(1, max(0, want.max()))) < 1e-3


def test_grams_and_the_stage(spark):
    a, b = (set(language_id.grams(t).tolist()) for t in ("the cat sat", "a cat that sat"))
    assert len(a & b) and language_id.grams("... 12") is None
    assert set(language_id.grams("The--CAT 9 sat")) == a
    docs = real(spark, "documents")
    more = spark.createDataFrame([(90001, "Q.", None, "s", 2), (90002, "12 34", None, "s", 5), (90003, docs.first()["text"], None, "s", 9)], DOCS)
    kept = {r["doc_id"]: r["lang"] for r in language_id.keep_identified(docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)).collect()}
    scores = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert kept.pop(90003) == docs.first()["lang"] and kept.keys() == {i for i, r in scores.items() if r["score"] >= language_id.LEAST}
    some = {r["doc_id"] for r in language_id.keep_identified(docs, languages=("en",)).collect()}
    assert some == {i for i, r in scores.items() if r["lang_pred"] == "en" and r["score"] >= language_id.LEAST}


def test_scores_equal_an_explicit_quadratic_discriminant(spark):
    """Densities of two Gaussians, with covariances and determinants by NumPy from the rows themselves. A repeated label counts twice."""
    docs, labels = real(spark, "documents"), real(spark, "labels")
    labels = labels.unionByName(labels.limit(1))
    x = {r["doc_id"]: np.array(r[1:]) for r in quality.measure(docs).collect()}
    fold = {r["doc_id"]: r["held_out"] for r in quality.classify(docs, labels).collect()}
    parts = [np.array([x[r["doc_id"]] for r in labels.collect() if r["quality"] == q and not fold[r["doc_id"]]]) for q in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    n = np.array([len(p) for p in parts])
    pooled = (covs[0] * n[0] + covs[1] * n[1]) / n.sum()
    log = {i: [] for i in x}
    for p, c, m in zip(parts, covs, n, strict=True):
        c = (1 - quality.POOL) * c + quality.POOL * pooled
        c = (1 - quality.SHRINK) * c + quality.SHRINK * np.diag(np.diag(c)) + 1e-4 * np.eye(len(c))
        inverse, size = np.linalg.inv(c), np.linalg.slogdet(c)[1]
        for i, v in x.items():
            d = v - p.mean(0)
            log[i].append(np.log(m / n.sum()) - 0.5 * size - 0.5 * d @ inverse @ d)
    for r in quality.classify(docs, labels).collect():
        a, b = log[r["doc_id"]]
        assert abs(r["score"] - 1 / (1 + np.exp(np.clip(a - b, -500, 500)))) < 1e-6 and r["predicted"] == (r["score"] >= 0.3)


def test_quality_held_out(spark):
    p = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{p}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{p}/documents.parquet").join(lab.select("doc_id"), "doc_id"), lab).where("held_out").join(lab, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.97


def test_license_scan_equals_sql_and_canonical_form(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = license_scan.scan(real(spark, "documents"))
    want = c.sql(registry.ORACLE_SQL["op2_license_scan"])
    assert sorted(map(str, (tuple(r[x] for x in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
    mit = next(t for i, t in license_scan.KNOWN if i == "MIT" and len(t) > 100)
    rows = [(1, "Copyright (c) 2020 A B\n" + mit.upper()), (2, mit.replace("sublicense", "sub-licence")), (3, mit + " more"), (4, "x\nlicensed under CC-BY-NC 4.0!\ny")]
    by = {r["doc_id"]: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert [by[i]["license"] for i in (1, 2, 3)] == ["MIT", "MIT", None] and by[4]["line_licenses"] == "CC-BY-NC-4.0"
    titled = {i: t for i, t in license_scan.KNOWN if len(t) > 200}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib"} <= titled.keys()
    by = {r["doc_id"]: r["license"] for r in license_scan.scan(frame(spark, [(k, "The " + x.upper() if x[:3] == "MIT" else x) for k, x in enumerate(titled.values())])).collect()}
    assert [by[k] for k in range(len(titled))] == list(titled)
    one = license_scan.scan(frame(spark, [(1, "licensed under the apache license version 3 05")])).select("digest")
    assert one.first()[0] == hashlib.sha256(b"licensed under the apache license version 3 05").hexdigest()


def test_license_lines_by_join_equal_those_looked_up(spark, monkeypatch):
    rows = [*ODD, (20, "x\nMIT\nReleased under the MIT License.\nreleased under the mit license"), (20, "other"), (21, "Licensed under CC BY-NC 4.0.")]
    want = sorted(map(str, license_scan.scan(frame(spark, rows)).collect()))
    monkeypatch.setattr(license_scan, "INLINE", 0)
    table = spark.createDataFrame([*license_scan.KNOWN, license_scan.KNOWN[0]], "license string, known string")
    assert sorted(map(str, license_scan.scan(frame(spark, rows), table).collect())) == want and any("n_license_lines=2" in r for r in want)


def test_lines_are_hashed_if_they_begin_as_a_known_form(spark, monkeypatch):
    known = (("X", "Sublicense granted here"), ("Y", "cc by nc 9"), ("Z", "\u0130d 7"))
    lines = ["** SUB-Licence granted here", "sublicense granted here", "Creative Commons Attribution Non-Commercial 9", "CC-BY-NC 9", "\u0130D 7", "granted here", "", "Copyright 2020 cc by nc 9", "\rcc by nc 9", "\u2028(c) a"]
    rows = [(i, x) for i, x in enumerate(lines)] + [(100, "\n".join(lines)), (101, None)]
    for k in (known, (*known, ("E", "Copyright 2020 me")), ()):
        got = sorted(map(str, license_scan.scan(frame(spark, rows), k).collect()))
        with monkeypatch.context() as m:
            m.setattr(license_scan, "INLINE", -1)
            assert sorted(map(str, license_scan.scan(frame(spark, rows), k).collect())) == got
        if k == known:
            assert sum("n_license_lines=1" in r for r in got) == 6 and any("n_license_lines=6" in r and "X,Y,Z" in r for r in got)


def test_targets_are_capped_and_reshared():
    t = mixing.targets({"b": 10, "a": 1000, None: 500, "c": 0})
    assert t["c"] == 0 and t["b"] == 30 and abs(sum(t.values()) - 1510) < 1e-9 and t["a"] * 1 == pytest.approx(t[None] * 1)


def test_pivot_keeps_words_and_chances():
    size, p = np.array([5.0, 9, 2, 7, 4]), np.array([0.3, 0.5, 0.9, 0.2, 0.6])
    runs = np.array([mixing.pivot(size, p, np.random.default_rng(s), True) for s in range(4000)])
    assert set(np.unique(runs)) <= {0.0, 1.0} and np.abs(runs.mean(0) - p).max() < 0.04
    assert np.abs((runs * size).sum(1) - (p * size).sum()).max() <= size.max()


def test_mix_targets_by_hand(spark):
    """Targets from the sources' words alone: shares of 1, 2, 3 in code point order, null last, none above three times its source."""
    rows = [(1, "a " * 100, "B"), (2, "a " * 50, "a"), (3, "a b c", "é"), (4, "a " * 300, None), (5, None, "a")]
    d = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    size = {"B": 100, "a": 50, "é": 3, None: 300}
    weight = dict(zip(["B", "a", "é", None], (1, 2, 3, 1), strict=True))
    want, left, names = {}, sum(size.values()), list(size)
    while True:
        over = [s for s in names if left * weight[s] / sum(weight[x] for x in names) > 3 * size[s] + 1e-9]
        if not over:
            break
        for s in over:
            want[s] = 3 * size[s]
        left, names = left - sum(want[s] for s in over), [s for s in names if s not in over]
    want |= {s: left * weight[s] / sum(weight[x] for x in names) for s in names}
    got = {r["doc_id"]: r for r in mixing.mix(d).collect()}
    for i, t, s in rows:
        assert got[i]["target"] == pytest.approx(want[s]) and got[i]["source_size"] == size[s] and got[i]["size"] == len((t or "").split())


def test_mix_reaches_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 7)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    d = real(spark, "documents")
    a = sorted(tuple(r) for r in mixing.mix(d).collect())
    assert a == sorted(tuple(r) for r in mixing.mix(d.repartition(7)).collect())
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in d.collect()}
    assert all(r[1] == sizes[r[0]] and r[4] <= 3 * r[1] for r in a)
    src = dict(d.select("doc_id", "source").collect())
    for s in set(src.values()):
        own = [r for r in a if src[r[0]] == s]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= max(r[1] for r in own)


def test_warc_round_trip(spark):
    big = "<p>" + "ü" * 100
    rows = [(5, "http://a/ b\r\n", big), (3, None, big), (4, "http://a", big), (1, "x", None), (2, "x", ""), (6, "x", "short"), (7, "x", "short"), (None, "x", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == hashlib.sha256(data).hexdigest()
        revisit = h == big and i != 3
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
        ids = []
    with Scratch(spark) as s:
        files = s.save(warc.write(warc.plan(pages, s), s.root + "/a"))
        assert sorted(r["payload"].decode() for r in warc.read(files, True).collect() if r["record_type"] == "response") == sorted([big, "", "", "short", "short"])
        for r in files.collect():
            with open(r["path"].removeprefix("file://"), "rb") as f:
                ids += [warc.parse(m)[0]["warc-record-id"] for m in warc.members(f)]
        assert len(set(ids)) == len(rows)
        with pytest.raises(Exception, match="records"):
            warc.read(files.withColumn("records", F.col("records") + 1)).collect()


def test_revisits_are_checked_against_their_response(spark):
    cols = "page_id long, payload_digest string, record_type string, refers_to long"
    good = spark.createDataFrame([(1, "a", "response", None), (2, "a", "revisit", 1)], cols)
    warc.verify(good)
    for bad in ([(1, "a", "response", None), (2, "b", "revisit", 1)], [(2, "a", "revisit", 1)]):
        with pytest.raises(ValueError, match="revisit"):
            warc.verify(spark.createDataFrame(bad, cols))


def test_warc_reader_rejects_damage():
    ok = warc.record(1, "u", b"payload", None, False, "x")
    assert [len(m) for m in warc.members(__import__("io").BytesIO(warc.record(1, "u", b"a" * 5_000_000, None, False, "x")))][0] > 5_000_000
    import io
    import zlib

    assert len(list(warc.members(io.BytesIO(ok + ok)))) == 2
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(ok[:-4])))
    raw = zlib.decompress(ok, 31)
    for bad in (raw.replace(b"payload", b"pAyload"), raw[:-2], b"x" + raw):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_fingerprints_equal_brute_force(spark):
    rows = [(i, " ".join(words(n, i))) for i, n in enumerate([0, 1, 2, 3, 5, 8, 9, 40, 200, 41])] + [(20, "x y " * 30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    h = {r["doc_id"]: r["g"] for r in d.select("doc_id", fingerprints.let(fingerprints.hashes(fingerprints.words(F.col("text"))), lambda x: fingerprints.grams(x, fingerprints.K)).alias("g")).collect()}
    got = {r["doc_id"]: [(x["hash"], x["position"]) for x in r["p"]] for r in d.select("doc_id", fingerprints.positions(fingerprints.winnow(F.col("text"))).alias("p")).collect()}
    for i, t in rows:
        g = [(x % 2**64) >> 31 for x in h[i]]
        if not g:
            assert len(got[i]) == bool(t)
            continue
        want = []
        for s in range(max(1, len(g) - fingerprints.WINDOW + 1)):
            w = g[s : s + fingerprints.WINDOW]
            p = max(j for j, x in enumerate(w) if x == min(w)) + s
            if (g[p], p) not in want:
                want.append((g[p], p))
        assert got[i] == want


@pytest.mark.parametrize("rows", [3, 500])
def test_edited_texts(spark, monkeypatch, rows):
    """All columns of the query: digests of edited texts, fingerprints of theirs made by themselves, and likenesses by Python sets."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", rows)
    d = real(spark, "documents")
    p = sorted(d.select("doc_id", "text").collect(), reverse=True)
    edited = {}
    for k, (i, t) in enumerate(p):
        m = len(t) // 3
        edited[i] = t[: len(t) - m] + p[(k + 1) % len(p)][1][:m]
    alone = spark.createDataFrame([*((i, "text", t) for i, t in p), *((i, "edited", t) for i, t in edited.items())], "doc_id long, kind string, text string")
    shown = {(r["doc_id"], r["kind"]): r["f"] for r in alone.select("doc_id", "kind", fingerprints.shown(fingerprints.winnow(F.col("text"))).alias("f")).collect()}
    sets = {k: {x.split(":")[0] for x in f.split(",")} - {""} for k, f in shown.items()}
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(d).collect()}
    assert len(got) == len(p)
    for k, (i, t) in enumerate(p):
        r, nxt = got[i], p[(k + 1) % len(p)][0]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown[i, "text"], shown[i, "edited"])
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near_edited"] - like(sets[i, "text"], sets[i, "edited"])) < 1e-12 and abs(r["near_next"] - like(sets[i, "text"], sets[nxt, "text"])) < 1e-12


def test_rows_of_one_id_are_split_over_buckets(spark, monkeypatch):
    """Null and repeated ids of very many rows fall into several buckets; every row is followed by the next, the last by the first."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 10)
    rows = [(None, f"null {i}") for i in range(90)] + [(5, f"five {i}") for i in range(60)] + [(i, f"t {i}") for i in range(10, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.with_next(d).select("doc_id", "text", "next_text", F.spark_partition_id().alias("p")).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == sorted((i or -1, t) for i, t in rows)
    follow = {r["text"]: r["next_text"] for r in got}
    seen, at = [], "t 39"
    while at not in seen:
        seen.append(at)
        at = follow[at]
    assert at == "t 39" and len(seen) == len(rows)
    assert [t for t in seen if t[0] == "t"] == [f"t {i}" for i in range(39, 9, -1)] and all(t[0] == "f" for t in seen[30:90]) and all(t[0] == "n" for t in seen[90:])


def test_url_rules_equal_brute_force(spark):
    urls = ["http://A.Example.COM/en/7x?q", "https://example.com/en/8", "http://x.net/de/", "http://b.example.net/de/81", "http://org/es/", "http://spam-farm.example.org", "http://notspam-farm.example.org/a", None, "no scheme", "http://", "ftp://u@h.org#/es/", "://com/en/", "http://ex.com:80/en/", "a://b://com/en/", "http://" + "a." * 50_000 + "example.com/en/7", "http://" + "a" * 50_000 + "com/en/", "http://xspam-farm.example.org/"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").unionByName(real(spark, "pages").select(F.col("page_id") + 1000, "url").toDF("page_id", "url"))
    rules = {h + p: (h, p, v) for h, p, v in url_filter.RULES}
    for r in url_filter.judge(d).join(d, "page_id").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [k for k, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit, key=len, default=None)
        blocked = any(host == h or host.endswith("." + h) for h in url_filter.BLOCKED_HOSTS)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, rules[rule][2] if rule else "block" if blocked else "allow"), r


def test_digest_collisions_are_told_apart():
    keys = np.array([5, 5, 9], np.int64)
    a = url_filter.DigestArray(keys, np.array([1, 2, 3]), np.frombuffer(b"abc", np.uint8), np.array([0, 1, 1]))
    mine = pytest.MonkeyPatch()
    mine.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x, seed=0: {b"a": 5, b"b": 5, b"z": 5, b"c": 9}.get(x, 1))
    assert a.find([b"b", b"a", b"z", b"c", b"q"]).tolist() == [1, 0, -1, 1, -1]
    mine.undo()


def test_digest_arrays_of_several_shards(spark, monkeypatch):
    """A list of many names, sorted and written by tasks: every name is found, no other, and nothing stays behind."""
    monkeypatch.setattr(url_filter, "SHARD", 50)
    names = [(f"h{i}.com", f"/p{i % 7}" if i % 3 else "", i % 2) for i in range(400)]
    entries = spark.createDataFrame([*names, ("h1.com", "/p1", 0)], "host string, path string, value int")
    with Scratch(spark) as scratch:
        index = url_filter.load(url_filter.store(entries, scratch.root))
        assert len(index.arrays) > 4
        got = index.find([(h + p).encode() for h, p, _ in names] + [b"h0.com/p", b"zzz"])
        assert got.tolist() == [v for _, _, v in names] + [-1, -1]
        assert index.reach == 8 and index.lengths == [0, 3]


def test_url_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    for name, got in (("op6_url_filter", url_filter.judge(real(spark, "pages"))), ("op4_warc", warc.round_trip(real(spark, "pages")))):
        want = c.sql(registry.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, (tuple(r[x] for x in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_host_suffixes_are_those_that_fit_the_list():
    for host in ("", "com", "a.com", "ab.c.com", ".com", "com.", "a..com", "abcdefg.com"):
        for reach in range(1, 12):
            every = {host[i:] for i in range(len(host)) if i == 0 or host[i - 1] == "."}
            got = {h for h, _ in url_filter.candidates(host, "/x", [0, 2], reach)} - {""}
            assert got == {h for h in every if len(h) <= reach} - {""}, (host, reach)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    base, rows = words(150, 1), []
    for i in range(40):  # a large group of near copies
        w = list(base)
        w[i * 3 % 150] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(words(60 + i, i))) for i in range(20)] + [(200 + i, rows[3][1]) for i in range(5)] + [(300, "short text"), (301, "Short, TEXT"), (302, "other text"), (303, "?!"), (304, "?!")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard_join.join(d).collect()}
    sets = {i: set(tk.shingles(t).tolist()) for i, t in rows}
    text = dict(rows)
    near = {i: {j for j in sets if j != i and (text[i] == text[j] or jaccard(sets[i], sets[j]) >= 0.8)} for i in sets}
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(n) for i, n in near.items()}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[i]["class_id"] == min(seen)
    assert {r["doc_id"] for r in jaccard_join.one_of_each(d).collect()} == {r["class_id"] for r in got.values()}


@pytest.mark.parametrize("mode", ["component", "bucket"])
def test_jaccard_join_in_both_groupings(spark, monkeypatch, mode):
    """A chain of near copies, whose ends are far apart, compared as one component and bucket by bucket."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2 if mode == "bucket" else 1000)
    base = words(150, 31)
    rows = []
    for i in range(30):
        rows.append((i, " ".join(base)))
        base = list(base)
        for k in range(3):
            base[(i * 5 + k) % 150] = f"e{i}"
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(d).collect()}
    sets = {i: set(tk.shingles(t).tolist()) for i, t in rows}
    assert got == {i: (0, sum(jaccard(sets[i], sets[j]) >= 0.8 for j in sets if j != i)) for i in sets}


def test_jaccard_join_of_ids_with_two_texts(spark):
    """(1, A), (1, B), (2, A'), (3, B') with A like A' and B like B': no link may be lost."""
    a, b = words(60, 41), words(60, 42)
    edit = lambda w: " ".join([*w[:-1], "edit"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, edit(a)), (3, edit(b)), (None, " ".join(words(60, 43))), (None, edit(words(60, 43))), (4, None), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(d).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (None, None, 1), (None, None, 1), (4, 4, 0), (4, 4, 0)], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(d).collect()), key=str)
    assert len(kept) == 5 and kept.count((4, None)) == 2 and {rows[0], rows[1]} <= set(kept) and sum(i is None for i, _ in kept) == 1


def test_spread_join_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB_ROWS", 3)
    left = spark.createDataFrame([(i, i % 7 if i % 2 else 0) for i in range(100)] + [(100, None)], "i long, k long")
    right = left.where("k is not null").groupBy(F.col("k").alias("k_")).agg(F.count("*").alias("n"), F.max("i").alias("m"))
    got = common.spread(left, "k", right, "k_", "n", F.col("i"), 101, "left").select("i", "m").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, left.join(right, left.k == right.k_, "left").select("i", "m").collect()), key=str)


def test_jaccard_recall_of_all_pairs(spark):
    """All pairs of documents that reach 0.8, by an inverted index, against the classes: nine in ten at the least, here all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r["doc_id"]: tk.shingles(r["text"]) for r in rows}
    held: dict[int, list[int]] = {}
    for i, s in sets.items():
        for x in s.tolist():
            held.setdefault(x, []).append(i)
    common_ = Counter((a, b) for v in held.values() if len(v) > 1 for k, a in enumerate(v) for b in v[k + 1 :])
    near = {p for p, n in common_.items() if 5 * n >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    group = {r["doc_id"]: r["class_id"] for r in jaccard_join.join(docs).collect()}
    assert len(near) > 50 and sum(group[a] == group[b] for a, b in near) / len(near) > 0.99


def test_pruning_needs_few_matches_and_components(spark):
    need = jaccard_join.fewest()
    assert need[0] == 0 and all(b - a in (0, 1) for a, b in zip(need, need[1:])) and need[-1] < 0.8 * jaccard_join.HASHES
    edges = [(i, i + 1) for i in range(30)] + [(100, j) for j in range(101, 130)] + [(200, 200)]
    with Scratch(spark) as s:
        got = dict(components(spark.createDataFrame(edges, "u long, v long"), s).collect())
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 130)}}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and pii._luhn(d), "phone": lambda: 10 <= len(d) <= 15}[k]()  # noqa: B023
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out, key=lambda x: (x[0], list(BASE).index(x[1])))


def test_pii_equals_the_patterns():
    r = random.Random(5)
    parts = ["@", "+", ".", "-", " ", "(", ")", "a", "Z9", "1", "22", "255", "256", "4111 1111 1111 1111", "+1 (017) 555-7713", "x.y@z.com", "é", "\u0663", "%", "_", "10.0.0.1", "token = "]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))
        assert [s for s in pii.find(t) if s[1] in BASE] == base_spans(t), t


def test_pii_query_columns_equal_the_patterns(spark):
    """Counts, digest and spans of scan() over documents: the base kinds by the patterns alone."""
    docs = real(spark, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "é a@b.co 10.0.0.1, 10.0.0.300 +1 555 555 5555 4111 1111 1111 1111")], "doc_id long, text string"))
    text = dict(docs.collect())
    for r in pii.scan(docs).collect():
        spans = base_spans(text[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[1] == k for x in spans) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in BASE] == [x for x in joined.split(",") if x]


def test_pii_masks_and_accounts(spark):
    assert pii.mask('mail a@b.co, token = "0123456789abcdef0123" end') == 'mail [EMAIL], token = "[ACCOUNT]" end'
    assert [s[1] for s in pii.find("IBAN DE89370400440532013000 iban DE89370400440532013001")] == ["account"]
    assert [s[1] for s in pii.find("see http://user:pw@host.example/x now, http://host.example/x")] == ["url"] or "email" in [s[1] for s in pii.find("see http://user:pw@host.example/x now")]
    got = pii.redact(spark.createDataFrame([(1, "a@b.co x", "en", "s", 8)], DOCS)).first()
    assert got["text"] == "[EMAIL] x" and got["n_chars"] == 9


def test_pii_ordinary_accounts():
    for text, masked in [
        ("account: 12345678", "account: [ACCOUNT]"),
        ("Account number: 1234 5678 90, thanks", "Account number: [ACCOUNT], thanks"),
        ("account no. 123456789012.", "account no. [ACCOUNT]."),
        ("IBAN: DE89 3704 0044 0532 0130 00 due", "IBAN: [ACCOUNT] due"),
        ("iban NO9386011117947", "iban [ACCOUNT]"),
        ("account GB82 WEST 1234 5698 7654 32", "account [ACCOUNT]"),
    ]:
        assert pii.mask(text) == masked
    for text in ("account 1234567", "account since 2019", "account 2024-01-15", "account 12345678x", "IBAN: DE89 3704 0044 0532 0130 01", "iban 12345678", "token 12345678"):
        assert pii.mask(text) == text


@pytest.mark.parametrize("cells", [4_000_000, 10])
def test_leaks_equal_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(common, "BROADCAST_CELLS", cells)
    items = [(i, " ".join(words(n, 50 + i))) for i, n in enumerate([14, 20, 37, 59, 3, 5])]
    rows = []
    for k in range(60):
        w = words(120, 900 + k)
        i, t = items[k % 6]
        p = t.split()
        if k % 5 == 1:
            p[len(p) // 2] = "edited"
        if k % 5 == 2:
            p = p[: len(p) // 2]
        if k % 5 == 3:
            p = [x.upper() + "," for x in p]
        at = 7 * k % 100
        rows.append((k, " ".join(w if k % 5 == 4 else w[:at] + p + w[at:])))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    norm = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    want = {}
    for d, t in rows:
        w = norm(t)
        for i, it in items:
            g, n = grams(norm(it)), len(norm(it))
            best = max(sum((grams(w[s : s + n]) & g).values()) for s in range(len(w) - min(n, len(w)) + 1)) / sum(g.values())
            if best >= 0.8:
                want[d, i] = best
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    clean = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def best_windows(rows, items):
    """The first best window of each pair that reaches 0.8, over all starts."""
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    want = {}
    for d, t in rows:
        w = t.split()
        for i, it in items:
            g, n = grams(it.split()), len(it.split())
            if not grams(w) & g:
                continue
            best, at = max((sum((grams(w[s : s + n]) & g).values()), -s) for s in range(len(w) - min(n, len(w)) + 1))
            if best / sum(g.values()) >= 0.8:
                want[d, i] = (-at, round(best / sum(g.values()), 9))
    return want


def found_windows(spark, rows, items):
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): (r["start"], round(r["similarity"], 9)) for r in got.collect()}


def test_leaks_of_reordered_items(spark):
    items = [(i, " ".join(words(n, 150 + i))) for i, n in enumerate([40, 60, 100, 100])]
    items.append((4, " ".join(words(12, 170) * 2 + words(30, 171))))
    rows = []
    for i, t in items:
        w, p = words(300, 700 + i), t.split()
        for cut in (len(p) // 2, len(p) // 3, len(p) // 4, len(p) - 12):
            for at in (0, 90, 300):
                rows.append((len(rows), " ".join(w[:at] + p[cut:] + p[:cut] + w[at:])))
    want = best_windows(rows, items)
    assert len(want) == 60 and found_windows(spark, rows, items) == want


def test_leaks_of_items_cut_at_an_end(spark):
    items = [(i, " ".join(words(n, 1000 + i))) for i, n in enumerate([20, 30, 50, 100] * 30)]
    rows = []
    for i, t in items:
        w, p = words(240, 2000 + i), t.split()
        gone = (len(p) - 4) // 5
        rows.append((i, " ".join(w[:120] + (p[gone:] if i % 8 < 4 else p[:-gone]) + w[120:])))
    want = best_windows(rows, items)
    assert len(want) == len(items) and found_windows(spark, rows, items) == want


def test_rows_of_one_id_are_not_joined(spark):
    p = words(40, 160)
    items = spark.createDataFrame([(0, " ".join(p))], "item_id long, text string")
    halves = [" ".join(words(30, 161) + p[:24]), " ".join(p[16:] + words(30, 162))]
    for i in (1, None):
        assert count(decontaminate.leaks(spark.createDataFrame([(i, h) for h in halves], "doc_id long, text string"), items)) == 0
        assert count(decontaminate.leaks(spark.createDataFrame([(i, h) for h in [*halves, " ".join(p)]], "doc_id long, text string"), items)) == 1


def test_queries_and_pipeline(spark):
    assert sorted(registry.QUERIES) == sorted(f"op{n}_{x}" for n, x in [(1, "language_id"), (2, "license_scan"), (3, "source_mix"), (4, "warc"), (5, "fingerprints"), (6, "url_filter"), (7, "jaccard_join"), (8, "pii"), (9, "decontamination"), (10, "quality"), (11, "vector_codes"), (12, "toxicity"), (13, "periodic_runs")])
    docs = real(spark, "documents")
    names = docs.columns
    kept = None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        assert out.columns == names or i == 4
        docs = spark.createDataFrame(out.collect(), out.schema)
        ids = {r["doc_id"] for r in docs.collect()}
        assert kept is None or ids <= kept
        kept = ids
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == kept


@pytest.mark.parametrize("size", range(1, 8))
def test_windows_are_simhashes(spark, size):
    rows = [(i, " ".join(words(n, 300 + i))) for i, n in enumerate([0, 1, 3, 6, 7, 8, 30])]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", decontaminate.hashes(decontaminate.words(F.col("text"))).alias("h"))
    for r in d.select("h", decontaminate.let(F.col("h"), lambda h: decontaminate.windows(h, size)).alias("w")).collect():
        h, want = [x % 2**64 for x in r["h"]], []
        for s in range(len(h) - size + 1):
            want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h[s : s + size]) > size))
        assert [x % 2**64 for x in r["w"]] == want


def test_fingerprints_within_the_radius_share_a_block(spark):
    r, rows = random.Random(9), []
    for _ in range(200):
        a = r.getrandbits(64)
        rows.append((a - 2**63, (a ^ sum(1 << b for b in r.sample(range(64), decontaminate.RADIUS))) - 2**63))
    d = spark.createDataFrame(rows, "a long, b long").select(decontaminate.keys(F.col("a")).alias("x"), decontaminate.keys(F.col("b")).alias("y"))
    assert all(set(r["x"]) & set(r["y"]) and len(set(r["x"])) == len(decontaminate.BLOCKS) for r in d.collect())


def test_leaks_of_edited_items(spark):
    """Replaced, inserted and deleted words at random, in items of many lengths: all that reach 0.8 are found, with the exact similarity."""
    r = random.Random(4)
    items = [(i, " ".join(words(n, 400 + i))) for i, n in enumerate([9, 12, 15, 18, 21, 24, 28, 33, 40, 47, 55, 64, 90, 140] * 3)]
    rows = []
    for i, t in items:
        for edits in (1, 2, 3, 5):
            p = t.split()
            for e in range(edits):
                k = r.randrange(len(p))
                p[k : k + r.randrange(2)] = [f"new{e}"] * r.randrange(2)
            w = words(80, 5000 + len(rows))
            rows.append((len(rows), " ".join(w[:40] + p + w[40:])))
    want = best_windows(rows, items)
    assert 60 < len(want) < len(rows) and found_windows(spark, rows, items) == want


def test_pipeline_stages_by_hand(spark):
    """Each stage on its own small input against plain Python, with odd rows and extra columns."""
    a, b, item = words(60, 71), words(60, 72), words(30, 73)
    rows = [(1, " ".join(a)), (2, " ".join([*a[:-1], "edit"])), (3, " ".join(b)), (4, " ".join(b)), (5, " ".join(words(40, 74)[:20] + item + words(40, 74)[20:])), (6, None), (7, ""), (8, "12 34"), (9, "mail x.y@z.com or +1 555 555 5555, token = 0123456789abcdef0"), (9, "other text of the same id here"), (None, " ".join(words(50, 75)))]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 4 else None, len(t or "")) for k, (i, t) in enumerate(rows)], DOCS).withColumn("digest", F.lit("x")).withColumn("start", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    text = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)
    assert text(jaccard_join.one_of_each(docs)) == text(stages["jaccard_join"](spark, docs, DATA)) == sorted([r for r in rows if r[0] not in (2, 4)], key=str)
    bench = spark.createDataFrame([(0, " ".join(item)), (1, None)], "item_id long, text string")
    assert text(decontaminate.decontaminate(docs, bench)) == sorted([r for r in rows if r[0] != 5], key=str)
    assert text(stages["decontamination"](spark, docs, DATA)) == sorted(rows, key=str)
    masked = stages["pii"](spark, docs, DATA)
    assert text(masked) == sorted([(i, pii.mask(t)) for i, t in rows], key=str) and all(r["n_chars"] == len(r["text"]) for r in masked.collect() if r["text"] is not None)
    assert ("mail [EMAIL] or [PHONE], token = [ACCOUNT]") in {t for _, t in text(masked)}
    scores = {(r["doc_id"]): r for r in language_id.identify(docs).where("doc_id <> 9").collect()}
    kept = text(stages["language_id"](spark, docs, DATA))
    assert {i for i, _ in kept if i != 9} - {None} == {i for i, r in scores.items() if i is not None and r["score"] >= language_id.LEAST} and not {6, 7, 8} & {i for i, _ in kept}
    mixed = stages["source_mix"](spark, docs, DATA).collect()
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] = max(copies[r["doc_id"]], r["copies"])
    assert Counter((r["doc_id"], r["text"]) for r in mixed) == Counter((i, t) for i, t in rows if copies[i] > 0) and all(r["copies"] == copies[r["doc_id"]] for r in mixed)
    for d in (stages["jaccard_join"](spark, docs, DATA), masked, stages["language_id"](spark, docs, DATA)):
        assert d.columns == docs.columns
