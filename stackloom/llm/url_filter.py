"""URL filtering by a sorted digest array.

Rules and block-listed hosts are stored as 64-bit xxhash keys in sorted order, in a file of the shared folder that
executors memory-map, with their strings beside them. A URL's candidates (each host suffix with each path prefix of
a length that occurs in the list) are hashed and found by one vectorised binary search a batch; a hit counts if the
stored string is equal, so collisions do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import Scratch, keep

# Rules (host, path, verdict), and hosts that are blocked with all their subdomains where no rule fits.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_DOMAINS = ("example.com", "example.net", "example.org")
BLOCKED_HOSTS = tuple(f"{n}.{d}" for n in BLOCKED_NAMES for d in BLOCKED_DOMAINS)

#: Entries of one array.
SHARD = 2_000_000
_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path of a URL; both empty for null and where there is no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(_LOWER), slash + path


@dataclass
class DigestArray:
    """``keys`` are sorted; entry i has the text blob[ends[i-1]:ends[i]] and the verdict values[i]."""

    keys: np.ndarray
    ends: np.ndarray
    blob: np.ndarray
    values: np.ndarray

    def find(self, names: list[bytes], h: np.ndarray | None = None) -> np.ndarray:
        """For each name the entry's verdict, or -1; equal digests are told apart by the stored text."""
        out = np.full(len(names), -1, np.int64)
        if not names or not len(self.keys):
            return out
        h = digests(names) if h is None else h
        at = np.searchsorted(self.keys, h)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == h))
        for i in hit:
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == h[i]:
                if self.blob[self.ends[j - 1] if j else 0 : self.ends[j]].tobytes() == names[i]:
                    out[i] = self.values[j]
                    break
                j += 1
        return out


@dataclass
class Index:
    """Arrays whose keys follow on each other, ``first`` being the first key of each."""

    arrays: list[DigestArray]
    first: np.ndarray
    lengths: list[int]  # of the paths in the list
    reach: int  # length of the longest host in the list

    def find(self, names: list[bytes]) -> np.ndarray:
        out = np.full(len(names), -1, np.int64)
        if not names or not self.arrays:
            return out
        h = digests(names)
        shard = np.searchsorted(self.first, h, "right") - 1
        for k in np.unique(shard[shard >= 0]):
            i = np.flatnonzero(shard == k)
            out[i] = self.arrays[k].find([names[x] for x in i], h[i])
        return out


def digests(names: list[bytes]) -> np.ndarray:
    """The 64-bit xxhash of each name, as Spark computes it."""
    return np.fromiter((xxhash.xxh64_intdigest(x, seed=42) for x in names), np.uint64, len(names)).view(np.int64)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def store(entries: DataFrame, root: str) -> list[tuple]:
    """Writes the digest arrays of a list (host, path, value) under ``root``, of at most about SHARD entries each, and returns a row (folder, first key, path lengths, longest host) for each.

    Tasks hash, sort by ranges and write; each attempt has a folder of its own. Of an entry with several values the largest counts.
    """
    e = entries.groupBy("host", "path").agg(F.max(F.col("value").cast("long")).alias("value")).select(F.concat("host", "path").alias("text"), "value", F.char_length("path").alias("p"), F.char_length("host").alias("h"))
    e = e.withColumn("key", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        texts = [x.encode("utf-8", "surrogatepass") for x in t["text"].to_pylist()]
        folder = f"{root}/urls-{uuid.uuid4().hex}"
        fs, path = _filesystem(folder)
        fs.create_dir(path, recursive=True)
        keys = t["key"].to_numpy()
        for name, a in (("keys", keys), ("ends", np.cumsum([len(x) for x in texts], dtype=np.int64)), ("blob", np.frombuffer(b"".join(texts), np.uint8)), ("values", t["value"].to_numpy())):
            with fs.open_output_stream(f"{path}/{name}") as f:
                f.write(np.ascontiguousarray(a).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([int(keys[0])]), pa.array([sorted(set(t["p"].to_pylist()))], pa.list_(pa.int64())), pa.array([max(t["h"].to_pylist())], pa.int64())], ["folder", "first", "lengths", "reach"])

    n = e.count()
    made = e.repartitionByRange(max(1, -(-n // SHARD)), "key").sortWithinPartitions("key", "text").mapInArrow(run, "folder string, first long, lengths array<long>, reach long")
    return sorted((tuple(r) for r in made.collect()), key=lambda r: r[1])  # a row for each array


def load(shards: list[tuple]) -> Index:
    """Memory-maps stored arrays; where the shared folder is no mounted one, reads them into memory."""

    def array(folder: str, name: str, kind) -> np.ndarray:
        fs, path = _filesystem(folder)
        if not fs.get_file_info(f"{path}/{name}").size:
            return np.zeros(0, kind)
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(f"{path}/{name}", kind, "r")
        with fs.open_input_stream(f"{path}/{name}") as f:
            return np.frombuffer(f.read(), kind)

    arrays = [DigestArray(*(array(s[0], n, k) for n, k in (("keys", np.int64), ("ends", np.int64), ("blob", np.uint8), ("values", np.int64)))) for s in shards]
    return Index(arrays, np.array([s[1] for s in shards], np.int64), sorted({n for s in shards for n in s[2]}), max((s[3] for s in shards), default=0))


def candidates(host: str, path: str, lengths: list[int], reach: int) -> list[tuple[str, str]]:
    """Host suffixes of at most ``reach`` characters by path prefixes of the given lengths, longest first; of equal lengths the longer host first.

    The limit bounds the work of a host of very many labels; a longer suffix is not in the list.
    """
    if not host:
        return []
    labels = host[-reach - 1 :].split(".")
    if len(host) > reach:  # the first one is cut, or its suffix is too long
        labels = labels[1:]
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    out = [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return sorted(out, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))


def judge(pages: DataFrame, rules=RULES, blocked: Iterable[str] | DataFrame = BLOCKED_HOSTS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; only id and URL are read.

    The longest rule that fits decides; where none fits, a host under a blocked one is blocked and all else is allowed,
    null, empty, odd and very long URLs too. Repeated rows are judged each. ``blocked`` may be a table (host) of any length. The arrays are
    gone when the rows are made.
    """
    spark = pages.sparkSession
    kind = "host string, path string, value int"
    ruled = spark.createDataFrame([(h, p, int(v == "block")) for h, p, v in rules], kind)
    hosts = blocked.select("host", F.lit("").alias("path"), F.lit(1).alias("value")) if isinstance(blocked, DataFrame) else spark.createDataFrame([(h, "", 1) for h in blocked], kind)
    with Scratch(spark) as scratch:
        of_rules, of_hosts = store(ruled, scratch.root), store(hosts, scratch.root)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_rule, by_host = load(of_rules), load(of_hosts)
            for b in batches:
                parts = [split(u.as_py()) for u in b.column(1)]
                rule, verdict = [None] * len(parts), ["allow"] * len(parts)
                for index, first in ((by_host, False), (by_rule, True)):
                    names, owner = [], []
                    for i, (h, p) in enumerate(parts):
                        for x in candidates(h, p, index.lengths, index.reach):
                            names.append(x[0] + x[1])
                            owner.append(i)
                    seen = -1
                    got = index.find([n.encode("utf-8", "surrogatepass") for n in names])
                    for k in np.flatnonzero(got >= 0):
                        if owner[k] == seen:
                            continue
                        seen = owner[k]
                        verdict[seen] = "block" if got[k] else "allow"
                        if first:
                            rule[seen] = names[k]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], rule, verdict))], ["page_id", "host", "path", "rule", "verdict"])

        return keep(pages.select(F.col("page_id").cast("long"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string"))


def judge_sql(rules=RULES, blocked: Iterable[str] = BLOCKED_HOSTS) -> str:
    """DuckDB SQL for the rows of judge() over ``pages``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({quote(h)}, {quote(p)}, {quote(v)})" for h, p, v in rules)
    hosts = ", ".join(f"({quote(h)})" for h in blocked)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH u AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest FROM pages),
    p AS (SELECT i, page_id, translate(regexp_extract(rest, '^[^/]*', 0), '{upper}', '{lower}') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*', 0)) + 1) AS path FROM u),
    r AS (SELECT i, arg_max(rule, (length(rule), length(h))) AS rule, arg_max(v, (length(rule), length(h))) AS verdict FROM (SELECT p.i, h || q AS rule, h, v FROM p JOIN (VALUES {listed}) l(h, q, v) ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)) GROUP BY i),
    b AS (SELECT DISTINCT i FROM p JOIN (VALUES {hosts}) l(h) ON p.host = h OR ends_with(p.host, '.' || h))
    SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, CASE WHEN b.i IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN r ON r.i = p.i LEFT JOIN b ON b.i = p.i
    """
