"""Helpers shared by the operators: scratch tables, size-checked joins, streaming over sorted groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the small side of a join is broadcast; it is counted first, beyond it the join shuffles.
BROADCAST_ROWS = 300_000
#: The same for the elements of all its arrays, where it has any.
BROADCAST_CELLS = 4_000_000
#: Rows of one key that a join by spread() leaves together, and the most keys that may have more.
HUB_ROWS, HUBS = 500, 100_000
#: The name of an id that is joined to a table whose columns are not known.
ID = "__stackloom_id"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stackloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage; gone when the block ends.

    What outlives the block is a checkpoint(), which Spark's cleaner can drop with its DataFrame.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/stackloom/{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            delete(self.spark, f)


def keep(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int | None = None, cells: int = 0) -> DataFrame:
    """Marks a written table for broadcast if its counted rows, and elements of arrays, are few; otherwise leaves the join to shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS and cells <= BROADCAST_CELLS else df


def spread(left: DataFrame, on: str, right: DataFrame, key: str, n: str, by: Column, total: int, how: str = "inner") -> DataFrame:
    """Joins ``left`` with the one row of its key in ``right``; left rows of a frequent key are dealt over several tasks by a hash of ``by``.

    ``n`` bounds a key's left rows and ``total`` all of them. As at most HUBS keys can have more than total / HUBS rows,
    the list of frequent keys, which is broadcast, is bounded; only their right rows are repeated.
    """
    most = max(HUB_ROWS, total // HUBS)
    parts = F.greatest(F.ceil(F.col(n) / most), F.lit(1)).cast("int")
    hubs = right.where(F.col(n) > most).select(F.col(key).alias("hub__"), parts.alias("parts__"))
    dealt = left.join(F.broadcast(hubs), F.col(on) == F.col("hub__"), "left")
    dealt = dealt.withColumn("salt__", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts__")), F.lit(0)).cast("int")).drop("hub__", "parts__")
    copies = right.withColumn("copy__", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, (F.col(on) == F.col(key)) & (F.col("salt__") == F.col("copy__")), how).drop("salt__", "copy__")


def held_out(doc_id: str = "doc_id", folds: int = 5, remainder: int = 0) -> Column:
    """True where crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == remainder, F.lit(False))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of rows that come sorted by them; holds one run and one batch at a time. Keys are not null."""
    parts: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[s] for c in cols)
            if parts and key != last:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(b.slice(s, e - s))
            last = key
    if parts:
        yield pa.Table.from_batches(parts)
