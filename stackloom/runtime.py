"""Session set-up, and shipping the package to executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch, where the application did not set them: texts may be long.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local runs; on a cluster, bring your own."""
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.ui.enabled", "false").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, as --py-files would, and bounds Arrow batches."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    for k, v in ARROW.items():
        if not sc.getConf().contains(k):
            spark.conf.set(k, v)
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    folder = tempfile.mkdtemp(prefix="stackloom-ship-")
    path = os.path.join(folder, "stackloom_package.zip")
    Path(path).write_bytes(buffer.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stackloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession) -> str:
    """The name of a new folder under shared()."""
    return f"{shared(spark).rstrip('/')}/stackloom/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder; Spark's cleaner drops it with the DataFrame."""
    shared(df.sparkSession)
    return df.checkpoint()


def dealt_pairs(left: DataFrame, right: DataFrame, on: list[str], to: list[str], shares: int = 16) -> DataFrame:
    """Inner join of ``on`` with ``to`` where pairs are far more than rows: the right rows of a value are dealt to ``shares`` units, the left ones are
    copied to each, and the number of partitions is given, as it would else follow from the size of the input."""
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * left.sparkSession.sparkContext.defaultParallelism)
    whole = lambda d, names: d.where(" AND ".join(f"`{c}` IS NOT NULL" for c in names) or "true")
    a = whole(left, on).withColumn("unit_", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(n, *on, "unit_")
    b = whole(right, to).withColumn("unit_to_", F.pmod(F.xxhash64(*right.columns), F.lit(shares)).cast("int")).repartition(n, *to, "unit_to_")
    equal = F.col("unit_") == F.col("unit_to_")
    for x, y in zip(on, to, strict=True):
        equal = equal & (F.col(x) == F.col(y))
    return a.hint("merge").join(b, equal).drop("unit_", "unit_to_")


def spread(df: DataFrame, *by: str, like: DataFrame | None = None, rows: int = 250_000) -> DataFrame:
    """Rows by hash of columns, in partitions of about ``rows`` of ``like``, or of itself: Spark would merge partitions by their compressed bytes, and a task's memory would grow with the input."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(df if like is None else like).count() // rows))
    return df.repartition(n, *by)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
