"""Incremental ingest: frames that land in a folder are reduced to plane medians once their scan is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stackloom.operators import recon
from stackloom.operators.stacks import only
from stackloom.runtime import keep
from stackloom.sources.io import FRAMES


def reconstruct(spark: SparkSession, landing: str, out: str, checkpoint: str, expected: DataFrame) -> StreamingQuery:
    """Writes the median volumes of the scans that each batch completes to ``out``/volumes/batch=N, so that retries write the same place.

    ``expected`` has rows (scan_id, pages). Frames wait in ``out``/frames/batch=N until all pages of their scan are there, whichever
    batches they came in; a page that lands twice counts once. All complete scans of a batch are reduced in one job. Waiting frames lie by scan, so a batch
    reads those of its own scans only, however much has landed before.
    """
    source = spark.readStream.schema(FRAMES).parquet(landing)

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").partitionBy("scan_id").parquet(f"{out}/frames/batch={number}")
        names = [r["scan_id"] for r in df.select("scan_id").distinct().collect()]  # of one batch
        landed = spark.read.schema(f"{FRAMES}, batch long").parquet(f"{out}/frames").where(F.col("scan_id").isin(names) & (F.col("batch") <= number))
        # whole now, and not before this batch
        count = landed.groupBy("scan_id").agg(F.count_distinct("page_index").alias("seen"), F.count_distinct(F.when(F.col("batch") < number, F.col("page_index"))).alias("had"))
        whole = keep(count.join(expected, "scan_id").where((F.col("seen") >= F.col("pages")) & (F.col("had") < F.col("pages"))).select("scan_id"))
        f = only(landed, whole, ["scan_id"]).dropDuplicates(["scan_id", "page_index"]).selectExpr("scan_id", "cast(plane_index as bigint) plane", "cast(local_index as bigint) local_index", "width", "pixels")
        if not whole.isEmpty():
            recon.median_volume(f).write.mode("overwrite").parquet(f"{out}/volumes/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
