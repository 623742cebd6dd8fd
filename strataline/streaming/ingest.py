"""Incremental ingestion and the audit log as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from strataline.operators import chunking


def stream_filings(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(filings: DataFrame, target: str, checkpoint: str, **chunk_options) -> StreamingQuery:
    """Chunks new filings as they come, each batch into its own folder of the target.

    A batch that is written again after a failure replaces its folder, so the target holds it once. Read the target
    through upserted(), which keeps the latest delivery of a chunk. The query runs until what is there is done.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunking.chunk_filings(batch, **chunk_options).withColumn("batch", F.lit(number))
        chunks.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return filings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, target: str) -> DataFrame:
    """The latest row of each chunk_id over all batches."""
    c = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    rest = [x for x in c.columns if x not in ("chunk_id", "batch")]
    return c.groupBy("chunk_id").agg(F.max(F.struct("batch", *rest)).alias("r")).select("chunk_id", "r.*")


def windowed_events(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by window and type; works on a stream (late ones beyond the watermark are left out) and on a table."""
    e = events.withWatermark(ts, late)
    return e.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def admitted(requests: DataFrame, per_second: float = 8.0, by: str = "client") -> DataFrame:
    """requests (by, ts in seconds) with `start`: when each may go if a client has so many a second and none saved up.

    start_k = max over i <= k of (ts_i + (k - i) / rate), which is a running maximum.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(by).orderBy("ts", "request_id")
    k = F.row_number().over(w) - 1
    numbered = requests.withColumn("k", k)
    run = Window.partitionBy(by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("start", F.round(F.max(F.col("ts") - F.col("k") / per_second).over(run) + F.col("k") / per_second, 6)).drop("k")
