"""Streams of triples: new files of a folder join the store, and the merged table follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein import schemas
from skein.operators.merge import merge_triples


def triple_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Triples of JSON lines, as files arrive; seq orders them by arrival and file."""
    s = spark.readStream.schema(f"{schemas.TRIPLE}, at long").option("maxFilesPerTrigger", files_at_once).json(folder)
    return s.withColumn("seq", F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_name").alias("file"), F.coalesce("at", F.lit(0)).alias("at"))).drop("at")


def append_to_store(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Each batch becomes a folder of the store named by its number, so a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_store(spark: SparkSession, store: str) -> DataFrame:
    return merge_triples(spark.read.parquet(store).withColumn("seq", F.struct("batch", "seq")))


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of a key in time windows under a watermark; for streams and tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
