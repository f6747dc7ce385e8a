"""Sales as a stream: repeats dropped within a watermark, counts per window, last known state per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of a Parquet table as they arrive, with the schema of those there."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm).isFile():  # a stream watches a folder
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def without_repeats(stream: DataFrame, key: str, at: str, delay: str = "60 days") -> DataFrame:
    """The first delivery of each key; later ones within the delay are dropped, and state beyond it is freed."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, size: str = "30 days", delay: str = "60 days", *keys: str) -> DataFrame:
    """Counts and sums per tumbling window and keys, closed when the watermark passes."""
    s = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return s.groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum("price").alias("total"))


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there, appending to Parquet, and stop."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
