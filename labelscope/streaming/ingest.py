"""Reply files picked up as they land: a file stream into a table of one row per call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def reply_stream(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json",
    glob: str | None = None, files_per_batch: int = 1000,
) -> DataFrame:
    """A stream of reply rows from a folder, or from the files and folders of a path with wildcards;
    only new files are read on the next run."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def first_replies(replies: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first reply of each call. State holds the ids seen; with an event time it is bounded
    by the delay after which a repeat can no longer arrive."""
    if event_time is None:
        return replies.dropDuplicates(["custom_id"])
    return replies.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["custom_id"])


def ingest(
    replies: DataFrame, calls: DataFrame, sink: str, checkpoint: str, event_time: str | None = None
) -> DataFrame:
    """Append new replies to expected calls to `sink`, process what is there, and stop.

    Each micro-batch writes its own `batch=` folder in overwrite mode. A batch replayed after
    a lost driver rewrites the same folder instead of adding rows twice. Where no reply has come
    yet, the table is empty.
    """
    spark = replies.sparkSession
    expected = calls.select("custom_id").distinct()
    spark.createDataFrame([], replies.schema).write.mode("overwrite").parquet(f"{sink}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        known = batch.join(expected, "custom_id", "left_semi")
        known.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = (
        first_replies(replies, event_time)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", sink).parquet(sink).drop("batch")


def pending(calls: DataFrame, ingested: DataFrame) -> DataFrame:
    """Expected calls with no reply yet, from both sides' ids only."""
    return calls.join(ingested.select(F.col("custom_id")), "custom_id", "left_anti")
