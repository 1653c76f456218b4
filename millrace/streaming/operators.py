"""Structured Streaming forms of the state operators, over any streaming DataFrame.

Each is defined by its batch equivalent: with all input read and no late rows its last
output is what the batch operator gives. Watermarks bound the state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import checkpoint_dir


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet file stream with event time as a timestamp (watermarks refuse a naive one)."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, key: str, width: str, late: str) -> DataFrame:
    """Rows and sums by key and window."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width), key)
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("started"), key, "n", "total")


def session_counts(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Sessions by key with a gap."""
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key)
    return g.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("started"), key, "n")


def first_seen(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key once, while the watermark keeps it (STM01's admission of new keys)."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def latest_state(stream: DataFrame, key: str) -> DataFrame:
    """First and last seen and the number of rows of each key (STM01) in update or complete mode."""
    return stream.groupBy(key).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return its output as a table in the shared folder.

    Append mode writes files; complete and update mode keep the last batch's rows by
    overwriting in ``foreachBatch``, which a retried batch repeats without harm.
    """
    spark = stream.sparkSession
    at = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/log").outputMode(mode)
    if mode == "append":
        q = w.format("parquet").option("path", f"{at}/out").start()
    else:
        q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
