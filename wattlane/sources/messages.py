"""Message sources: rows of (topic, payload, received_at, offset)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MESSAGE, MESSAGE_TYPES

# Fixed value: the subscribed topic shape.
TOPIC_PATTERN = rf"^energy/[^/]+/({'|'.join(MESSAGE_TYPES)})$"


def subscribed(messages: DataFrame) -> DataFrame:
    """Messages of the three subscribed topic filters."""
    return messages.where(F.col("topic").rlike(TOPIC_PATTERN))


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Recorded messages as a batch."""
    return spark.read.format(fmt).schema(MESSAGE).load(path)


def stream_messages(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """The same files as a stream.  ``max_files`` per trigger is the rate limit: nothing is dropped."""
    reader = spark.readStream.format(fmt).schema(MESSAGE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def kafka_messages(
    spark: SparkSession, servers: str, topics: str, max_offsets: int | None = None
) -> DataFrame:
    """Messages from Kafka; the record key holds the message topic.

    Needs the Spark Kafka connector on the class path.  The order column packs
    partition and offset, which is enough where a device always uses one partition.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.col("key").cast("string").alias("topic"),
        F.col("value").alias("payload"),
        F.col("timestamp").alias("received_at"),
        (F.col("partition").cast("long") * F.lit(1 << 48) + F.col("offset")).alias("offset"),
    )
