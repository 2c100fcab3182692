"""Message sources behind one contract: ``(data BINARY, attributes
MAP<STRING,STRING>, publish_time TIMESTAMP)``.

Brokers: Kafka through Spark's own connector (records' headers become
attributes), or JSON message files written by any producer (one object per
line: ``{"data": "<text>", "attributes": {...}, "publish_time": "..."}``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.contracts import MESSAGE

MESSAGE_FILE_SCHEMA = T.StructType([
    T.StructField("data", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("publish_time", T.TimestampType()),
])


def read_messages(spark: SparkSession, path: str, streaming: bool = True,
                  max_files_per_trigger: int | None = None,
                  with_attributes: bool = True) -> DataFrame:
    """Messages from JSON message files (a folder a producer appends to).
    ``with_attributes=False`` gives only ``data`` (bytes)."""
    if streaming:
        r = spark.readStream.schema(MESSAGE_FILE_SCHEMA)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        raw = r.json(path)
    else:
        raw = spark.read.schema(MESSAGE_FILE_SCHEMA).json(path)
    msgs = raw.select(F.col("data").cast("binary").alias("data"),
                      F.coalesce(F.col("attributes"),
                                 F.create_map().cast("map<string,string>")).alias("attributes"),
                      F.col("publish_time"))
    return msgs if with_attributes else msgs.select("data")


def read_message_strings(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """Message payloads as text: ``value STRING``."""
    return read_messages(spark, path, streaming).select(
        F.col("data").cast("string").alias("value"))


def read_kafka(spark: SparkSession, bootstrap_servers: str, topics: str,
               starting_offsets: str = "latest", streaming: bool = True,
               options: dict | None = None) -> DataFrame:
    """Kafka records ``(key, value, topic, partition, offset, timestamp,
    headers)``. Needs Spark's Kafka connector on the classpath."""
    r = spark.readStream if streaming else spark.read
    r = (r.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
          .option("subscribe", topics).option("startingOffsets", starting_offsets)
          .option("includeHeaders", "true"))
    for k, v in (options or {}).items():
        r = r.option(k, v)
    try:
        return r.load()
    except Exception as e:  # the connector is a separate artifact
        if "kafka" in str(e).lower() and "data source" in str(e).lower():
            raise RuntimeError(
                "Spark's Kafka connector is not on the classpath: add the "
                "spark-sql-kafka-0-10 artifact matching this Spark version "
                "(spark.jars.packages or --packages)") from e
        raise


def kafka_to_messages(records: DataFrame) -> DataFrame:
    """Kafka records -> messages: value -> data, headers -> attributes
    (header bytes decoded as UTF-8), record timestamp -> publish_time."""
    headers = F.coalesce(F.col("headers"),
                         F.array().cast("array<struct<key:string,value:binary>>"))
    attrs = F.map_from_entries(F.transform(
        headers, lambda h: F.struct(h["key"], h["value"].cast("string"))))
    return records.select(F.col("value").alias("data"), attrs.alias("attributes"),
                          F.col("timestamp").alias("publish_time"))


def attribute_time(attribute_value: Column) -> Column:
    """Event time from an attribute holding epoch milliseconds or ISO-8601
    text (``...Z`` or with an offset)."""
    ms = attribute_value.try_cast("bigint")
    iso = F.try_to_timestamp(attribute_value)
    return F.coalesce(F.when(ms.isNotNull() & (F.abs(ms) <= F.lit(9_223_372_036_854_775)),
                             F.timestamp_millis(ms)), iso)


def event_time_from_attribute(messages: DataFrame, attribute: str = "timestamp",
                              out: str = "event_time", watermark: str | None = None) -> DataFrame:
    """Take event time from a message attribute; messages without a usable
    value fall back to ``publish_time``. ``watermark`` (e.g. ``"10
    seconds"``) bounds lateness on a stream."""
    t = F.coalesce(attribute_time(F.col("attributes")[attribute]), F.col("publish_time"))
    out_df = messages.withColumn(out, t)
    return out_df.withWatermark(out, watermark) if watermark else out_df


def messages_schema() -> T.StructType:
    return MESSAGE
