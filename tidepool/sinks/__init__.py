"""Sinks: text lines and messages (JSON message files or Kafka)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def write_lines(df: DataFrame, path: str, column: str = "value", mode: str = "overwrite",
                checkpoint: str | None = None) -> DataStreamWriter | None:
    """One line per row (sharded text files). Batch: writes now. Stream:
    returns the configured writer (call ``.start()``); ``checkpoint`` is
    required and should sit under the session's checkpoint folder."""
    out = df.select(F.col(column).cast("string").alias("value"))
    if not df.isStreaming:
        out.write.mode(mode).text(path)
        return None
    if not checkpoint:
        raise ValueError("a streaming sink needs a checkpoint folder")
    return out.writeStream.format("text").option("path", path) \
              .option("checkpointLocation", checkpoint).outputMode("append")


def with_attributes(df: DataFrame, data: Column, **attributes: Column) -> DataFrame:
    """Build message rows: ``data`` bytes plus string attributes (e.g.
    ``tags=lit('farm')``, ``timestamp=now_iso()``)."""
    entries = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
               for k, v in attributes.items()]
    attrs = (F.map_from_entries(F.array(*entries)) if entries
             else F.create_map().cast("map<string,string>"))
    return df.select(data.cast("binary").alias("data"), attrs.alias("attributes"),
                     F.current_timestamp().alias("publish_time"))


def write_messages(messages: DataFrame, path: str | None = None, kafka: dict | None = None,
                   checkpoint: str | None = None, mode: str = "append"):
    """Publish messages ``(data, attributes)``: to JSON message files at
    ``path`` or to Kafka (``kafka={"kafka.bootstrap.servers": ..., "topic":
    ...}``; attributes become headers). Streams return the configured
    writer; batches write now."""
    if (path is None) == (kafka is None):
        raise ValueError("give exactly one of path / kafka")
    if kafka is not None:
        headers = F.transform(F.map_entries("attributes"), lambda e: F.struct(
            e["key"].alias("key"), e["value"].cast("binary").alias("value")))
        out = messages.select(F.col("data").alias("value"), headers.alias("headers"))
        fmt = "kafka"
        opts = dict(kafka)
    else:
        out = messages.select(F.col("data").cast("string").alias("data"), "attributes",
                              F.col("publish_time").cast("string").alias("publish_time")
                              if "publish_time" in messages.columns else F.lit(None)
                              .cast("string").alias("publish_time"))
        fmt = "json"
        opts = {"path": path}
    if not messages.isStreaming:
        w = out.write.format(fmt).mode(mode if fmt == "json" else "append")
        for k, v in opts.items():
            w = w.option(k, v)
        w.save()
        return None
    if not checkpoint:
        raise ValueError("a streaming sink needs a checkpoint folder")
    w = out.writeStream.format(fmt).option("checkpointLocation", checkpoint)
    for k, v in opts.items():
        w = w.option(k, v)
    return w.outputMode("append")
