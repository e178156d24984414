"""Uploaded files, event files and idempotent object writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars


def uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of staged files, one row a file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def inspected(files: DataFrame) -> DataFrame:
    """Staged files with their name, size, content type by leading bytes, and SHA-256; content is dropped."""
    return files.select(
        "path",
        scalars.basename(F.col("path")).alias("file_name"),
        F.length("content").cast("long").alias("size_bytes"),
        scalars.sniff_mime(F.col("content")).alias("sniffed"),
        F.sha2("content", 256).alias("checksum"),
    )


def accepted(files: DataFrame, declared: str = "declared") -> DataFrame:
    """Files (declared, content) with ``error_code``: unsupported_type if the leading bytes are not of the declared type, known or not."""
    same = F.coalesce(scalars.sniff_mime(F.col("content")) == F.lower(declared), F.lit(False))
    return files.withColumn("error_code", F.when(~same, "unsupported_type"))


def event_files(spark: SparkSession, path: str, schema: str = "type string, body string, seq long", per_trigger: int = 100) -> DataFrame:
    """A stream of JSON event files, at most ``per_trigger`` new files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def routed(events: DataFrame, keys: str, column: str = "routing_key") -> DataFrame:
    """Events whose routing key is one of a comma-separated list; blanks in the list are ignored."""
    wanted = [k.strip() for k in keys.split(",") if k.strip()]
    return events.where(F.col(column).isin(*wanted)) if wanted else events.where(F.lit(False))


def as_messages(events: DataFrame, routing_key: str) -> DataFrame:
    """(routing_key, type, body): rows with a ``type`` column as JSON messages for a sink."""
    body = F.to_json(F.struct(*[c for c in events.columns if c != "type"]))
    return events.select(F.lit(routing_key).alias("routing_key"), "type", body.alias("body"))


def addressed(notifications: DataFrame, provider: str) -> DataFrame:
    """Notifications (recipient, ..) with ``channel`` and ``error_code``: 'console' takes both channels, 'smtp' e-mail only."""
    if provider not in ("console", "smtp"):
        raise ValueError(f"no such provider: {provider}")
    to = scalars.channel(F.col("recipient"))
    out = notifications.withColumn("channel", F.when(F.col("recipient").isNotNull(), to))
    refused = F.col("channel").isNull() | (F.lit(provider == "smtp") & (F.col("channel") != "email"))
    return out.withColumn("error_code", F.when(refused, "unsupported_channel"))


def missing_objects(wanted: DataFrame, listing: DataFrame, key: str = "storage_key") -> DataFrame:
    """Objects that are still to be written: those whose key is not listed. Repeated keys are written once."""
    return wanted.dropDuplicates([key]).join(listing.select(key).distinct(), key, "left_anti")


def start_sink(messages: DataFrame, path: str, checkpoint: str):
    """Write a stream of (routing_key, type, body) as JSON files, a folder for each routing key, each message once."""
    return messages.writeStream.format("json").partitionBy("routing_key").option("path", path).option("checkpointLocation", checkpoint)
