"""Objects written by executors under immutable keys, each with its metadata beside it, once.

An attempt claims a key by a small file (``meta/<key>.json``: batch, checksum, size, type, metadata) that is created whole and only if it is not there, then puts
the content under ``objects/<key>`` in the same way, from a name of its own. So an attempt that runs twice, at the same time or after
a failure, finds the claim of its own batch and changes nothing; a key of another batch stays as it is and is reported as such. What
came of each key is a table, written before anything else uses it.

The folder must be reachable from all executors by a path that ``pyarrow.fs`` knows; creating a file only if it is not there is safe against other writers on mounted folders.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import pyarrow as pa
from pyarrow import fs as _fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_path
from .messages import Topic

REPORT = "storage_key string, state string, size_bytes long, checksum string"
_KEY = re.compile(r"[^/\x00]+(?:/[^/\x00]+)*")


def valid_key(key: str | None) -> bool:
    """Whether a key is a relative path without empty, . and .. parts."""
    return bool(key) and bool(_KEY.fullmatch(key)) and not {".", ".."} & set(key.split("/"))


def put(store: Topic, batch: str, key: str, content: bytes, content_type: str | None = None, metadata: dict | None = None) -> tuple[str, int, str]:
    """(state, size, checksum) of one object: 'written', or 'exists' with the size and checksum of the one that is there."""
    if not valid_key(key):
        return "invalid_key", len(content), hashlib.sha256(content).hexdigest()
    claim = {"batch": batch, "checksum": hashlib.sha256(content).hexdigest(), "size": len(content), "content_type": content_type, "metadata": metadata or {}}
    place = store.place("meta", f"{key}.json")
    if not store.create(place, claim):
        there = store.read(place)
        if there["batch"] != batch or there["checksum"] != claim["checksum"]:
            return "exists", there["size"], there["checksum"]
    target = store.place("objects", *key.split("/"))
    if store.fs.get_file_info(target).type == _fs.FileType.NotFound:
        store.create(target, content)
    return "written", claim["size"], claim["checksum"]


def put_objects(objects: DataFrame, root: str, batch: str | None = None) -> DataFrame:
    """``REPORT`` of each key of (storage_key, content binary, content_type, metadata map<string, string>); the last two may be missing.

    States: 'written' (by this batch), 'exists' (by another one, untouched; size and checksum are its own) and 'invalid_key'. A key that comes
    several times is written once, with the smallest checksum of its contents. A null content is empty, a row without key is left out. The
    same ``batch`` given again, after a failure or not, gives the same report.
    """
    batch = batch or uuid.uuid4().hex
    named = objects.where("storage_key is not null").select(
        "storage_key",
        F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"),
        (F.col("content_type") if "content_type" in objects.columns else F.lit(None)).cast("string").alias("content_type"),
        (F.to_json("metadata") if "metadata" in objects.columns else F.lit(None).cast("string")).alias("metadata"),
    )
    first = Window.partitionBy("storage_key").orderBy(F.sha2("content", 256))
    once = named.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")

    def run(batches):
        store = Topic(root)
        for b in batches:
            rows = []
            for key, content, kind, metadata in zip(*(b.column(i) for i in range(4)), strict=True):
                state = put(store, batch, key.as_py(), content.as_py(), kind.as_py(), json.loads(metadata.as_py()) if metadata.is_valid else None)
                rows.append((key.as_py(), *state))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["storage_key", "state", "size_bytes", "checksum"])

    path = shared_path(objects.sparkSession, "objects")
    once.mapInArrow(run, REPORT).write.parquet(path)
    return objects.sparkSession.read.schema(REPORT).parquet(path)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(storage_key, size_bytes, checksum) of the contents that are there, read by Spark, which passes over empty files."""
    place = Topic(root).place("objects")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(place if root.startswith("/") or "://" not in root else f"{root.rstrip('/')}/objects")
    key = F.regexp_extract("path", r"/objects/(.*)$", 1)
    return files.select(F.url_decode(F.regexp_replace(key, r"\+", "%2B")).alias("storage_key"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("checksum"))
