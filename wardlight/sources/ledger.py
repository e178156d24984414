"""An append-only table: whole batches, each once.

A batch's rows are written to a folder of their own; what makes them part of the table is a small file in ``_log`` named by application and batch, which is
renamed into place only if none is there. So a batch that comes again adds nothing, of two writers of one batch one wins, and a reader sees all rows of a batch or none.
All goes through the Hadoop file system of the path.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class _Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self.path().getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri() if "://" in root or root.startswith("file:") else self.fs.getUri(), self.conf)
        self.none = spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def create(self, content: str, *parts: str) -> bool:
        """A small file, whole, unless it is there."""
        passing = self.path("_passing", uuid.uuid4().hex)
        out = self.fs.create(passing, False)
        out.write(bytearray(content.encode()))
        out.close()
        self.fs.mkdirs(self.path(*parts).getParent())
        try:
            self.context.rename(passing, self.path(*parts), self.none)  # fails if the target is there
            return True
        except Exception as e:
            self.fs.delete(passing, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise


def _entry(application: str, batch: int | str) -> str:
    name = f"{application}@{batch}"
    if not re.fullmatch(r"[A-Za-z0-9@.-][A-Za-z0-9@._-]*", name):
        raise ValueError(f"not a name for a log entry: {name}")
    return name


def append(rows: DataFrame, path: str, application: str, batch: int | str) -> bool:
    """Add a batch's rows to the table at ``path``; False, and nothing changes, if the application has added the batch before."""
    spark = rows.sparkSession
    files, entry = _Files(spark, path), _entry(application, batch)
    if files.fs.exists(files.path("_log", entry)):
        return False
    folder = f"{entry}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{files.root}/data/{folder}")
    if files.create(folder, "_log", entry):
        return True
    files.fs.delete(files.path("data", folder), True)
    return False


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows of whole batches, with ``application`` and ``batch``; of an empty table none, which needs ``schema``."""
    files = _Files(spark, path)
    log = files.path("_log")
    names = [x.getPath() for x in files.fs.listStatus(log)] if files.fs.exists(log) else []
    if not names:
        return spark.createDataFrame([], f"{schema}, application string, batch string")
    entries = spark.read.text(f"{files.root}/_log/*", wholetext=True).collect()  # a name for each batch
    own = spark.read.schema(schema) if schema else spark.read
    table = own.parquet(*sorted(f"{files.root}/data/{e['value']}" for e in entries))
    entry = F.regexp_extract(F.input_file_name(), r"/data/([^/]*)-[0-9a-f]{32}/", 1)
    return table.withColumn("_entry", F.url_decode(entry)).select("*", F.substring_index("_entry", "@", 1).alias("application"), F.substring_index("_entry", "@", -1).alias("batch")).drop("_entry")


def audited(rows: DataFrame, path: str, application: str, batch: int | str, then: Callable[[], object]):
    """Add audit rows, denials included, and only then do what they tell of: they stay when that fails, and are not added again when it is tried again."""
    append(rows, path, application, batch)
    return then()


def start_append(rows: DataFrame, path: str, checkpoint: str, application: str):
    """A stream's rows, each micro-batch as a batch of the table."""
    return rows.writeStream.foreachBatch(lambda b, n: append(b, path, application, n) and None).option("checkpointLocation", checkpoint)
