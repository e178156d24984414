"""Document events: parsing, routing to models, and the fold into states, in batch and as a stream.

Handlers apply events in order of arrival and the last one wins, so every part of a state is the value of the
event with the largest sequence number among those that set it: an aggregate per key, with a map-side part,
instead of a loop. What is stored and converted belongs to the version of a document, a document's status to the
document, an analysis to the extraction; each is a ``Fold`` of its own. The stream folds each micro-batch and merges it
with the states so far by the same rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT_BASE, EVENT_FIELDS

VERSION_KEY = ("document_id", "document_version_id")


@dataclass(frozen=True)
class Fold:
    """A state by ``key``: ``parts`` name a condition and the values that the last event with it sets, all SQL expressions."""

    key: tuple[str, ...]
    parts: dict[str, tuple[str, dict[str, str]]]
    #: Columns with the first sequence number of the events that meet a condition.
    firsts: dict[str, str] = field(default_factory=dict)
    #: Values where no event has set them.
    defaults: dict[str, str] = field(default_factory=dict)

    def values(self) -> list[str]:
        return [c for _, named in self.parts.values() for c in named]


#: The versions' states (conditions and statuses are fixed values).
VERSIONS = Fold(
    VERSION_KEY,
    {
        "stored": ("known and type = 'DocumentStored'", {c: c for c in ("storage_key", "mime_type", "size_bytes", "checksum")}),
        "job": ("known and type in ('DocumentConverted', 'DocumentProcessingFailed')", {"job_status": "if(type = 'DocumentConverted', 'succeeded', 'failed')", "finished_at": "occurred_at"}),
        "error": ("known and type = 'DocumentProcessingFailed'", {"error_code": "error_code", "error_message": "error_message"}),
    },
    {"first_stored_seq": "known and type = 'DocumentStored'"},
    {"job_status": "queued"},
)
#: The documents' states; a failure counts whether its version is known or not.
DOCUMENTS = Fold(
    ("document_id",),
    {
        "status": (
            "(known and type = 'DocumentStored') or type in ('DocumentProcessingFailed', 'DocumentAnalysisCompleted')",
            {"status": "case when type = 'DocumentStored' then 'processing' when type = 'DocumentAnalysisCompleted' and succeeded then 'completed' else 'failed' end"},
        ),
        "file": ("known and type = 'DocumentStored'", {c: c for c in ("storage_key", "mime_type", "size_bytes")}),
    },
    {},
    {"status": "pending"},
)
EXTRACTIONS = Fold(
    ("extraction_id",),
    {"analysis": ("type = 'DocumentAnalysisCompleted'", {"extraction_status": "if(succeeded, 'succeeded', 'failed')", "confidence": "confidence"})},
)


def parsed(messages: DataFrame) -> DataFrame:
    """(seq, type, event, valid): messages of known types with their body as a struct of all fields; others are dropped.

    ``valid`` is false where the body is no JSON or has no document_id.
    """
    fields = ", ".join(dict.fromkeys(", ".join([EVENT_BASE, *EVENT_FIELDS.values()]).split(", ")))
    known = messages.where(F.col("type").isin(*EVENT_FIELDS))
    event = F.from_json("body", fields, {"mode": "PERMISSIVE"})
    return known.select("seq", "type", event.alias("event")).withColumn("valid", F.col("event.document_id").isNotNull())


def with_known(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Events with ``known``: whether their version is there. What belongs to a version is skipped where it is not."""
    there = versions.select(*VERSION_KEY).distinct().withColumn("known", F.lit(True))
    return events.drop("known").join(there, list(VERSION_KEY), "left").withColumn("known", F.coalesce("known", F.lit(False)))


def _last(seq: Column, values: list[Column], when: Column) -> Column:
    return F.max(F.when(when, F.struct(seq.alias("seq"), F.struct(*values).alias("value"))))


def _opened(grouped: DataFrame, fold: Fold) -> DataFrame:
    columns = []
    for name, (_, named) in fold.parts.items():
        columns.append(F.col(f"_{name}.seq").alias(f"{name}_seq"))
        for c in named:
            value = F.col(f"_{name}.value.{c}")
            columns.append((F.coalesce(value, F.lit(fold.defaults[c])) if c in fold.defaults else value).alias(c))
    return grouped.select(*fold.key, *columns, *fold.firsts)


def folded(events: DataFrame, fold: Fold) -> DataFrame:
    """The state of every key that has events. VERSIONS and DOCUMENTS need the column of ``with_known``."""
    events = events.where(F.concat(*[F.col(c).cast("string") for c in fold.key]).isNotNull())
    parts = [_last(F.col("seq"), [F.expr(x).alias(c) for c, x in named.items()], F.expr(when)).alias(f"_{name}") for name, (when, named) in fold.parts.items()]
    firsts = [F.min(F.when(F.expr(when), F.col("seq"))).alias(c) for c, when in fold.firsts.items()]
    return _opened(events.groupBy(*fold.key).agg(*parts, *firsts), fold)


def merged(before: DataFrame, after: DataFrame, fold: Fold) -> DataFrame:
    """Two tables of states as one: for each part of a state the one with the larger sequence number."""
    both = before.unionByName(after)
    parts = [_last(F.col(f"{name}_seq"), [F.col(c) for c in named], F.col(f"{name}_seq").isNotNull()).alias(f"_{name}") for name, (_, named) in fold.parts.items()]
    return _opened(both.groupBy(*fold.key).agg(*parts, *[F.min(c).alias(c) for c in fold.firsts]), fold)


def to_publish(events: DataFrame, versions: DataFrame) -> DataFrame:
    """(document_id, document_version_id, seq): the stored event of each version that is told to others.

    It is the first one, of a version that is there and has no checksum yet.
    """
    key = list(VERSION_KEY)
    first = events.where(F.col("type") == "DocumentStored").groupBy(*key).agg(F.min("seq").alias("seq"))
    blank = versions.groupBy(*key).agg(F.count("checksum").alias("n")).where("n = 0").select(*key)
    return first.join(blank, key, "left_semi")


def unknown(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Events whose version is not there: left out of its fold, kept for inspection."""
    return events.join(versions.select(*VERSION_KEY).distinct(), list(VERSION_KEY), "left_anti")


#: Columns of ``correlated`` by event type.
STEPS = {"DocumentUploadRequested": "requested_at", "DocumentStored": "stored_at", "DocumentConverted": "converted_at", "DocumentAnalysisCompleted": "analysed_at", "DocumentProcessingFailed": "failed_at"}


def correlated(events: DataFrame) -> DataFrame:
    """(document_id, n_events, requested_at, ..): a document's way by the first time of each type; a row a document, added up before the shuffle."""
    firsts = [F.min(F.when(F.col("type") == kind, F.col("occurred_at"))).alias(c) for kind, c in STEPS.items()]
    return events.where("document_id is not null").groupBy("document_id").agg(F.count("*").alias("n_events"), *firsts)


def retry_or_bury(events: DataFrame, most: int = 3) -> DataFrame:
    """(document_id, document_version_id, n_failed, outcome): a version that failed since it last succeeded is tried again up to ``most`` times, then it is a dead letter."""
    key = list(VERSION_KEY)
    failed, ok = F.col("type") == "DocumentProcessingFailed", F.col("type").isin("DocumentConverted", "DocumentAnalysisCompleted")
    done = events.where(ok).groupBy(*key).agg(F.max("seq").alias("done"))
    since = events.where(failed).join(done, key, "left").where("done is null or seq > done").groupBy(*key).agg(F.count("*").alias("n_failed"))
    return since.withColumn("outcome", F.when(F.col("n_failed") <= most, "retry").otherwise("dead_letter"))


# -------------------------------------------------------------------- stream


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _manifest(spark: SparkSession, state_path: str, number: int) -> dict[int, int]:
    """Of each bucket the batch that wrote it last; a row a bucket."""
    path = f"{state_path}/manifest/batch={number}"
    fs, place = _files(spark, path)
    return {r["bucket"]: r["at"] for r in spark.read.parquet(path).collect()} if fs.exists(place) else {}


def _states(spark: SparkSession, state_path: str, places: dict[int, int], like: DataFrame) -> DataFrame:
    paths = [f"{state_path}/batch={at}/bucket={bucket}" for bucket, at in sorted(places.items())]
    return spark.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)


def current_states(spark: SparkSession, state_path: str, number: int) -> DataFrame:
    """All states as they are after a batch of ``start_fold``."""
    places = _manifest(spark, state_path, number)
    return spark.read.parquet(*[f"{state_path}/batch={at}/bucket={bucket}" for bucket, at in sorted(places.items())])


def start_fold(events: DataFrame, fold: Fold, state_path: str, checkpoint: str, buckets: int = 64, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Fold a stream of events into Parquet states, in buckets of keys, of which a batch rewrites those that it touches.

    A batch reads the manifest of the one before it and the buckets named there, and writes its own, so a batch that is
    repeated after a failure gives the same result. Buckets that no later batch can need are deleted. ``prepare`` is applied to
    each batch (``with_known``, for one).
    """
    spark = events.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        place = F.pmod(F.hash(*fold.key), F.lit(buckets))
        now = folded(prepare(batch) if prepare else batch, fold).persist()  # read twice below
        before = _manifest(spark, state_path, number - 1)
        touched = {r[0] for r in now.select(place).distinct().collect()}  # at most ``buckets`` numbers
        old = _states(spark, state_path, {b: at for b, at in before.items() if b in touched}, now)
        merged(old, now, fold).withColumn("bucket", place).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/batch={number}")
        after = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(after.items()), "bucket int, at long").coalesce(1).write.mode("overwrite").parquet(f"{state_path}/manifest/batch={number}")
        now.unpersist()
        # This batch may be repeated from the manifest before it, but no earlier one can.
        for b, at in _manifest(spark, state_path, number - 2).items():
            if before.get(b) != at:
                fs, path = _files(spark, f"{state_path}/batch={at}/bucket={b}")
                fs.delete(path, True)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
