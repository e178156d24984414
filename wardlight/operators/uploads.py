"""Quota, upload checks, and the outcome of storing a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

FREE_DOCUMENTS = 10
MOST_BYTES = 50 * 1024 * 1024


def over_quota(accounts: DataFrame, documents: DataFrame, owner: str, free: int = FREE_DOCUMENTS) -> DataFrame:
    """(id, n_documents) of accounts without subscription that have ``free`` documents or more, failed ones too."""
    counts = documents.groupBy(F.col(owner).alias("id")).agg(F.count("*").alias("n"))
    return accounts.join(counts, "id", "left").select("id", "is_subscribed", F.coalesce("n", F.lit(0)).alias("n_documents")).where(~F.col("is_subscribed") & (F.col("n_documents") >= free)).select("id", "n_documents")


def upload_outcome(requests: DataFrame, staged: Column, most: int = MOST_BYTES) -> DataFrame:
    """Requests with ``outcome`` (stored, failed), ``error_code``, and the key they are stored under (null if failed)."""
    code = (
        F.when(~F.coalesce(F.lower("mime_type").isin(*scalars.EXTENSION_BY_MIME), F.lit(False)), "unsupported_type")
        .when(F.col("size_bytes") > most, "too_large")
        .when(~F.coalesce(staged, F.lit(False)), "missing_file")
    )
    key = scalars.object_key(F.col("tenant_id"), F.col("patient_id"), F.col("document_id"), F.col("document_version_id"), scalars.stored_name(F.lower("mime_type")))
    return requests.withColumn("error_code", code).withColumns(
        {"outcome": F.when(F.col("error_code").isNull(), "stored").otherwise("failed"), "storage_key": F.when(F.col("error_code").isNull(), key)}
    )
