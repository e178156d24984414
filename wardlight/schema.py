"""Tables, enum domains and the constraint checks that Spark does not enforce itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Enum domains and links (fixed values).
ENUMS: dict[str, tuple[str, ...]] = {
    "account_status": ("pending", "active", "blocked", "deleted"),
    "role": ("client", "specialist", "organization_admin", "system_admin", "support"),
    "permission": (
        "medical_record.read", "medical_record.write", "document.read", "document.upload", "document.download",
        "encounter.read", "encounter.create", "encounter.update", "analytics.read", "user.manage", "organization.manage",
    ),
    "grant_status": ("active", "revoked", "expired"),
    "document_status": ("pending", "uploaded", "processing", "completed", "failed", "deleted"),
    "job_type": ("pdf_conversion", "ai_extraction", "embedding"),
    "job_status": ("queued", "running", "succeeded", "retrying", "failed"),
    "extraction_status": ("pending", "extracting", "succeeded", "failed"),
    "encounter_status": ("scheduled", "in_progress", "completed", "cancelled", "no_show"),
    "sex": ("male", "female", "unspecified"),
}

#: Permissions of each role (fixed values).
ROLE_PERMISSIONS: dict[str, tuple[str, ...]] = {
    "client": ("medical_record.read", "document.read", "document.upload", "document.download"),
    "specialist": (
        "medical_record.read", "medical_record.write", "document.read", "document.upload", "document.download",
        "encounter.read", "encounter.create", "encounter.update", "analytics.read",
    ),
    "organization_admin": ("organization.manage",),
    "system_admin": ENUMS["permission"],
    "support": (),
}

#: Event types of the document pipeline with the fields they have beyond the base ones (fixed values).
EVENT_FIELDS: dict[str, str] = {
    "DocumentUploadRequested": "tenant_id string, medical_record_id string, temp_path string, original_filename string, mime_type string, size_bytes long",
    "DocumentStored": "storage_key string, mime_type string, size_bytes long, checksum string",
    "DocumentUploaded": "storage_key string",
    "DocumentConverted": "output_storage_key string",
    "DocumentAnalysisCompleted": "extraction_id string, schema_name string, schema_version string, status string, confidence double, data string",
    "DocumentProcessingFailed": "job_type string, error_code string, error_message string",
}
EVENT_BASE = "event_id string, document_id string, document_version_id string, patient_id string, occurred_at timestamp"

#: JSON of a laboratory report.
LAB_RESULT = "results array<struct<test_name: string, value: double, unit: string, reference_min: double, reference_max: double>>"


def duplicate_keys(table: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows: empty if the key is unique. Null keys don't count."""
    return table.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose reference is not null and not in ``parent``."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def outside_domain(table: DataFrame, column: str, enum: str) -> DataFrame:
    """Rows whose value is not one of an enum's."""
    return table.where(F.col(column).isNotNull() & ~F.col(column).isin(*ENUMS[enum]))
