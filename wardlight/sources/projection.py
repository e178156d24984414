"""The clinical entities as views of the driver's Parquet tables.

Each entity is a table, an optional filter and its columns as SQL expressions that Spark and DuckDB read alike,
so that the same rule serves ``entity`` and the check queries' ``oracle_views``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which expiry and validity are judged in check queries.
NOW = "1998-01-01 00:00:00"


@dataclass(frozen=True)
class Entity:
    table: str
    columns: dict[str, str] = field(default_factory=dict)
    where: str = "true"


_ROLE = """case c_mktsegment when 'BUILDING' then 'specialist' when 'AUTOMOBILE' then 'organization_admin'
 when 'MACHINERY' then 'system_admin' when 'HOUSEHOLD' then 'support' else 'client' end"""

ENTITIES: dict[str, Entity] = {
    "account": Entity(
        "customer",
        {
            "id": "c_custkey",
            "email": "case when c_custkey % 5 = 0 then null else concat(' ', c_name, '@Example.com ') end",
            "phone": "concat('+1', lpad(cast(c_custkey as varchar(20)), 10, '0'))",
            "status": "case when c_acctbal >= 0 then 'active' else 'blocked' end",
            "person_id": "case when c_custkey % 7 = 0 then null else c_custkey end",
            "is_subscribed": "c_mktsegment = 'BUILDING'",
            "role_code": _ROLE,
        },
    ),
    "account_role": Entity("customer", {"account_id": "c_custkey", "role_code": _ROLE}),
    "patient": Entity("customer", {"id": "c_custkey", "person_id": "c_custkey"}),
    "person": Entity("customer", {"id": "c_custkey", "full_name": "c_name", "sex": "case c_custkey % 3 when 0 then 'male' when 1 then 'female' else 'unspecified' end"}),
    "specialist": Entity("supplier", {"id": "s_suppkey", "person_id": "s_suppkey", "active": "s_acctbal >= 0"}),
    "membership": Entity("supplier", {"account_id": "s_suppkey % 50", "organization_id": "s_nationkey", "status": "case when s_acctbal >= 0 then 'active' else 'left' end", "joined_no": "s_suppkey"}),
    "encounter": Entity(
        "orders",
        {
            "id": "o_orderkey",
            "medical_record_id": "o_custkey",
            "started_at": "o_orderdate",
            "status": "case o_orderstatus when 'F' then 'completed' when 'O' then 'scheduled' else 'in_progress' end",
            "type": "o_orderpriority",
        },
    ),
    "document": Entity(
        "documents",
        {
            "id": "doc_id",
            "medical_record_id": "doc_id % 100",
            "document_type": "source",
            "size_bytes": "n_chars",
            "status": "case when doc_id % 11 = 0 then 'failed' else 'completed' end",
            "path": "concat('/staging/', lang, '/Doc ', cast(doc_id as varchar(20)), case doc_id % 6 when 0 then '.PDF' when 1 then '.jpg' when 2 then '.tiff' when 3 then '.png' when 4 then '.txt' else '' end)",
            "content_type": "case when doc_id % 4 = 0 then 'application/pdf' when doc_id % 4 = 1 then 'application/octet-stream' else '' end",
            "title": "case when doc_id % 3 = 0 then '' else concat('Title ', cast(doc_id as varchar(20))) end",
        },
    ),
    "medical_record": Entity("customer", {"id": "c_custkey + 1000000", "patient_id": "c_custkey"}, "c_custkey % 9 <> 0"),
    "processing_job": Entity("labels", {"id": "doc_id + 5000000", "job_document_id": "doc_id * 2", "job_status": "case when toxic = 1 then 'failed' else 'succeeded' end"}),
    "profile_patch": Entity(
        "orders",
        {
            "id": "o_orderkey",
            "first_name": "case when o_orderkey % 3 = 0 then null when o_orderkey % 31 = 1 then '' else o_orderpriority end",
            "date_of_birth": "case when o_orderkey % 4 = 0 then null else cast(o_orderdate as date) end",
            "sex": "case o_orderkey % 5 when 0 then 'male' when 1 then 'unknown' end",
        },
    ),
    "document_version": Entity("conversations", {"document_id": "conv_id", "document_version_id": "concat(cast(conv_id as varchar(20)), '-', cast(turn as varchar(20)))", "version": "turn", "s3_key": "concat('k/', cast(conv_id as varchar(20)), '/', cast(turn as varchar(20)))", "checksum": "case when turn = 0 then null else role end"}),
    "extraction": Entity("labels", {"id": "doc_id", "document_id": "doc_id", "status": "case when toxic = 1 then 'failed' else 'succeeded' end", "confidence": "case when quality = 1 then 0.97 else 0.42 end"}),
    "audit_log": Entity("events", {"id": "event_id", "actor_account_id": "user_id", "action": "event_type", "patient_id": "user_id % 40", "metadata": "props", "created_at": "ts"}),
    "session_row": Entity("events", {"id": "event_id", "account_id": "user_id", "revoked_at": "case when event_type = 'error' then ts else null end", "expires_at": "ts"}, "event_type <> 'view'"),
    "pipeline_event": Entity(
        "events",
        {
            "seq": "event_id",
            "document_id": "user_id",
            "document_version_id": "concat(cast(user_id as varchar(20)), '-', cast(event_id % 5 as varchar(20)))",
            "extraction_id": "user_id * 10 + event_id % 3",
            "storage_key": "concat('s/', cast(event_id as varchar(20)))",
            "mime_type": "case when event_id % 2 = 0 then 'application/pdf' else 'image/png' end",
            "error_code": "concat('E', cast(event_id % 7 as varchar(20)))",
            "error_message": "concat('step ', cast(event_id % 11 as varchar(20)), ' failed')",
            "type": "case event_type when 'signup' then 'DocumentUploadRequested' when 'click' then 'DocumentStored' when 'view' then 'DocumentConverted' when 'purchase' then 'DocumentAnalysisCompleted' else 'DocumentProcessingFailed' end",
            "occurred_at": "ts",
            "succeeded": "value >= 50",
            "checksum": "cast(event_id as varchar(20))",
            "confidence": "value",
            "size_bytes": "event_id * 3001",
        },
    ),
}

_GRANT = """
select o_custkey as patient_id, l_suppkey as account_id, max(l_shipdate) as expires_at, min(l_shipdate) as created_at,
 case when max(case when l_returnflag = 'R' then 1 else 0 end) = 1 then 'revoked' else 'active' end as status,
 max(case when l_linestatus = 'F' then 1 else 0 end) = 1 as can_view_documents, max(case when l_quantity > 40 then 1 else 0 end) = 1 as can_upload_documents
from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_suppkey"""
_OBSERVATION = """
select o_custkey as patient_id, p_type as code, l_quantity as value, l_shipdate as observed_at, l_orderkey as encounter_id, l_linenumber as line_no, l_extendedprice as price, l_partkey as part_id, l_suppkey as supplier_id
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An entity's rows; filters and columns reach the scan."""
    if name == "access_grant":
        joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
        flag = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
        return joined.groupBy(F.col("o_custkey").alias("patient_id"), F.col("l_suppkey").alias("account_id")).agg(
            F.max("l_shipdate").alias("expires_at"),
            F.min("l_shipdate").alias("created_at"),
            F.when(flag(F.col("l_returnflag") == "R"), "revoked").otherwise("active").alias("status"),
            flag(F.col("l_linestatus") == "F").alias("can_view_documents"),
            flag(F.col("l_quantity") > 40).alias("can_upload_documents"),
        )
    if name == "observation":
        joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")).join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        return joined.selectExpr(
            "o_custkey as patient_id", "p_type as code", "l_quantity as value", "l_shipdate as observed_at", "l_orderkey as encounter_id",
            "l_linenumber as line_no", "l_extendedprice as price", "l_partkey as part_id", "l_suppkey as supplier_id",
        )
    e = ENTITIES[name]
    return table(spark, sf_dir, e.table).where(e.where).selectExpr(*[f"{x} as {c}" for c, x in e.columns.items()])


def oracle_views(*names: str) -> str:
    """``with`` clauses for DuckDB that define the named entities."""
    parts = []
    for name in names:
        if name == "access_grant":
            body = _GRANT
        elif name == "observation":
            body = _OBSERVATION
        else:
            e = ENTITIES[name]
            body = "select " + ", ".join(f"{x} as {c}" for c, x in e.columns.items()) + f" from {e.table} where {e.where}"
        parts.append(f"{name} as ({body})")
    return "with " + ", ".join(parts)
