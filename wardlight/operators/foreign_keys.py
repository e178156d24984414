"""Deletes over the whole graph of foreign keys.

A plan goes once through the tables, parents before children, and makes of each the rows that go, the rows that stay and the references
that become null. Every reference costs one join on its key with the keys of the parents that go; nothing is looked up row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    action: str
    key: str = "id"


#: References between the entities and what a delete of the parent does (fixed values).
FOREIGN_KEYS = (
    ForeignKey("patient", "person_id", "person", CASCADE),
    ForeignKey("specialist", "person_id", "person", CASCADE),
    ForeignKey("account", "person_id", "person", SET_NULL),
    ForeignKey("medical_record", "patient_id", "patient", CASCADE),
    ForeignKey("access_grant", "patient_id", "patient", CASCADE),
    ForeignKey("access_grant", "account_id", "account", CASCADE),
    ForeignKey("access_grant", "organization_id", "organization", SET_NULL),
    ForeignKey("account_role", "account_id", "account", CASCADE),
    ForeignKey("session_row", "account_id", "account", CASCADE),
    ForeignKey("membership", "account_id", "account", CASCADE),
    ForeignKey("membership", "organization_id", "organization", CASCADE),
    ForeignKey("audit_log", "actor_account_id", "account", SET_NULL),
    ForeignKey("audit_log", "patient_id", "patient", SET_NULL),
    ForeignKey("encounter", "medical_record_id", "medical_record", CASCADE),
    ForeignKey("encounter", "specialist_id", "specialist", SET_NULL),
    ForeignKey("encounter", "organization_id", "organization", SET_NULL),
    ForeignKey("document", "medical_record_id", "medical_record", CASCADE),
    ForeignKey("document", "encounter_id", "encounter", SET_NULL),
    ForeignKey("document", "uploaded_by_account_id", "account", SET_NULL),
    ForeignKey("document_version", "document_id", "document", CASCADE),
    ForeignKey("document_version", "created_by_account_id", "account", SET_NULL),
    ForeignKey("processing_job", "document_id", "document", CASCADE),
    ForeignKey("processing_job", "document_version_id", "document_version", CASCADE),
    ForeignKey("extraction", "document_id", "document", CASCADE),
    ForeignKey("extraction", "document_version_id", "document_version", CASCADE),
)


def in_order(tables: list[str], keys: tuple[ForeignKey, ...]) -> list[str]:
    """Tables with every parent before its children; references in a circle are an error."""
    above = {t: {k.parent for k in keys if k.child == t and k.parent in tables} for t in tables}
    out: list[str] = []
    while len(out) < len(tables):
        ready = [t for t in tables if t not in out and above[t] <= set(out)]
        if not ready:
            raise ValueError(f"references go in a circle: {sorted(set(tables) - set(out))}")
        out += ready
    return out


class Restricted(ValueError):
    """A row that stays refers to one that would go."""


def deleted(tables: dict[str, DataFrame], doomed: dict[str, DataFrame], keys: tuple[ForeignKey, ...] = FOREIGN_KEYS) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """All tables after a delete, and the rows of each that went.

    ``doomed`` has the keys (column id) of the rows to delete, by table. Null references and references to rows that are not there do nothing.
    Keys of columns that a table has not are passed over. A restricting reference is judged at the end, as deferred constraints are: it refuses (``Restricted``) if its
    row stays, which needs a job for each such reference.
    """
    keys = tuple(k for k in keys if k.child in tables and k.parent in tables and k.column in tables[k.child].columns)
    gone: dict[str, DataFrame] = {}
    stay: dict[str, DataFrame] = {}
    for t in in_order(list(tables), keys):
        own = [k for k in keys if k.child == t and k.parent in gone]
        flags = []
        rows = tables[t]
        if t in doomed:
            rows = rows.join(doomed[t].select(F.col("id")).where("id is not null").distinct().withColumn("_asked", F.lit(True)), "id", "left")
            flags.append(F.coalesce("_asked", F.lit(False)))
        for i, k in enumerate(own):
            parents = gone[k.parent].select(F.col(k.key).alias(k.column)).distinct().withColumn(f"_gone{i}", F.lit(True))
            rows = rows.join(parents, k.column, "left")
            if k.action == CASCADE:
                flags.append(F.coalesce(f"_gone{i}", F.lit(False)))
        goes = F.lit(False)
        for f in flags:
            goes = goes | f
        nulls = {k.column: F.when(F.col(f"_gone{i}").isNull(), F.col(k.column)) for i, k in enumerate(own) if k.action == SET_NULL}
        rows = rows.withColumn("_goes", goes)
        if flags:
            gone[t] = rows.where("_goes").select(*tables[t].columns)
        left = rows.where("not _goes")
        for i, k in enumerate(own):
            if k.action == RESTRICT and left.where(F.col(f"_gone{i}")).limit(1).count():
                raise Restricted(f"{k.child}.{k.column} refers to rows of {k.parent} that are to go")
        stay[t] = left.withColumns(nulls).select(*tables[t].columns) if nulls else left.select(*tables[t].columns)
    return stay, gone
