"""Roles, permissions, and the decision who may see a patient.

An account in good standing may if the patient is itself, or if it is a specialist and holds an active,
unexpired grant with the flag asked for. Standing is judged first. The decision is a union of two joins on keys, never
accounts times patients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENUMS, ROLE_PERMISSIONS
from .reads import active_grants


def role_permissions(spark: SparkSession) -> DataFrame:
    """(role_code, permission_code): the 25 links."""
    rows = [(role, p) for role, permissions in ROLE_PERMISSIONS.items() for p in permissions]
    return spark.createDataFrame(rows, "role_code string, permission_code string")


def catalogue(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables role (role_id, role_code), permission (permission_id, permission_code) and their links, numbered in order."""
    roles = {c: i for i, c in enumerate(ENUMS["role"], 1)}
    permissions = {c: i for i, c in enumerate(ENUMS["permission"], 1)}
    links = [(roles[r], permissions[p]) for r, held in ROLE_PERMISSIONS.items() for p in held]
    return (
        spark.createDataFrame([(i, c) for c, i in roles.items()], "role_id int, role_code string"),
        spark.createDataFrame([(i, c) for c, i in permissions.items()], "permission_id int, permission_code string"),
        spark.createDataFrame(links, "role_id int, permission_id int"),
    )


#: Rows of a table of roles, permissions or their links up to which it is sent to every task.
MOST_LINKS = 10_000


def permissions_of(account_roles: DataFrame, links: DataFrame, permissions: DataFrame) -> DataFrame:
    """Distinct (account_id, permission_code) from (account_id, role_id) by way of the roles' links and permissions.

    Links and permissions are made one table first. While it is small, which is counted, accounts are not shuffled by their few roles
    but see all of it; their rows meet again only to be made distinct.
    """
    held = _small(links.join(permissions, "permission_id").select("role_id", "permission_code").distinct())
    return account_roles.select("account_id", "role_id").join(held, "role_id").select("account_id", "permission_code").distinct()


def _small(table: DataFrame) -> DataFrame:
    """A table with the broadcast hint if it has at most ``MOST_LINKS`` rows."""
    return F.broadcast(table) if table.limit(MOST_LINKS + 1).count() <= MOST_LINKS else table


def newest_by_flag(grants: DataFrame, flags: list[str]) -> DataFrame:
    """Of each patient, account and flag that is set, the newest grant; of equally new ones the one with the largest id."""
    each = F.explode(F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]), lambda x: x.isNotNull()))
    rows = grants.select("patient_id", "account_id", "id", "created_at", each.alias("flag"))
    return rows.groupBy("patient_id", "account_id", "flag").agg(F.max(F.struct("created_at", "id")).alias("g")).select("patient_id", "account_id", "flag", "g.created_at", "g.id")


def account_permissions(account_roles: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (account_id, permission_code)."""
    return account_roles.join(_small(links), "role_code").select("account_id", "permission_code").distinct()


def holds_any(account_roles: DataFrame, wanted: list[str]) -> DataFrame:
    """(account_id, allowed): whether an account holds one of the wanted roles."""
    return account_roles.groupBy("account_id").agg(F.bool_or(F.col("role_code").isin(*wanted)).alias("allowed"))


def may_access(accounts: DataFrame, patients: DataFrame, account_roles: DataFrame, grants: DataFrame, now: Column, flag: str | None = None) -> DataFrame:
    """Distinct (account_id, patient_id) that are allowed, with ``via`` 'owner' or 'grant' (an owner's grant is not told)."""
    able = accounts.where(F.col("status") == "active").select(F.col("id").alias("account_id"), "person_id")
    own = able.join(patients.select(F.col("id").alias("patient_id"), "person_id"), "person_id").select("account_id", "patient_id").distinct()
    specialists = account_roles.where(F.col("role_code") == "specialist").select("account_id")
    given = (
        active_grants(grants, now, flag)
        .select("account_id", "patient_id")
        .join(able.select("account_id"), "account_id", "left_semi")
        .join(specialists, "account_id", "left_semi")
        .distinct()
        .join(own, ["account_id", "patient_id"], "left_anti")
    )
    return own.withColumn("via", F.lit("owner")).unionByName(given.withColumn("via", F.lit("grant")))


def decided(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Requests (account_id, patient_id, ...) with ``allowed`` and ``via``; every request gets one row."""
    return requests.join(allowed, ["account_id", "patient_id"], "left").withColumn("allowed", F.col("via").isNotNull())


def audit_rows(decisions: DataFrame, action: str, now: Column) -> DataFrame:
    """An audit row for each decision, allowed or not."""
    return decisions.select(
        F.col("account_id").alias("actor_account_id"),
        F.lit(action).alias("action"),
        "patient_id",
        F.to_json(F.struct("allowed", "via")).alias("metadata"),
        now.alias("created_at"),
    )
