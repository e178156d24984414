"""Lookups, filters, ordered and paginated lists, and the newest row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..schema import ENUMS


def by_key(table: DataFrame, **key) -> DataFrame:
    """Rows whose columns have the given values; reaches the scan as pushed filters."""
    for name, value in key.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def one_by_key(table: DataFrame, **key) -> DataFrame:
    """As ``by_key``, for a key that must be unique: fails when the rows are read if there are two or more."""
    found = by_key(table, **key)
    n = F.count("*").over(Window.partitionBy(*key))
    return found.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.lit(True)).cast("boolean")).drop("_n")


def by_identity(accounts: DataFrame, identity: str) -> DataFrame:
    """Accounts with an e-mail address, as given or normalised, or with a phone number, by the form of ``identity``."""
    import re

    if re.match(scalars.EMAIL, identity):
        return accounts.where((F.col("email") == identity) | (scalars.normalize_email(F.col("email")) == identity.strip().lower()))
    return accounts.where(F.col("phone") == identity.strip())


def unexpired(table: DataFrame, now: Column, column: str = "expires_at") -> DataFrame:
    """Rows that never expire or expire after ``now``."""
    return table.where(F.col(column).isNull() | (F.col(column) > now))


def active_grants(grants: DataFrame, now: Column, flag: str | None = None) -> DataFrame:
    """Active, unexpired grants; with ``flag``, those for which it is true (null counts as false)."""
    found = unexpired(grants.where(F.col("status") == "active"), now)
    return found if flag is None else found.where(F.col(flag).eqNullSafe(True))


def consented(consents: DataFrame, purpose: str, now: Column) -> DataFrame:
    """Active, unexpired consents to a purpose."""
    return unexpired(consents.where((F.col("status") == "active") & (F.col("purpose") == purpose)), now)


def valid_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions neither revoked nor expired."""
    return sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now))


def search(table: DataFrame, **wanted) -> DataFrame:
    """Rows that match every argument that is not None."""
    return by_key(table, **{k: v for k, v in wanted.items() if v is not None})


def newest_first(table: DataFrame, by: str, key: str) -> DataFrame:
    """Descending, nulls first as in PostgreSQL, ties by the key descending."""
    return table.orderBy(F.col(by).desc_nulls_first(), F.col(key).desc())


def page(table: DataFrame, by: str, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page, newest first. The limit is held to 1..500 and the offset to 0 or more."""
    return newest_first(table, by, key).offset(max(0, offset)).limit(min(500, max(1, limit)))


def newest_of_each(table: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``; tasks keep one row a key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return table.withColumn("_place", place).where("_place = 1").drop("_place")


def checked(table: DataFrame, **rules: Column) -> DataFrame:
    """Adds ``reason``, the name of the first rule that a row breaks (null: none), and ``valid``. A null verdict is a breach."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        reason = F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(reason)
    return table.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def patient_context(patients: DataFrame, persons: DataFrame, records: DataFrame) -> DataFrame:
    """Each patient with structs ``person`` and ``medical_record`` and, where one is missing, the ``problem``.

    ``persons`` and ``records`` have an id each, and records a patient_id; of several records of a patient the first is taken.
    """
    person = persons.select(F.col("id").alias("person_id"), F.struct(*persons.columns).alias("person"))
    record = records.groupBy("patient_id").agg(F.min(F.struct(*records.columns)).alias("medical_record"))
    out = patients.withColumnRenamed("id", "patient_id").join(person, "person_id", "left").join(record, "patient_id", "left")
    return out.withColumn("problem", F.when(F.col("person").isNull(), "no person").when(F.col("medical_record").isNull(), "no medical record"))


def owners(documents: DataFrame, records: DataFrame) -> DataFrame:
    """(document_id, patient_id) by way of the medical record; a document without one is left out."""
    return documents.select(F.col("id").alias("document_id"), "medical_record_id").join(records.select(F.col("id").alias("medical_record_id"), "patient_id"), "medical_record_id").select("document_id", "patient_id")


def patch_reason(fields: list[str], today: Column) -> Column:
    """Why a profile's patch is refused: no field is set, a name is empty, a birth is in the future, or a sex is none of the domain; null if it is not."""
    return (
        F.when(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNull(), "empty")
        .when(F.col("first_name") == "", "first_name")
        .when(F.col("date_of_birth") > today.cast("date"), "date_of_birth")
        .when(~F.col("sex").isin(*ENUMS["sex"]), "sex")
    )
