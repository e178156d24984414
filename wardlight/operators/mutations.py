"""Changes of tables as functions from tables to tables; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed


def insert_missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table and those rows whose key it has not; ``created`` tells which. A key that is given twice is added once."""
    new = rows.dropDuplicates(key).join(table.select(*key), key, "left_anti")
    return table.withColumn("created", F.lit(False)).unionByName(new.withColumn("created", F.lit(True)), allowMissingColumns=True)


def insert_select(table: DataFrame, rows: DataFrame, **values: Column) -> DataFrame:
    """The table with the rows appended; ``values`` give further columns, and what neither has is null."""
    given = rows.withColumns(values) if values else rows
    kinds = dict(table.dtypes)
    new = given.select(*[(F.col(c) if c in given.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in table.columns])
    return table.unionByName(new)


def ensure_records(records: DataFrame, patients: DataFrame, now: Column) -> DataFrame:
    """Medical records (id, patient_id, created_at) so that each patient has one: those there, and a new one with a random id for each patient without.

    A patient that is given twice, or without an id, gets no second one and none. Random ids change when a lost part is made
    again, so the result is to be written before it is read twice.
    """
    without = patients.select(F.col("id").alias("patient_id")).where("patient_id is not null").distinct().join(records.select("patient_id"), "patient_id", "left_anti")
    return insert_select(records, without, id=F.uuid(), created_at=now)


def evolved(table: DataFrame, renamed: dict[str, str], added: dict[str, str], dropped: tuple[str, ...] = ()) -> DataFrame:
    """The table with columns dropped, renamed, and added as nulls of a type, in this order."""
    return table.drop(*dropped).withColumnsRenamed(renamed).select("*", *[F.lit(None).cast(t).alias(c) for c, t in added.items()])


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, the changes' columns win, nulls too. Other columns stay."""
    named = [c for c in changes.columns if c not in key]
    new = changes.select(*key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in named])
    value = lambda c: F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in named else F.col(c)
    return table.join(new, key, "full_outer").select(*[c if c in key else value(c).alias(c) for c in table.columns])


#: What saving a session that is there changes (fixed values); its account and the time of its creation stay.
SESSION_COLUMNS = ("refresh_token_hmac", "revoked_at", "expires_at", "last_used_at", "user_agent", "ip_address", "device_id", "platform", "app_version")


def save_sessions(table: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with the given ones saved: of one that is there (by id) the nine columns are replaced, nulls too; one that is not is added whole.

    A session that is given twice is saved as its last use, nulls first, says; one without an id is left out.
    """
    order = F.struct(F.col("last_used_at"), F.struct(*[c for c in table.columns if c not in ("id", "last_used_at")]))
    last = sessions.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*table.columns), order).alias("r")).select("r.*")
    both = table.join(last.select(*[F.col(c).alias(f"_new_{c}") for c in table.columns]), F.col("id") == F.col("_new_id"), "full_outer")
    saved, there = F.col("_new_id").isNotNull(), F.col("id").isNotNull()
    return both.select(*[F.when(saved & (F.lit(c in SESSION_COLUMNS) | ~there), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in table.columns])


def patch(table: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """Fields in three states: each patched column is a struct (set, value), and a null that is set is not an unset field."""
    named = [c for c in patches.columns if c not in key]
    new = patches.select(*key, *[F.col(c).alias(f"_p_{c}") for c in named])
    value = lambda c: F.when(F.col(f"_p_{c}.set"), F.col(f"_p_{c}.value")).otherwise(F.col(c)) if c in named else F.col(c)
    return table.join(new, key, "left").select(*[c if c in key else value(c).alias(c) for c in table.columns])


def revoke(grants: DataFrame, wanted: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The grants with the wanted ones revoked, and the keys that this changed (those revoked before are not among them)."""
    hit = grants.join(wanted.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    changes = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("status") != "revoked")
    after = hit.withColumn("status", F.when(F.col("_hit"), "revoked").otherwise(F.col("status"))).drop("_hit")
    return after, hit.where(changes).select(*key)


def set_difference(held: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Links to change so that ``held`` becomes ``wanted``: key and ``change``, 'add' or 'remove'."""
    gone = held.select(*key).distinct().join(wanted.select(*key), key, "left_anti").withColumn("change", F.lit("remove"))
    return gone.unionByName(wanted.select(*key).distinct().join(held.select(*key), key, "left_anti").withColumn("change", F.lit("add")))


def fill_when_null(table: DataFrame, column: str, value: Column) -> DataFrame:
    return table.withColumn(column, F.when(F.col(column).isNull() & value.isNotNull(), value).otherwise(F.col(column)))


def numbered(table: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """Consecutive numbers from 1 over all rows in the order of the columns, without one task for all.

    Rows are dealt by ranges of all the order's columns, so that equal values of the first are split too, and written once, since
    ranges are found by a sample. Each range is numbered by itself, and the sizes of the ranges before are added.
    """
    ranged = checkpointed(table.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_in", inside).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_in") + F.col("_before")).drop("_range", "_in", "_before")


def zip_rows(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """The n-th row of one table beside the n-th of the other, as far as both go; column names must differ."""
    return numbered(left, *left_order).join(numbered(right, *right_order), "rn")


def set_null_orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """References whose parent is gone become null."""
    known = parent.select(F.col(key).alias(column), F.lit(True).alias("_known")).distinct()
    return child.join(known, column, "left").withColumn(column, F.when(F.col("_known"), F.col(column))).select(*child.columns)


def cascade(child: DataFrame, column: str, removed: DataFrame, key: str) -> DataFrame:
    """Children whose parent is removed go too."""
    return child.join(removed.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(*child.columns)


def next_versions(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, next_version): one more than the largest so far, 1 for a document without versions."""
    top = versions.groupBy(F.col("document_id").alias("id")).agg(F.max("version").alias("top"))
    return documents.select("id").join(top, "id", "left").select("id", (F.coalesce("top", F.lit(0)) + 1).alias("next_version"))


def rotate_sessions(sessions: DataFrame, refreshed: DataFrame, now: Column, life: str = "interval 30 days") -> DataFrame:
    """Sessions (id, account_id, revoked_at, expires_at) after some are refreshed: (id, new_id) ends the old one now and begins a new one.

    A session that is revoked or expired is not refreshed, and one that is asked for twice is refreshed once.
    """
    asked = refreshed.groupBy("id").agg(F.min("new_id").alias("new_id"))
    marked = sessions.join(asked, "id", "left")
    valid = F.col("new_id").isNotNull() & F.col("revoked_at").isNull() & (F.col("expires_at") > now)
    old = marked.withColumn("revoked_at", F.when(valid, now).otherwise(F.col("revoked_at"))).select("id", "account_id", "revoked_at", "expires_at")
    new = marked.where(valid).select(F.col("new_id").alias("id"), "account_id", F.lit(None).cast(dict(sessions.dtypes)["revoked_at"]).alias("revoked_at"), (now + F.expr(life)).alias("expires_at"))
    return old.unionByName(new)


def session_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, event): sessions that a change began ('created') or ended ('revoked')."""
    old = before.select("id", F.col("revoked_at").isNotNull().alias("was"), F.lit(True).alias("known"))
    both = after.join(old, "id", "left")
    event = F.when(F.col("known").isNull(), "created").when(~F.col("was") & F.col("revoked_at").isNotNull(), "revoked")
    return both.select("id", event.alias("event")).where("event is not null")
