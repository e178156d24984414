"""Extractions as typed columns, by schema name and version.

JSON is parsed once into a variant. A registered schema takes its fields from it by path and type; the first path that is
not there or has another type rejects the extraction. What no schema is registered for stays a variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By (schema name, version): columns with path, type and whether they must be there.
Registry = dict[tuple[str, str], dict[str, tuple[str, str, bool]]]


def typed(extractions: DataFrame, registry: Registry, name: str = "schema_name", version: str = "schema_version", data: str = "data") -> DataFrame:
    """``extractions`` with a struct column for each registered schema, ``broken`` and ``other``.

    The struct of a row's own schema is filled unless ``broken`` says why not: the first path (in the schema's order) without a value that must be there or
    with one of another type, or '$' if the text is no JSON object. ``other`` has the variant of rows without a registered schema, null where that is no JSON. A number in
    a string, and null where a value may be missing, are read as Spark casts variants.
    """
    out = extractions.withColumn("_v", F.try_parse_json(F.col(data)))
    broken, columns, known = F.lit(None).cast("string"), {}, F.lit(False)
    for (schema, of), fields in registry.items():
        own = F.coalesce((F.col(name) == schema) & (F.col(version) == of), F.lit(False))
        known = known | own
        values, faults = {}, []
        for column, (path, kind, needed) in fields.items():
            there = F.try_variant_get("_v", path, "variant")
            has = there.isNotNull() & ~F.coalesce(F.is_variant_null(there), F.lit(False))
            values[column] = F.try_variant_get("_v", path, kind)
            faults.append(F.when((has & values[column].isNull()) | (F.lit(needed) & ~has), path))
        fault: Column = F.when(~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)), "$").otherwise(F.coalesce(*faults))
        broken = F.when(own, fault).otherwise(broken)
        columns[f"{schema}_v{of}"] = (own, F.struct(*[v.alias(c) for c, v in values.items()]))
    out = out.withColumn("broken", broken).withColumn("_known", known)
    out = out.withColumns({c: F.when(own & F.col("broken").isNull(), value) for c, (own, value) in columns.items()})
    return out.withColumn("other", F.when(~F.col("_known"), F.col("_v"))).drop("_v", "_known")


def seen_schema(extractions: DataFrame, data: str = "data") -> DataFrame:
    """(schema_name, schema_version, n, seen): the merged schema of what came, to register a new one from."""
    parsed = F.try_parse_json(F.col(data))
    return extractions.groupBy("schema_name", "schema_version").agg(F.count("*").alias("n"), F.schema_of_variant_agg(parsed).alias("seen"))
