"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut_lineage


#: Edges of a partition, and partitions, at least: a round has a dozen small steps, each of which would otherwise leave files for every shuffle partition.
EDGES, PARTS = 50_000, 32


def _parts(edges: int) -> int:
    """Partitions for so many edges."""
    return max(PARTS, -(-edges // EDGES))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Two shuffled aggregates and joins a round, no group is ever gathered; the number of
    rounds grows with the logarithm of the longest chain. Self links and nulls are ignored. A round's
    steps run in as many tasks as its edges need, not in one for each shuffle partition.
    Raises if ``max_rounds`` do not suffice, since part of a component would be wrong.
    """
    now = cut_lineage(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        n = _parts(seen[0])
        now = now.coalesce(n)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(n).distinct().coalesce(n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(n).distinct().coalesce(n))
        before, seen = seen, _digest(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    now = now.coalesce(_parts(seen[0]))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
