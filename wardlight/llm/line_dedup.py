"""Removal of passages of three or more lines that stand somewhere before.

Every three consecutive lines of a document form a window; overlapping windows of one passage
follow each other. Windows are compared by a 128-bit hash over all documents, the first place (smallest
doc_id, then position) of a window stays, and at every later place the window's three lines
are covered. Covered positions merge into runs, and a text keeps the slices between its runs.

The first places are an aggregate with a map-side part, so a window that a third of all documents
have costs a row a task; rows are then matched by a join that adaptive execution splits at hot windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WHITE, cut_lineage, fresh, let, quoted

WIDTH = 3


def _windows(text: Column) -> Column:
    """Structs (pos, h1, h2) of the windows with a word in them."""

    def of(lines: Column) -> Column:
        def window(i: Column) -> Column:
            three = [F.get(lines, i + k) for k in range(WIDTH)]
            word = F.length(F.btrim(F.concat(*three), F.lit(WHITE))) > 0
            return F.when(word, F.struct(i.alias("pos"), F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(1), *three).alias("h2")))

        found = F.transform(F.sequence(F.lit(0), F.size(lines) - WIDTH), window)
        return F.when(F.size(lines) >= WIDTH, F.filter(found, lambda w: w.isNotNull()))

    return let(F.split(text, "\n"), of)


def _kept_text(text: Column, runs: Column) -> Column:
    """The lines between the runs, which are sorted and disjoint (start, stop)."""

    def cut(lines: Column) -> Column:
        start = lambda j: F.coalesce(F.get(runs, j - 1)["stop"], F.lit(0))
        before = F.transform(runs, lambda r, j: F.slice(lines, start(j) + 1, r["start"] - start(j)))
        last = F.get(runs, F.size(runs) - 1)["stop"]
        return F.array_join(F.concat(F.flatten(before), F.slice(lines, last + 1, F.size(lines))), "\n")

    return let(F.split(text, "\n"), cut)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(_id, _key, runs): the runs of lines to remove, for the documents that have any."""
    windows = docs.select("_id", "_key", F.explode(_windows(F.col("text"))).alias("w")).select("_id", "_key", "w.*")
    place = F.struct("_id", "_key", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first")
    first = cut_lineage(first)  # so that the join below has an exchange on both sides and can be split
    later = windows.join(first, ["h1", "h2"]).where(place > F.col("first")).select("_id", "_key", "pos")
    order = Window.partitionBy("_id", "_key").orderBy("pos")
    begins = F.coalesce((F.col("pos") > F.lag("pos").over(order) + WIDTH).cast("int"), F.lit(0))
    runs = later.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    runs = runs.groupBy("_id", "_key", "run").agg(F.min("pos").alias("start"), (F.max("pos") + WIDTH).alias("stop"))
    return runs.groupBy("_id", "_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining text, and n_lines, n_removed and n_runs (replaced if there).

    A text of fewer than three lines stays, a null text stays null (0 lines). Windows of blank lines
    don't count. A row without doc_id comes after all others. Rows that repeat a doc_id with the same
    text are one place and stay alike; with another text they are ordered by its hash.
    """
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "n_runs")]
    ident, key, found = fresh(docs.columns, "_id", "_key", "_runs")
    keyed = docs.select(
        *map(quoted, own),
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias(ident),
        F.xxhash64("text").alias(key),
    )
    runs = repeated_runs(keyed.select(F.col(ident).alias("_id"), F.col(key).alias("_key"), "text")).toDF(ident, key, found)
    joined = keyed.join(runs, [ident, key], "left")
    removed = F.aggregate(found, F.lit(0), lambda a, r: a + r["stop"] - r["start"])
    return joined.select(
        *[quoted(c) for c in own if c.lower() != "text"],
        F.when(F.col(found).isNull(), F.col("text")).otherwise(_kept_text(F.col("text"), F.col(found))).alias("text"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_runs"),
    )
