"""Near-duplicate detection with bottom-k sketches from one hash function.

1. Every text becomes the set of its 5-word shingles (64-bit hashes). Texts with equal
   sets collapse to their smallest doc_id, so that exact copies cost one row each.
2. A bottom-k sketch keeps the k smallest hashes of a set; all of them if it has fewer.
3. Inverted lists of the retained values generate overlaps. A similar pair shares at least
   ``least_overlap`` retained values, so it also shares one of each side's rarest
   ``c - least_overlap + 1``: only these are listed, and values of a single set never are.
4. The lists are read twice. First each set is compared with one hub, the most central member of
   the lists it is in; this joins a large group of copies with one row for each. Sets whose lists still
   hold more than one component are then listed again by their full sets, where the same prefix
   rule is exact, and all pairs across components in these lists are compared.
5. The union sketch (k smallest of both) estimates the similarity of a candidate and drops
   hopeless ones; the others are verified on their full sets, read again from the texts.

A pair of sets with fewer than 3/4 k shingles is never missed. For larger ones the sketch decides
which are compared: the slack is six standard deviations, a miss has probability below 1e-8.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut_lineage, shingle_sets, text_slices
from .components import connected_components

#: A sketch size that no set has.
WHOLE = 1 << 30
SKETCH = "doc_id long, n_shingles long, set_key binary, sketch array<long>"


def _sketches(k: int, width: int, with_text: bool = False):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, part in text_slices(texts):
                sets = shingle_sets(part, width)
                columns = [
                    ids.slice(start, len(part)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
                ]
                names = ["doc_id", "n_shingles", "set_key", "sketch"]
                yield pa.RecordBatch.from_arrays([*columns, part] if with_text else columns, names=[*names, "text"] if with_text else names)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketch_table(docs: DataFrame, k: int = 64, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key (null without words) and the bottom-k sketch of each text."""
    return _texts(docs).mapInArrow(_sketches(k, width), SKETCH)


def least_overlap(n: Column, k: int, percent: int) -> Column:
    """Retained values that two similar sets share at least, given one set's size.

    Exact while both sketches hold whole sets. Beyond that the union sketch draws k of at most
    n / t hashes without replacement; six standard deviations below its mean are allowed for.
    """
    t = percent / 100
    spread = F.sqrt(F.greatest(F.lit(0.0), k * t * (1 - t) * (1 - k * t / n)))
    drawn = F.greatest(F.lit(1.0), F.floor(k * t - 6 * spread))
    whole = F.ceil(n * percent / 100)
    return F.when(n < math.floor(k * t), whole).otherwise(F.least(whole, drawn)).cast("int")


def _jaccard(width: int):
    def run(batches):
        kept_id, kept = None, None
        for batch in batches:
            left, right = batch.column("text_a"), batch.column("text_b")
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            shared, n_a, n_b = [], [], []
            for start, part in text_slices(left):
                for i, own in enumerate(shingle_sets(part, width), start):
                    if b[i] != kept_id or right[i].as_py() != kept[1]:
                        kept_id, kept = b[i], (shingle_sets(right.slice(i, 1), width)[0], right[i].as_py())
                    other = kept[0]
                    both = len(own) + len(other) - len(np.union1d(own, other))
                    shared.append(both)
                    n_a.append(len(own))
                    n_b.append(len(other))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(shared, pa.int64()), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64())],
                names=["a", "b", "shared", "n_a", "n_b"],
            )

    return run


def verify_pairs(pairs: DataFrame, sets: DataFrame, width: int = 5) -> DataFrame:
    """(a, b, shared, n_a, n_b): sizes of both full sets and of their intersection, for every pair.

    ``sets`` has rep and text; each set is read again from its text.
    """
    texts = sets.select("rep", "text")
    return (
        pairs.select("a", "b")
        .join(texts.toDF("a", "text_a"), "a")
        .join(texts.toDF("b", "text_b"), "b")
        .mapInArrow(_jaccard(width), "a long, b long, shared long, n_a long, n_b long")
    )


def _estimated(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch does not rule out the threshold."""
    slack = 6 * math.sqrt(percent / 100 * (1 - percent / 100) / k)
    a = sets.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n").alias("n_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n").alias("n_b"))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .where(F.col("n_a") * 100 >= F.col("n_b") * percent)
        .where(F.col("n_b") * 100 >= F.col("n_a") * percent)
        .where(both >= (F.lit(percent / 100 - slack)) * F.size(union))
        .select("a", "b")
    )


def _rare_lists(sets: DataFrame, need: Column) -> DataFrame:
    """Inverted lists (v, rep, n, share, weight, after) of each set's rarest values.

    Two sets that share ``need`` values share one of either's rarest ``c - need + 1``, where c counts
    those that some other set has too. A set with fewer than ``need`` of them is in no list. ``after`` is
    the number of values from this one on, which bounds what is shared if none before it is.
    """
    values = sets.select("rep", F.explode("values").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    held = F.array_sort(F.collect_list(F.struct("df", "v"))).alias("held")
    return (
        values.join(common, "v")
        .groupBy("rep")
        .agg(held, F.sum("df").alias("weight"))
        .join(sets.select("rep", "n", F.size("values").alias("size")), "rep")
        .where(F.size("held") >= need)
        .select("rep", "n", (F.size("held") / F.col("size")).alias("share"), "weight", F.size("held").alias("c"), F.posexplode(F.slice("held", 1, F.size("held") - need + 1)).alias("pos", "x"))
        .select(F.col("x.v").alias("v"), "rep", "n", "share", "weight", (F.col("c") - F.col("pos")).alias("after"))
    )


def _mixed(lists: DataFrame) -> DataFrame:
    """Values whose list holds sets of more than one component."""
    return lists.groupBy("v").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("v")


def _full_sets(sets: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """rep, n, values: the full shingle sets of the wanted texts, read again."""

    def run(batches):
        for batch in batches:
            for start, part in text_slices(batch.column("text")):
                full = shingle_sets(part, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").slice(start, len(part)), pa.array([len(s) for s in full], pa.int64()), pa.array(full, pa.list_(pa.int64()))],
                    names=["rep", "n", "values"],
                )

    return sets.select("rep", "text").join(wanted.select("rep"), "rep", "left_semi").mapInArrow(run, "rep long, n long, values array<long>")


def _cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of one list but two components, with sizes that allow the threshold.

    ``reach`` is the largest set that can still be similar to a member if no value before this one is shared: what two
    similar sets share is percent / (100 + percent) of both sizes. The smaller of a pair must reach the larger and so
    more than its own size, so members that do not are only ever the larger one: a list of documents with a common passage but
    nothing else has no smaller one at all. Members are bundled by component and ring of sizes, so that a list within one
    component makes no row; bundles meet by list and ring, which is an ordinary join by key, and only those that can hold a
    similar pair are opened.
    """
    share = percent / (100 + percent)
    ring = lambda n: F.floor(F.log(n) * 16).cast("int")
    lists = lists.withColumn("reach", (F.col("after") - F.col("n") * share + 1e-6) / share).withColumn("ring", ring(F.col("n")))
    lists = lists.withColumn("band", F.floor(F.col("reach") * 8 / F.col("n")).cast("int")).where(F.col("reach") * 100 >= F.col("n") * percent)
    bundle = lists.groupBy("v", "part", "ring", "band").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("reach").alias("reach"))
    small = bundle.where("reach >= lo").toDF("v", "part_y", "ring_y", "band_y", "lo_y", "hi_y", "reach_y")
    large = bundle.toDF("v", "part_x", "ring_x", "band_x", "lo_x", "hi_x", "reach_x")
    large = large.withColumn("ring_y", F.explode(F.sequence(ring(F.col("lo_x") * (percent / 100) - 1e-6), ring(F.least("hi_x", "reach_x") + 1e-6))))
    met = (
        large.join(small, ["v", "ring_y"])
        .where(F.col("part_x") != F.col("part_y"))
        .where((F.col("hi_y") * 100 >= F.col("lo_x") * percent) & (F.col("lo_y") <= F.col("hi_x")))
        .where((F.col("reach_x") >= F.col("lo_y")) & (F.col("reach_y") >= F.col("lo_x")))
        .select("v", "part_x", "ring_x", "band_x", "part_y", "ring_y", "band_y")
    )
    members = lists.select("v", "part", "ring", "band", "rep", "n", "reach")
    of = lambda side: members.toDF("v", *[f"{c}_{side}" for c in ("part", "ring", "band", "rep", "n", "reach")])
    return (
        met.join(of("x"), ["v", "part_x", "ring_x", "band_x"])
        .join(of("y"), ["v", "part_y", "ring_y", "band_y"])
        .where((F.col("n_y") * 100 >= F.col("n_x") * percent) & (F.col("n_y") <= F.col("n_x")))
        .where((F.col("reach_x") >= F.col("n_y")) & (F.col("reach_y") >= F.col("n_x")))
        .select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, k: int | None = 64, percent: int = 75, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    With ``k`` None sketches hold whole sets, so that every candidate rule is exact and no link can be missed.

    Texts are linked when 100 * shared shingles >= ``percent`` * shingles in either. A null or
    wordless text has no shingles and is linked with nothing. A row without doc_id can't be
    named by a link: its component_id is null and it is kept. Repeated rows share their doc_id and
    thus their component. Further columns of ``docs`` are ignored.
    """
    k = WHOLE if k is None else k
    similar = F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent
    table = cut_lineage(sketch_table(docs, k, width))
    named = table.where("doc_id is not null and n_shingles > 0")
    first = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = first.where("copies > 1").select("set_key", "rep")
    # One row a set: the smallest doc_id of each group of equal sets.
    rep_of = cut_lineage(named.select("doc_id", "set_key").join(copies, "set_key", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).distinct())
    others = rep_of.where("doc_id <> rep").select("doc_id").distinct()
    lists = named.join(others, "doc_id", "left_anti").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.col("sketch").alias("values"))
    lists = cut_lineage(_rare_lists(lists, least_overlap(F.col("n"), k, percent)).distinct())
    # From here on only sets in some list of two or more matter; their texts move once.
    met = lists.groupBy("v").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("v")
    active = lists.join(met, "v", "left_semi").select("rep").distinct()
    sets = _texts(docs).where("text is not null").join(active.toDF("doc_id"), "doc_id", "left_semi").mapInArrow(_sketches(k, width, True), f"{SKETCH}, text string")
    sets = cut_lineage(sets.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch", "text"))
    # First reading: each set against the most central member of the list that it meets most often.
    central = F.max_by("rep", F.struct("share", "weight", -F.col("rep"))).alias("hub")
    hubs = lists.groupBy("v").agg(central, F.count("*").alias("members")).where("members > 1")
    toward = (
        lists.join(hubs, "v")
        .where("rep <> hub")
        .groupBy("rep", "hub")
        .agg(F.count("*").alias("times"))
        .groupBy("rep")
        .agg(F.max_by("hub", F.struct("times", -F.col("hub"))).alias("hub"))
        .select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    )
    linked = verify_pairs(_estimated(toward, sets, k, percent), sets, width)
    links = cut_lineage(linked.where(similar).select("a", "b"))
    parts = connected_components(links).select(F.col("node").alias("rep"), "component")
    # Second reading: sets that share a list with another component, now by their full sets.
    placed = lists.join(parts, "rep", "left").select("v", "rep", "n", F.coalesce("component", "rep").alias("part"))
    crowded = cut_lineage(placed.join(_mixed(placed), "v").select("rep", "part").distinct())
    full = cut_lineage(_rare_lists(_full_sets(sets, crowded, width), F.ceil(F.col("n") * percent / 100).cast("int")).join(crowded, "rep").select("v", "rep", "n", "part", "after"))
    pairs = _cross_pairs(full.join(_mixed(full), "v"), percent)
    late = verify_pairs(_estimated(pairs, sets, k, percent), sets, width)
    roots = connected_components(links.unionByName(late.where(similar).select("a", "b")))
    component = rep_of.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return (
        table.select("doc_id", "n_shingles")
        .join(component, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
