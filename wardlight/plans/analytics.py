"""Analytics over observations, timelines, chunks and vectors.

The platform that this library follows specifies these and does not implement them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..schema import LAB_RESULT
from .nearest import Nearest, matrix, numbered


def timeline(*sources: tuple[str, DataFrame, str, str, str]) -> DataFrame:
    """(patient_id, kind, item_id, at): rows of several tables, each given as (kind, table, patient, id, time)."""
    out = None
    for kind, table, patient, key, at in sources:
        part = table.select(F.col(patient).alias("patient_id"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("item_id"), F.col(at).alias("at"))
        out = part if out is None else out.unionByName(part)
    return out


def ordered_timeline(*sources: tuple[str, DataFrame, str, str, str]) -> DataFrame:
    """``timeline`` with ``place``: a row's number among its patient's, newest first; of the same time by kind and item, and what has no time last.

    A row without a patient is on no timeline.
    """
    own = Window.partitionBy("patient_id").orderBy(F.desc_nulls_last("at"), "kind", "item_id")
    return timeline(*sources).where("patient_id is not null").withColumn("place", F.row_number().over(own))


def trend(observations: DataFrame, *order: str) -> DataFrame:
    """Observations with the value before and the first value of the same patient and code, and the differences to them."""
    series = Window.partitionBy("patient_id", "code").orderBy(*order)
    out = observations.withColumns({"previous": F.lag("value").over(series), "first_value": F.first("value").over(series)})
    return out.withColumns({"change": F.col("value") - F.col("previous"), "total_change": F.col("value") - F.col("first_value")})


def range_flag(value: Column, low: Column, high: Column) -> Column:
    """'low', 'high', 'normal', or null without a value; a missing limit is no limit."""
    return F.when(value.isNull(), None).when(value < low, "low").when(value > high, "high").otherwise("normal")


def exploded_results(extractions: DataFrame, key: str = "id", data: str = "data") -> DataFrame:
    """A row for each laboratory result in the JSON of an extraction, with its range flag."""
    results = F.explode(F.from_json(data, LAB_RESULT)["results"]).alias("r")
    flag = range_flag(F.col("value"), F.col("reference_min"), F.col("reference_max"))
    return extractions.select(key, results).select(key, "r.*").withColumn("flag", flag)


def chunks(docs: DataFrame, key: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """(key, chunk_no, start, chunk): pieces of ``size`` characters of which ``overlap`` are the last piece's; no piece of an empty text."""
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return docs.select(key, text, F.posexplode(starts).alias("chunk_no", "start")).select(key, "chunk_no", "start", F.substring(text, F.col("start"), F.lit(size)).alias("chunk"))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", value: str = "embedding", most_bytes: int = 8 << 20) -> DataFrame:
    """(query_id, vec_id, similarity, place): the k most similar vectors to each of a stated set of queries, exactly.

    Vectors and queries are dealt into blocks of about ``most_bytes`` by a hash of their key, and every block of the ones meets every block of the others in a
    task of its own, which keeps k rows a query. The work is that of all pairs, as matrix products. Of equal similarity the smaller key comes first.
    A vector that is null, empty or has a null component is similar to nothing, and vectors of different lengths aren't to each other. A zero vector or one with
    a component that isn't finite has similarity NaN to all others, which comes first, as in SQL.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        v = F.col(value) if dict(rows.dtypes)[value] == "array<float>" else F.col(value).cast("array<double>")
        known = F.col(key).isNotNull() & (F.size(value) > 0) & ~F.exists(value, F.isnull)
        return rows.where(F.col(value).isNotNull() & known).select(F.col(key).alias(name), v.alias(f"_{name}"), F.size(value).alias("_width"))

    b, a = side(vectors, key), side(queries, "query_id")
    n_b, n_a = (max(1, -(-(x.agg(F.sum(F.col("_width") * F.lit(8).cast("long"))).first()[0] or 0) // most_bytes)) for x in (b, a))
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    b = b.withColumn("_b", block(key, n_b)).withColumn("_a", every(n_a))
    a = a.withColumn("_a", block("query_id", n_a)).withColumn("_b", every(n_b))
    types = [to_arrow_type(x.schema[c].dataType) for x, c in ((a, "query_id"), (b, key))]

    def score(left, right):
        if not len(left) or not len(right):
            return pa.table([pa.array([], t) for t in (*types, pa.float64())], names=["query_id", key, "similarity"])
        left = left.sort_by(key)
        width = left.column("_width")[0].as_py()
        own, asking = numbered(left.column(key).to_numpy(), right.column("query_id").to_numpy())
        search = Nearest(matrix(left.column(f"_{key}"), width), own, matrix(right.column("_query_id"), width), asking, k)
        search.visit()
        q, r, similarity = search.found()
        return pa.table([right.column("query_id").take(pa.array(q)), left.column(key).take(pa.array(r)), pa.array(similarity)], names=["query_id", key, "similarity"])

    by = ("_width", "_a", "_b")
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((a, "query_id"), (b, key))]
    best = b.groupBy(*by).cogroup(a.groupBy(*by)).applyInArrow(score, f"query_id {kinds[0]}, `{key}` {kinds[1]}, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), key))
    return best.withColumn("place", place).where(F.col("place") <= k)


def needs_review(extractions: DataFrame, threshold: float) -> DataFrame:
    """Extractions with ``review``: required below the threshold or without confidence, else not."""
    low = F.coalesce(F.col("confidence") < threshold, F.lit(True))
    return extractions.withColumn("review", F.when(low, "review_required").otherwise("accepted"))


def queue_depth(events: DataFrame, arrives: Column, leaves: Column, order: list[str], group: str) -> DataFrame:
    """Events with the number of items still queued after each, counted within ``group``."""
    step = F.when(arrives, 1).when(leaves, -1).otherwise(0)
    return events.withColumn("depth", F.sum(step).over(Window.partitionBy(group).orderBy(*order)))


def pipeline_metrics(events: DataFrame) -> DataFrame:
    """Counts by event type."""
    return events.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("n_documents"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def estimated_work(queued: DataFrame, finished: DataFrame, pool: str, seconds: str) -> DataFrame:
    """(pool, queued, mean_seconds, work_seconds): queued items times the mean time that finished ones took, rounded to 6 digits.

    A pool in which nothing finished has no estimate.
    """
    waiting = queued.groupBy(pool).agg(F.count("*").alias("queued"))
    mean = finished.groupBy(pool).agg(F.round(F.avg(seconds), 6).alias("mean_seconds"))
    return waiting.join(mean, pool, "left").withColumn("work_seconds", F.round(F.col("queued") * F.col("mean_seconds"), 3))


def times_taken(events: DataFrame, arrives: Column, leaves: Column, at: str, key: str) -> DataFrame:
    """(key, came, s): seconds from each key's first arrival to its first leaving after it."""
    came = events.where(arrives).groupBy(key).agg(F.min(at).alias("came"))
    went = events.where(leaves).select(key, F.col(at).alias("_went"))
    took = came.join(went, key).where("_went >= came").groupBy(key, "came").agg(F.min("_went").alias("_went"))
    return took.select(key, "came", ((F.unix_micros(F.col("_went").cast("timestamp")) - F.unix_micros(F.col("came").cast("timestamp"))) / 1e6).alias("s"))


def latencies(events: DataFrame, arrives: Column, leaves: Column, at: str, key: str) -> DataFrame:
    """(n, mean_seconds, p50_seconds, p95_seconds) from each key's first arrival to its first leaving after it.

    Exact, and so for as many keys as one task can sort; beyond that see ``sketched``.
    """
    seconds = times_taken(events, arrives, leaves, at, key).select("s")
    return seconds.agg(F.count("*").alias("n"), F.round(F.avg("s"), 3).alias("mean_seconds"), *[F.round(F.percentile("s", q), 3).alias(f"p{round(q * 100)}_seconds") for q in (0.5, 0.95)])


#: Size of a quantile sketch; a quantile's rank is wrong by about 1.33 % of all rows at most, in 99 % of the cases.
SKETCH_K = 200


def sketched(rows: DataFrame, value: str, *by: str | Column, k: int = SKETCH_K) -> DataFrame:
    """(by.., n, total, sketch): a quantile sketch of some kilobytes for each group, to be kept and merged. Nulls are left out."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, quantiles: dict[str, float], *by: str) -> DataFrame:
    """(by.., n, mean, and a column for each quantile) of groups of ``sketched`` taken together."""
    one = sketches.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.kll_merge_agg_double("sketch").alias("_s"))
    return one.select(*by, "n", "mean", *[F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(c) for c, q in quantiles.items()])
