"""A store of vectors with whole-version upserts, and an inverted-file index for nearest neighbours by cosine.

The store keeps vectors in buckets by a hash of their id. A change rewrites the buckets that it touches into a new folder and lists all buckets' folders in the next
manifest, which is created only if nobody else has: of two changes of one version the later one is refused and leaves nothing.

The index puts every vector into the cell of its nearest centroid; centroids are fitted on a bounded sample (``sample_rows``). A query looks into the
cells of its nearest centroids and scores what is there exactly. Neighbouring numbers of cells stand on one shelf, and a query goes to a shelf once, however many of its cells
are there: where vectors are spread evenly, most cells have to be looked into. How many that takes is tuned on a bounded set of queries: by how near the cells of their
exact neighbours are, which needs no search. ``analytics.cosine_topk`` stays the exact way.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_path
from ..sources.ledger import _Files
from .analytics import cosine_topk
from .nearest import Nearest, matrix, numbered

# ------------------------------------------------------------------ the store


class Conflict(RuntimeError):
    """Another change has made the version."""


def _manifest(files: _Files, version: int) -> dict:
    text = files.jvm.org.apache.commons.io.IOUtils.toString(files.fs.open(files.path("manifest", f"{version:010d}.json")), "UTF-8")
    return json.loads(text)


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last version; -1 of a store that has none."""
    files = _Files(spark, root)
    place = files.path("manifest")
    return max((int(x.getPath().getName()[:10]) for x in files.fs.listStatus(place)), default=-1) if files.fs.exists(place) else -1


def vectors_at(spark: SparkSession, root: str, schema: str, version: int | None = None) -> DataFrame:
    """All vectors of a version, the last one by default."""
    number = latest(spark, root) if version is None else version
    folders = _manifest(_Files(spark, root), number)["buckets"].values() if number >= 0 else ()
    paths = [f"{root.rstrip('/')}/data/{f}" for f in folders]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(changes: DataFrame, root: str, key: str = "vec_id", buckets: int = 64, base: int | None = None) -> int:
    """The number of a new version, in which the rows of ``changes`` replace those of their key or are added.

    ``base`` is the version that the changes were made from, the last one by default; ``Conflict`` if another one follows it already. A key that comes twice
    is an error of the caller's and keeps one of its rows, the largest. Rows without key are left out. ``buckets`` counts for a new store only.
    """
    spark, schema = changes.sparkSession, changes.schema
    files, base = _Files(spark, root), latest(spark, root) if base is None else base
    before = _manifest(files, base) if base >= 0 else {"buckets": {}, "n": buckets}
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(before["n"])).cast("int")
    new = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*changes.columns)).alias("r")).select("r.*")
    touched = sorted(r[0] for r in new.select(place).distinct().collect())  # at most as many as buckets
    there = [f"{files.root}/data/{before['buckets'][str(b)]}" for b in touched if str(b) in before["buckets"]]
    old = spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)
    folder = uuid.uuid4().hex
    merged = old.join(new.select(key), key, "left_anti").select(*changes.columns).unionByName(new)
    merged.withColumn("_bucket", place).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{files.root}/data/{folder}")
    after = {"n": before["n"], "buckets": before["buckets"] | {str(b): f"{folder}/_bucket={b}" for b in touched}}
    if not files.create(json.dumps(after), "manifest", f"{base + 1:010d}.json"):
        files.fs.delete(files.path("data", folder), True)
        raise Conflict(f"version {base + 1} is there already")
    return base + 1


# ------------------------------------------------------------------ the index


@dataclass(frozen=True)
class Index:
    """Vectors by cell, slot and shelf, the centroids, the number of slots of each cell, and the shelf of each slot, in the order of cells and slots."""

    rows: DataFrame
    centroids: np.ndarray
    slots: np.ndarray
    shelves: np.ndarray
    key: str


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors; a vector of another length or of length 0 becomes all zeros."""
    out = matrix(column, width)
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _pieces(batches, rows: int = 1024):
    """Batches of at most ``rows``, so that a matrix of rows and centroids stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _known(vectors: DataFrame, key: str, value: str) -> DataFrame:
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x))
    return vectors.where(F.col(key).isNotNull() & F.col(value).isNotNull() & ~bad).select(F.col(key).cast("long").alias(key), F.col(value).cast("array<double>").alias("v"))


def fit_centroids(vectors: DataFrame, cells: int, key: str = "vec_id", value: str = "embedding", sample_rows: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on at most ``sample_rows`` vectors, the first by a hash of their key."""
    sample = _known(vectors, key, value).orderBy(F.xxhash64(key), key).limit(sample_rows).toArrow()
    column = sample.column("v")
    width = int(np.max(column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False), initial=1)) if len(column) else 1
    points = _matrix(column, width)
    points = points[(points != 0).any(axis=1)]
    if not len(points):
        return np.zeros((1, width))
    centres = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        norm = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def build(vectors: DataFrame, centroids: np.ndarray, key: str = "vec_id", value: str = "embedding", slot_rows: int = 8192) -> Index:
    """All vectors in their cells. A cell of more than ``slot_rows`` has several slots, so that no task holds more, however many vectors are alike."""
    spark, width = vectors.sparkSession, centroids.shape[1]

    def run(batches):
        for b in _pieces(batches):
            cell = (_matrix(b.column("v"), width) @ centroids.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("v"), pa.array(cell.astype(np.int32))], names=[key, "v", "cell"])

    path = shared_path(spark, "cells")
    _known(vectors, key, value).mapInArrow(run, f"{key} long, v array<double>, cell int").write.parquet(path)
    placed = spark.read.parquet(path)
    held = np.zeros(len(centroids), dtype=np.int64)
    for r in placed.groupBy("cell").count().collect():  # a row for each centroid
        held[r["cell"]] = r["count"]
    slots = np.maximum(1, -(-held // slot_rows))
    full = np.cumsum(np.repeat(held / slots, slots))
    shelves = np.maximum(np.ceil(full / slot_rows).astype(np.int64) - 1, 0)
    of = lambda numbers: F.array(*(F.lit(int(n)) for n in numbers))
    slot = F.pmod(F.xxhash64(key), F.element_at(of(slots), F.col("cell") + 1)).cast("int")
    shelf = F.element_at(of(shelves), F.element_at(of(np.cumsum(slots) - slots), F.col("cell") + 1) + F.col("slot") + 1).cast("int")
    return Index(placed.withColumn("slot", slot).withColumn("shelf", shelf), centroids, slots, shelves, key)


def _order(asked: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cells of each query (unit vectors), the nearest first."""
    return np.argsort(-(asked @ centroids.T), axis=1, kind="stable")


def search(index: Index, queries: DataFrame, k: int, probes: int, key: str = "vec_id", value: str = "embedding", query_rows: int = 16384) -> DataFrame:
    """(query_id, key, similarity, place): the ``k`` most similar vectors that the ``probes`` nearest cells of each query hold, without itself.

    Queries go to the shelves in blocks of about ``query_rows``, by a hash of their key.
    """
    centroids, slots, shelves, width, own = index.centroids, index.slots, index.shelves, index.centroids.shape[1], index.key
    probes = min(probes, len(centroids))
    cell_of = np.repeat(np.arange(len(centroids)), slots)
    # The cells of each shelf follow each other; a cell of several slots may stand on several shelves.
    spans = [(int(s), int(c.min()), int(c.max()) + 1) for s in np.unique(shelves) for c in (cell_of[shelves == s],)]

    def nearest(batches):
        for b in _pieces(batches):
            wanted = np.zeros((b.num_rows, len(centroids)), dtype=bool)
            np.put_along_axis(wanted, _order(_matrix(b.column("v"), width), centroids)[:, :probes], True, axis=1)
            for shelf, first, stop in spans:
                at = np.flatnonzero(wanted[:, first:stop].any(axis=1))
                if len(at):
                    q, c = np.nonzero(wanted[at, first:stop])
                    cells = pa.ListArray.from_arrays(pa.array(np.searchsorted(q, np.arange(len(at) + 1)), pa.int32()), pa.array(c + first, pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column("v").take(pa.array(at)), cells, pa.array(np.full(len(at), shelf, dtype=np.int32))], names=["query_id", "q", "cells", "shelf"])

    asked = _known(queries, key, value).mapInArrow(nearest, "query_id long, q array<double>, cells array<int>, shelf int")
    blocks = max(1, -(-queries.count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    rows = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def score(left, right):
        names = ["query_id", own, "similarity"]
        if not len(left) or not len(right):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        left = left.sort_by(own)
        cell, held = left.column("cell").to_numpy(), matrix(left.column("v"), width)
        by = np.argsort(cell, kind="stable")
        there = np.split(by, np.flatnonzero(np.diff(cell[by])) + 1)
        numbers, asking = numbered(left.column(own).to_numpy(), right.column("query_id").to_numpy())
        found = Nearest(held, numbers, matrix(right.column("q"), width), asking, k, odd=False)
        lists = right.column("cells").combine_chunks()
        asks, wanted = np.repeat(np.arange(len(right)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
        order = np.argsort(wanted, kind="stable")
        asks, wanted = asks[order], wanted[order]
        for places in there:
            lo, hi = np.searchsorted(wanted, [cell[places[0]], cell[places[0]] + 1])
            found.visit(asks[lo:hi], places)
        q, r, similarity = found.found()
        return pa.table([right.column("query_id").take(pa.array(q)), left.column(own).take(pa.array(r)), pa.array(similarity)], names=names)

    found = rows.groupBy("shelf", "block").cogroup(asked.groupBy("shelf", "block")).applyInArrow(score, f"query_id long, {own} long, similarity double")
    first = Window.partitionBy("query_id").orderBy(F.desc("similarity"), own)
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> float:
    """The share of the exact neighbours that were found."""
    both = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]


def tuned(index: Index, vectors: DataFrame, queries: DataFrame, k: int, target: float = 0.95, most_queries: int = 200, key: str = "vec_id", value: str = "embedding") -> int:
    """The fewest probes that find ``target`` of the exact neighbours of at most ``most_queries`` queries, the first by a hash.

    A neighbour is found if its cell is, since cells are scored exactly. So the place of its cell among those of its query tells how many probes that takes.
    """
    some = queries.orderBy(F.xxhash64(key), key).limit(most_queries)
    path = shared_path(vectors.sparkSession, "exact")
    cosine_topk(vectors, some, k, key, value).write.parquet(path)
    exact = vectors.sparkSession.read.parquet(path)
    cells = exact.join(index.rows.select(F.col(index.key).alias(key), "cell"), key).select("query_id", "cell").join(_known(some, key, value).withColumnRenamed(key, "query_id"), "query_id").toArrow()
    if not len(cells):  # at most k rows a query
        return 1
    order = _order(_matrix(cells.column("v"), index.centroids.shape[1]), index.centroids)
    needed = np.sort((order == cells.column("cell").to_numpy()[:, None]).argmax(axis=1)) + 1
    return int(needed[max(0, int(np.ceil(target * len(needed))) - 1)])
