"""The vector store's versions, and the index against the exact way."""

import random

import pytest
from pyspark.sql import functions as F

from wardlight.plans import analytics, vector_index as vi

SCHEMA = "vec_id long, embedding array<float>"


def cloud(seed, n, width=8, centres=6):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, [x + r.gauss(0, 0.4) for x in r.choice(middle)]) for i in range(n)]


def ids(df):
    return {r["vec_id"]: [round(x, 4) for x in r["embedding"]] for r in df.collect()}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    assert vi.latest(spark, root) == -1 and vi.vectors_at(spark, root, SCHEMA).collect() == []
    one = spark.createDataFrame([(i, [float(i)]) for i in range(50)] + [(None, [1.0])], SCHEMA)
    assert vi.upsert(one, root, buckets=8) == 0
    two = spark.createDataFrame([(3, [33.0]), (3, [32.0]), (99, [99.0])], SCHEMA)
    assert vi.upsert(two, root) == 1
    want = {i: [float(i)] for i in range(50)}
    assert ids(vi.vectors_at(spark, root, SCHEMA, 0)) == want
    assert ids(vi.vectors_at(spark, root, SCHEMA)) == want | {3: [33.0], 99: [99.0]}
    with pytest.raises(vi.Conflict):
        vi.upsert(spark.createDataFrame([(4, [0.0])], SCHEMA), root, base=0)
    assert vi.latest(spark, root) == 1 and ids(vi.vectors_at(spark, root, SCHEMA)) == want | {3: [33.0], 99: [99.0]}
    folders = {p.name for p in (tmp_path / "store" / "data").iterdir()}
    assert len(folders) == 2


def test_all_cells_are_the_exact_way_and_few_come_close(spark):
    rows = cloud(1, 900) + [(1000 + i, [1.0] * 8) for i in range(150)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    queries = vectors.where("vec_id % 50 = 0")
    index = vi.build(vectors, vi.fit_centroids(vectors, 24, sample_rows=500), slot_rows=40)
    assert index.slots.max() > 1 and index.rows.groupBy("cell", "slot").count().agg(F.max("count")).first()[0] < 120
    exact = analytics.cosine_topk(vectors, queries, 5)
    key = lambda df: sorted((r["query_id"], r["place"], r["vec_id"]) for r in df.collect())
    assert key(vi.search(index, queries, 5, 24)) == key(exact)
    probes = vi.tuned(index, vectors, queries, 5)
    assert probes < 24
    assert vi.recall(vi.search(index, queries, 5, probes), exact) >= 0.9


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (None, [1.0, 0.0]), (6, [None, 1.0]), (2, [0.8, 0.2])]
    vectors = spark.createDataFrame(rows, SCHEMA)
    index = vi.build(vectors, vi.fit_centroids(vectors, 2))
    got = vi.search(index, vectors.where("vec_id = 1"), 2, 2).orderBy("place").collect()
    assert [(r["vec_id"], r["place"]) for r in got] == [(2, 1), (2, 2)]
    none = vectors.limit(0)
    empty = vi.build(none, vi.fit_centroids(none, 4))
    assert vi.search(empty, vectors, 3, 2).collect() == [] and vi.tuned(empty, none, none, 3) == 1


def test_queries_go_to_a_shelf_once_and_tuning_needs_no_search(spark, monkeypatch):
    vectors = spark.createDataFrame(cloud(2, 1500), SCHEMA)
    queries = vectors.where("vec_id % 50 = 0")
    index = vi.build(vectors, vi.fit_centroids(vectors, 40), slot_rows=500)
    assert len(set(index.shelves)) <= 4 and index.rows.groupBy("shelf").count().agg(F.max("count")).first()[0] < 1200
    exact = analytics.cosine_topk(vectors, queries, 5)
    shares = [vi.recall(vi.search(index, queries, 5, p, query_rows=9), exact) for p in (1, 3, 9)]
    with monkeypatch.context() as m:
        m.setattr(vi, "search", None)
        needed = {share: vi.tuned(index, vectors, queries, 5, target=share) for share in shares}
    assert shares == sorted(shares)
    for share, probes in zip(shares, (1, 3, 9), strict=True):
        assert needed[share] <= probes and vi.recall(vi.search(index, queries, 5, needed[share]), exact) >= share
