"""Exact nearest vectors: against the SQL, in blocks of any size, with ties, near ties and odd vectors."""

import random

import duckdb
import numpy as np

from wardlight.plans import analytics, nearest

SCHEMA = "vec_id long, embedding array<float>"
SQL = """select query_id, vec_id, place from (select a.vec_id as query_id, b.vec_id, row_number() over (partition by a.vec_id
    order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) desc, b.vec_id) as place
    from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0) where place <= 5"""


def by_sql(table):
    con = duckdb.connect()
    con.register("given", table)
    con.sql("create view embeddings as select * from given")
    return sorted(con.sql(SQL).fetchall())


def found(vectors, **kw):
    return sorted(map(tuple, analytics.cosine_topk(vectors, vectors.where("vec_id % 50 = 0"), 5, **kw).select("query_id", "vec_id", "place").collect()))


def test_same_as_sql_with_ties_zeros_and_nan(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 600)]  # exact copies
    rows += [(i, [1.0 + i * 1e-6, 2.0, 1e-4, 0.0, 0.0, 0.0]) for i in range(600, 900)]  # near copies
    for odd in ([], [(905, [0.0] * 6), (950, [0.0] * 6)], [(906, [float("nan")] * 6), (1000, [float("inf")] + [1.0] * 5)]):
        vectors = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
        want = by_sql(vectors.toArrow())
        assert found(vectors) == want
        assert found(vectors, most_bytes=2000) == want


def test_nulls_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0]), (2, None), (3, [None, 1.0]), (4, []), (None, [1.0, 0.0]), (50, [2.0]), (5, [0.0, 1.0]), (5, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, SCHEMA)
    assert found(vectors) == [(0, 5, 1), (0, 5, 2), (50, 1, 1)]
    assert found(vectors.limit(0)) == []


def test_pairs_are_no_rows_of_a_join(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5)]) for i in range(100)], SCHEMA)
    plan = analytics.cosine_topk(vectors, vectors.where("vec_id % 50 = 0"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_similarities_that_lie_between_two_digits():
    """A product in another order may round otherwise; the sum is then made component by component."""
    r = np.random.default_rng(5)
    queries = r.normal(size=(3, 16))
    queries /= np.linalg.norm(queries, axis=1)[:, None]
    aside = np.linalg.qr(np.concatenate((queries, r.normal(size=(3, 16)))).T)[0].T[3:4]
    half = 0.1234565 + np.arange(-20, 20) * 2e-17
    rows = half[:, None] * queries[:1] + np.sqrt(1 - half**2)[:, None] * aside
    search = nearest.Nearest(rows, np.arange(len(rows)), queries, np.arange(100, 103), len(rows))
    search.visit()
    q, at, got = search.found()
    lengths = [nearest.norms(rows), nearest.norms(queries)]
    for i, place, value in zip(q, at, got, strict=True):
        total = 0.0
        for x, y in zip(queries[i].tolist(), rows[place].tolist(), strict=True):
            total += x * y
        assert value == float(decimal_round(total / (lengths[1][i] * lengths[0][place])))


def decimal_round(x):
    from decimal import ROUND_HALF_UP, Decimal

    return Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP) + 0
