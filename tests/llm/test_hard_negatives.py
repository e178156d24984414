"""Hard negatives and their trees against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import hard_negatives as hn
from wardlight.llm.hard_negatives import Search, Tree, hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, rank string, q int"


def plain(rows, every=50, n_positive=5, n_negative=3):
    known = {}
    for vec_id, label, x in rows:
        if None in (vec_id, label, x) or any(c is None or not math.isfinite(c) for c in x):
            continue
        known[vec_id, label, tuple(math.floor(256 * float(np.float32(c))) for c in x)] = None
    out = set()
    for a, label, x in known:
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=False)), b, other) for b, other, y in known]
        best = sorted((s, b) for s, b, other in scored if other == label and b != a)[:n_positive]
        for ps, p in best:
            negatives = sorted((s, b) for s, b, other in scored if other != label and 50 * -ps <= 100 * -s <= 95 * -ps)[:n_negative]
            out |= {(a, p, k + 1, b, -ps, -s) for k, (s, b) in enumerate(negatives)}
    return sorted(out)


def run(spark, rows, **how):
    table = spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives(table, F.col("vec_id") % 50 == 0, **how).collect()))


def clouds(seed, n, width, labels=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(width)] for _ in range(labels)]
    return [(i, k := r.randrange(labels), [c + r.gauss(0, 0.2) for c in centres[k]]) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"tree_rows": 100, "query_rows": 3}])
def test_hard_negatives(spark, how):
    rows = clouds(1, 700, 12)
    assert run(spark, rows, **how) == plain(rows)


def test_odd_rows(spark):
    r = random.Random(3)
    rows = clouds(2, 120, 4, 2)
    rows += [(200 + i, r.randrange(2), [0.5, 0.25, 0.0, 0.0]) for i in range(300)]  # one vector of most rows
    rows += rows[:60]  # repeated rows
    rows += [(None, 1, [0.1] * 4), (650, None, [0.1] * 4), (700, 1, None), (750, 1, [0.1, None]), (800, 1, [float("nan")] * 4), (850, 1, [float("inf")] * 4), (900, 1, []), (950, 0, [0.4]), (1000, 1, [0.1] * 9), (1050, 7, [-0.3] * 4)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []
    assert run(spark, [(50, 1, [0.5])]) == []


def test_large_components_are_scored_in_whole_numbers(spark):
    r = random.Random(4)
    rows = [(i, i % 2, [r.choice([-1, 1]) * 2.0**19 + r.randrange(1 << 10) for _ in range(8)]) for i in range(0, 500, 5)]
    assert run(spark, rows) == plain(rows)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(50, 1, [1e30]), (51, 1, [1.0])])


def test_a_tree_visits_only_leaves_that_meet_the_annulus(monkeypatch):
    r = np.random.default_rng(5)
    vectors = np.concatenate([r.normal(c, 6, (400, 6)) for c in (-200, 0, 200, 400)]).astype(np.int64)
    tree, seen = Tree(vectors, np.arange(len(vectors)), np.arange(len(vectors)) % 5), []
    take = Search._take
    monkeypatch.setattr(Search, "_take", lambda self, t, leaf, rows, queries: (seen.extend([leaf] * len(rows)), take(self, t, leaf, rows, queries)))
    queries = vectors[::40]
    scores = queries @ vectors.T
    high = np.sort(scores, axis=1)[:, -300]
    search = Search(queries, np.zeros(len(queries), dtype=np.int64), high // 2, high, False, 3)
    search.visit(tree)
    for i in range(len(queries)):
        want = sorted((-s, k) for k, s in enumerate(scores[i].tolist()) if k % 5 and high[i] // 2 <= s <= high[i])[:3]
        assert [(-a, b) for a, b in zip(search.best[i].tolist(), search.ids[i].tolist(), strict=True) if b != hn._NO_ID] == want
    assert len(seen) < 0.6 * len(queries) * len(tree.spans)
