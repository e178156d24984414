"""Importance resampling against a plain version."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from wardlight.llm.resampling import Tournament, draw, feature_buckets, resample

from .conftest import ODD, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


def plain(rows, target, percent):
    place = lambda x: zlib.crc32(x.encode()) % 10000
    s = collections.Counter(place(f) for _, text in rows for f in runs(text)[1])
    t = collections.Counter(place(f) for text in target for f in runs(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in rows:
        n_words, own = runs(text)
        weight = sum(gain[place(f)] for f in own) // len(own) if own else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None, n_words])
    able = sorted((r for r in out if r[0] is not None and r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_runs_of_words_are_hashed_in_blocks():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["a", "Z", "é", "日", " ", "\n", "-", "9", "_", "x" * 70, "\x7f", "\x00", "😀"]) for _ in range(r.randrange(40)))
        n, own = runs(text)
        for block in (1, 5, 1 << 20):
            got = list(feature_buckets(text.encode(), 10000, block))
            assert sum(k for _, k in got) == n
            assert sorted(int(b) for x, _ in got for b in x) == sorted(zlib.crc32(f.encode()) % 10000 for f in own)


def test_tournament_stops_at_the_count():
    r = random.Random(2)
    for _ in range(300):
        own = [sorted((r.randrange(9), r.randrange(9)) for _ in range(r.randrange(9))) for _ in range(r.randrange(8))]
        most = r.randrange(60)
        assert [own[a][b] for a, b in Tournament(own).take(most)] == sorted(sum(own, []))[:most]


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 20), (7, 5)])
def test_resampling(make_docs, spark, sizes):
    rows = [*ODD, *((100 + i, prose(i, 5 + i % 60)) for i in range(150)), (900, "x " * 3_000_000), (901, "y" * 3_000_000)]
    target = [prose(i, 40) for i in range(20)] + [None, ""]
    table = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    got = resample(make_docs(rows), table, percent=40, merge_rows=sizes[0], run_rows=sizes[1])
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain([r[:2] for r in rows], target, 40)


def test_empty_tables(make_docs, spark):
    none = spark.createDataFrame([], "text string")
    assert resample(make_docs([]), none).collect() == []
    rows = [(i, prose(i, 30)) for i in range(20)]
    assert sorted(map(tuple, resample(make_docs(rows), none).collect()), key=str) == plain(rows, [], 25)
    short = [(1, "a b"), (2, None)]
    assert sorted(map(tuple, resample(make_docs(short), none).collect()), key=str) == plain(short, [], 25)


def test_a_score_of_more_rows_than_a_merge_takes_is_cut_by_id(spark):
    scored = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 7).cast("long").alias("score"), F.lit(True).alias("eligible"))
    got = {r["doc_id"]: r["rank"] for r in draw(scored.repartition(5), 900, merge_rows=50, run_rows=64).collect()}
    order = sorted(range(2000), key=lambda i: (-(5 if i % 3 == 0 else i % 7), i))
    assert got == {i: k + 1 if k < 900 else None for k, i in enumerate(order)}
