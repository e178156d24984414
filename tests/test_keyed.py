"""Streams with keyed state against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardlight.streaming import keyed

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.use_keyed_state(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def feed(spark, rows, schema, path, parts):
    """Rows (with the time second) dealt to files in order of time, but out of order by some minutes; a stream of one file a trigger."""
    r = random.Random(5)
    rows = sorted(rows, key=lambda x: x[1] + dt.timedelta(seconds=r.randrange(240)))
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, tmp_path, sink=None):
    out = str(tmp_path / "out")
    writer = sink(stream, out, str(tmp_path / "cp")) if sink else stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return out


CODES = "identity string, at timestamp, seq long, issued boolean, code string"


def test_codes(rocks, tmp_path):
    rows = [("a", at(0), 1, True, "11"), *(("a", at(i), 1 + i, False, "99") for i in range(1, 7)), ("a", at(8), 20, False, "11")]  # burned at the fifth
    rows += [("b", at(0), 1, True, "22"), ("b", at(300), 2, False, "22"), ("b", at(300.5), 3, False, "22"), ("b", at(301), 4, False, "22")]
    rows += [("c", at(5), 1, False, "1"), ("c", at(6), 2, True, "33"), ("c", at(307), 3, False, "33"), ("c", at(310), 4, True, "34"), ("c", at(311), 5, False, "33"), ("c", at(312), 6, False, None), ("c", at(313), 7, False, "34")]
    rows += [("d", at(0), 1, True, "1"), ("d", at(0), 2, False, "1"), ("d", at(0), 3, True, "2"), ("d", at(0), 4, False, "1"), (None, at(1), 1, False, "1"), ("d", None, 9, False, "2")]
    r = random.Random(1)
    rows += [(f"r{r.randrange(4)}", at(r.randrange(2000)), 100 + i, r.random() < 0.1, str(r.randrange(3))) for i in range(150)]
    want = {(x["identity"], x["seq"]): x["outcome"] for x in keyed.batch_code_attempts(rocks.createDataFrame(rows, CODES)).collect()}
    assert [want["a", s] for s in (2, 6, 7, 20)] == ["wrong", "wrong", "burned", "burned"]
    assert [want["b", s] for s in (2, 3, 4)] == ["accepted", "absent", "absent"]
    assert [want["c", s] for s in (1, 3, 5, 6, 7)] == ["absent", "absent", "wrong", "wrong", "accepted"]
    assert [want["d", s] for s in (2, 4)] == ["accepted", "wrong"]
    stream = feed(rocks, [x for x in rows if x[1]] + [("z", at(9000 + i), i, True, "0") for i in range(2)], CODES, str(tmp_path / "in"), 4)
    got = rocks.read.parquet(run(keyed.stream_code_attempts(stream), tmp_path)).collect()
    assert {(x["identity"], x["seq"]): x["outcome"] for x in got} == want and len(got) == len(want)


RESULTS = "message_id string, at timestamp, seq long, ok boolean"


def test_retries_and_dead_letters(rocks, tmp_path):
    rows = [("four", at(200 * i), i, False) for i in range(4)]
    rows += [("mended", at(0), 1, False), ("mended", at(70), 2, True), ("mended", at(500), 3, False), ("early", at(0), 1, False), ("early", at(59), 2, True), ("hot", at(0), 1, False), ("hot", at(60), 2, False)]
    rows += [("odd", at(0), 1, None), ("odd", None, 2, False), (None, at(0), 1, False)]
    r = random.Random(2)
    rows += [(f"m{r.randrange(4)}", at(r.randrange(3000)), 10 + i, r.random() < 0.2) for i in range(80)]
    key = lambda x: (x["message_id"], x["seq"], x["attempts"], x["at"], x["first_failed_at"])
    batch = keyed.batch_retries(rocks.createDataFrame(rows, RESULTS)).collect()
    dead = [x for x in batch if x["message_id"] == "four" and x["outcome"] == "dead_letter"]
    assert [(x["attempts"], x["seq"], x["at"] - x["first_failed_at"]) for x in dead] == [(4, 3, dt.timedelta(seconds=600))]
    assert [x["seq"] for x in batch if x["message_id"] == "early"] == []
    assert sorted(x["seq"] for x in batch if x["message_id"] == "hot") == [1, 2]
    stream = feed(rocks, [x for x in rows if x[1]] + [("z", at(20000 + i), i, True) for i in range(2)], RESULTS, str(tmp_path / "in"), 4)
    out = run(keyed.stream_retries(stream), tmp_path, keyed.start_retries)
    for outcome, name in (("retry", "retries"), ("dead_letter", "dead_letters")):
        got = rocks.read.parquet(f"{out}/{name}").collect()
        assert sorted(map(key, got)) == sorted(key(x) for x in batch if x["outcome"] == outcome)


def test_empty(spark):
    assert keyed.batch_code_attempts(spark.createDataFrame([], CODES)).collect() == []
    assert keyed.batch_retries(spark.createDataFrame([], RESULTS)).collect() == []
    assert keyed.batch_retries(spark.createDataFrame([("a", T0, 1, False)], RESULTS)).select(F.col("attempts")).collect()[0][0] == 1
