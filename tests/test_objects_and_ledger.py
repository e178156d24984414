"""Objects that are written once, and the append-only table."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from wardlight.sources import ledger, objects
from wardlight.sources.messages import Topic


def put(spark, rows, root, batch=None):
    table = spark.createDataFrame(rows, "storage_key string, content binary, content_type string, metadata map<string,string>")
    return {r["storage_key"]: (r["state"], r["size_bytes"], r["checksum"]) for r in objects.put_objects(table.repartition(4), root, batch).collect()}


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_objects_are_written_once(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [(f"a/{i % 3}/o {i}+é.txt", bytes([i]) * i, "text/plain", {"n": str(i)}) for i in range(40)]
    got = put(spark, rows, root, "one")
    assert got == {k: ("written", len(c), sha(c)) for k, c, *_ in rows}
    assert put(spark, rows, root, "one") == got  # the batch again
    there = {r["storage_key"]: (r["size_bytes"], r["checksum"]) for r in objects.stored(spark, root).collect()}
    assert there == {k: (len(c), sha(c)) for k, c, *_ in rows if c}
    assert Topic(root).read(Topic(root).place("meta", rows[7][0] + ".json"))["metadata"] == {"n": "7"}
    other = put(spark, [(rows[5][0], b"new", None, None), ("b", b"new", None, None)], root, "two")
    assert other == {rows[5][0]: ("exists", 5, sha(rows[5][1])), "b": ("written", 3, sha(b"new"))}
    assert os.listdir(f"{root}/passing") == []


def test_odd_objects(spark, tmp_path):
    root = str(tmp_path / "store")
    got = put(spark, [(None, b"x", None, None), ("k", b"2", None, None), ("k", b"1", None, None), ("../k", b"", None, None), ("a//b", b"", None, None), ("e", None, None, None)], root)
    assert got == {"k": ("written", 1, min(sha(b"1"), sha(b"2"))), "../k": ("invalid_key", 0, sha(b"")), "a//b": ("invalid_key", 0, sha(b"")), "e": ("written", 0, sha(b""))}
    assert put(spark, [], root) == {}


def test_attempts_at_the_same_time_and_after_a_claim(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "store")
    with ThreadPoolExecutor(16) as pool:
        states = list(pool.map(lambda i: objects.put(Topic(root), f"b{i % 4}", "k", b"%d" % (i % 4)), range(64)))
    winner = Topic(root).read(Topic(root).place("meta", "k.json"))["batch"]
    assert [s[0] == "written" for s in states] == [f"b{i % 4}" == winner for i in range(64)]
    with open(f"{root}/objects/k", "rb") as f:
        assert f.read() == winner[1:].encode()
    # A claim whose attempt died before the content: the next attempt of the batch puts it there.
    store = Topic(root)
    store.create(store.place("meta", "late.json"), {"batch": "x", "checksum": sha(b"late"), "size": 4, "content_type": None, "metadata": {}})
    assert objects.put(store, "x", "late", b"late")[0] == "written"
    with open(f"{root}/objects/late", "rb") as f:
        assert f.read() == b"late"


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda a, b: spark.range(a, b).select("id", F.lit("denied").alias("what"))
    assert ledger.read(spark, path, "id long, what string").collect() == []
    assert ledger.append(rows(0, 5), path, "api", 0)
    assert not ledger.append(rows(0, 5), path, "api", 0)
    assert ledger.append(rows(5, 8), path, "worker", 0)
    spark.range(100, 200).write.parquet(f"{path}/data/half-{'0' * 32}")  # a batch that was never committed
    got = ledger.read(spark, path).collect()
    assert sorted((r["id"], r["application"], r["batch"]) for r in got) == [(i, "api" if i < 5 else "worker", "0") for i in range(8)]
    files = ledger._Files(spark, path)
    assert not files.create("another", "_log", "api@0") and files.create("another", "_log2", "x")
    with pytest.raises(ValueError, match="not a name"):
        ledger.append(rows(0, 1), path, "a/b", 1)


def test_denials_stay_when_the_caller_fails(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(3).withColumn("allowed", F.lit(False))

    def fails():
        raise PermissionError("denied")

    for _ in range(2):
        with pytest.raises(PermissionError):
            ledger.audited(rows, path, "api", "request-7", fails)
    assert ledger.read(spark, path).count() == 3


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("cp", "cp", "fresh"):  # restarted, then repeated from its first batch
        ledger.start_append(stream, path, str(tmp_path / checkpoint), "s").trigger(availableNow=True).start().awaitTermination(100)
    assert sorted(r["id"] for r in ledger.read(spark, path).collect()) == list(range(30))
