"""Streams over small files: rate limit, redelivery and windowed counts."""

import datetime as dt

from wardlight.sources import files
from wardlight.streaming import limits, scaling

T0 = dt.datetime(2024, 1, 1)


def _run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.sql(f"select * from {name}")


def test_stream_rate_limit(spark, tmp_path):
    rows = [("a", s) for s in (0, 10, 61, 62)] + [("b", 5)]
    spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s)) for k, s in rows], "identity string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("identity string, at timestamp").parquet(str(tmp_path / "in"))
    got = _run(limits.stream_rate_limited(stream), tmp_path, "limited")
    assert sorted((r["identity"], (r["at"] - T0).seconds, r["allowed"]) for r in got.collect()) == [("a", 0, True), ("a", 10, False), ("a", 61, True), ("a", 62, False), ("b", 5, True)]


def test_stream_rate_limit_over_triggers(spark, tmp_path):
    """A backlog read in several triggers, unordered within each, gives what the batch gives."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    seconds = [[30, 5, 0, 59], [70, 61, 60, 119], [125, 121, 300], [301, 359, 361]]
    rows = [(k, T0 + dt.timedelta(seconds=s)) for k in "ab" for part in seconds for s in part]
    for part in seconds:
        spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s)) for k in "ab" for s in part], "identity string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("identity string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(limits.stream_rate_limited(stream, late="1 hour"), tmp_path, "limited_again")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batch = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "identity string, at timestamp, n long")
    want = limits.rate_limited(batch, "identity", "at", "n").join(batch, ["identity", "n"])
    key = lambda r: (r["identity"], r["at"], r["allowed"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_message_sink(spark, tmp_path):
    spark.createDataFrame([("document.stored", "A", 1), ("document.failed", "B", 2)], "routing_key string, type string, n long").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("routing_key string, type string, n long").json(str(tmp_path / "in"))
    sent = files.as_messages(stream.where("routing_key = 'document.stored'").drop("routing_key"), "document.stored")
    files.start_sink(sent, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("routing_key", "type", "body").collect()] == [("document.stored", "A", '{"n":1}')]


def test_stream_without_redelivery(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([("x", T0), (f"y{i}", T0)], "event_id string, at timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id string, at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(scaling.without_redelivery(stream, "event_id", "at"), tmp_path, "once")
    assert sorted(r["event_id"] for r in got.collect()) == ["x", "y0", "y1"]


def test_stream_windowed_counts(spark, tmp_path):
    rows = [(T0 + dt.timedelta(hours=h), "a") for h in (0, 1, 30, 100)]
    spark.createDataFrame(rows, "at timestamp_ntz, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp_ntz, kind string").parquet(str(tmp_path / "in"))
    got = _run(scaling.windowed_counts(stream, "at", "kind"), tmp_path, "counts", "complete")
    assert sorted(r["n"] for r in got.collect()) == [1, 1, 2]


def test_event_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"type": "DocumentStored", "body": "{}", "seq": 1}\n')
    got = _run(files.event_files(spark, str(tmp_path / "in")), tmp_path, "messages")
    assert [(r["type"], r["seq"]) for r in got.collect()] == [("DocumentStored", 1)]
