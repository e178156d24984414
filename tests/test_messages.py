"""The topic: commits, repeated epochs, offsets, prefetch and restarts."""

import json

import pytest
from pyspark.sql import functions as F

from wardlight.sources import messages as ms


@pytest.fixture
def topic(tmp_path):
    return str(tmp_path / "topic")


def rows(spark, a, b, keys=("document.stored", "document.failed")):
    key = F.element_at(F.array(*map(F.lit, keys)), (F.col("id") % len(keys) + 1).cast("int"))
    return spark.range(a, b).select(key.alias("routing_key"), F.lit("E").alias("type"), F.to_json(F.struct("id")).alias("body"))


def ids(df):
    return sorted(json.loads(r["body"])["id"] for r in df.select("body").collect())


def test_bindings():
    assert ms.bound(["a.b"], "a.b") and not ms.bound(["a.b"], "a.b.c")
    assert ms.bound(["a.*"], "a.b") and not ms.bound(["a.*"], "a") and not ms.bound(["a.*"], "a.b.c")
    assert all(ms.bound(["a.#"], k) for k in ("a", "a.b", "a.b.c")) and not ms.bound(["a.#"], "ab")
    assert ms.bound(["#"], "x.y") and ms.bound(["*.b.#"], "a.b.c.d") and not ms.bound([], "a")


def test_published_messages_are_read_by_key(spark, topic):
    assert ms.messages(spark, topic).collect() == []
    ms.publish(rows(spark, 0, 100).repartition(3), topic)
    ms.publish(rows(spark, 100, 150).drop("routing_key"), topic, "other.key")
    assert ids(ms.messages(spark, topic)) == list(range(150))
    assert ids(ms.messages(spark, topic, "document.stored, ,")) == list(range(0, 100, 2))
    assert ids(ms.messages(spark, topic, "document.*")) == list(range(100))
    got = ms.messages(spark, topic).groupBy("routing_key", "type", "content_type").count().collect()
    assert {r["routing_key"] for r in got} == {"document.stored", "document.failed", "other.key"}
    assert {(r["type"], r["content_type"]) for r in got} == {("E", "application/json")}
    places = ms.messages(spark, topic).select("entry", "row").collect()
    assert len(set(places)) == 150
    with pytest.raises(Exception, match="no routing key"):
        ms.publish(rows(spark, 0, 9).drop("routing_key"), topic)


def test_a_failed_batch_is_invisible_and_leaves_no_file(spark, topic):
    ms.publish(rows(spark, 0, 10), topic)
    bad = rows(spark, 10, 2000).repartition(4).withColumn("body", F.when(F.get_json_object("body", "$.id") == "1999", F.raise_error(F.lit("broken"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="broken"):
        ms.publish(bad, topic)
    assert ids(ms.messages(spark, topic)) == list(range(10))


def test_a_repeated_epoch_writes_nothing_twice(topic):
    writer = ms.TopicStreamWriter(topic, None, ["routing_key", "type", "body"], "w")
    write = lambda body: writer.write(iter([{"routing_key": "k", "type": "E", "body": body}]))
    first = write("a")
    assert ms.orphans(topic) == [first.files[0][1]]
    writer.commit([first, None], 0)
    writer.commit([again := write("a")], 0)
    assert ms.orphans(topic) == []
    writer.abort([gone := write("b"), None], 1)
    writer.commit([write("b")], 1)
    assert [e["files"][0][1] for e in (ms.Topic(topic).entry(0), ms.Topic(topic).entry(1))][0] == first.files[0][1]
    assert ms.Topic(topic).next_entry() == 2
    assert ms.orphans(topic) == [] and again.files != gone.files
    other = ms.TopicStreamWriter(topic, None, ["routing_key", "type", "body"], "v")
    other.commit([other.write(iter([{"routing_key": "k", "type": "E", "body": "c"}]))], 0)
    assert ms.Topic(topic).entry(2)["epochs"] == {"w": 1, "v": 0}


def test_offsets_take_at_most_the_prefetch(topic):
    writer = ms.TopicStreamWriter(topic, None, ["routing_key", "type", "body"], "w")
    for epoch, n in enumerate((5, 0, 12, 1)):
        writer.commit([writer.write(iter([{"routing_key": "ab"[i % 2], "type": "E", "body": str(i)} for i in range(n)]))], epoch)
    for keys, total in ((["#"], 18), (["a"], 10), (["none"], 0)):
        for prefetch in (1, 3, 4, 100):
            reader = ms.TopicStreamReader(topic, keys, f"{keys}{prefetch}".replace("#", "x"), prefetch)
            at, seen = reader.initialOffset(), []
            while (to := reader.latestOffset()) != at:
                got = [m for s in reader.partitions(at, to) for m in reader.read(s)]
                assert len(got) <= prefetch
                seen += got
                reader.commit(to)
                at = to
            assert len(seen) == len(set((m[4], m[5]) for m in seen)) == total


def run(stream, out, checkpoint, fail_at=None):
    def batch(df, number):
        if number == fail_at:
            df.collect()
            raise RuntimeError("the consumer breaks")
        df.write.mode("overwrite").json(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_each_message_once_over_breaks_and_restarts(spark, topic, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    ms.publish(rows(spark, 0, 40).repartition(2), topic)
    stream = lambda: ms.consume(spark, topic, "document.#", "c", 15)
    with pytest.raises(Exception, match="breaks"):
        run(stream(), out, checkpoint, fail_at=1)
    ms.publish(rows(spark, 40, 70), topic)
    run(stream(), out, checkpoint)
    got = spark.read.json(out)
    assert ids(got) == list(range(70))
    assert max(r["count"] for r in got.groupBy("batch").count().collect()) <= 15
    ms.publish(rows(spark, 70, 75), topic)
    run(stream(), out, checkpoint)
    assert ids(spark.read.json(out)) == list(range(75))


def test_a_stream_from_topic_to_topic(spark, topic, tmp_path):
    ms.publish(rows(spark, 0, 30), topic)
    sent = ms.consume(spark, topic, "document.stored", "relay", 7).select(F.lit("told").alias("routing_key"), "type", "body")
    target = str(tmp_path / "target")
    for _ in range(2):
        q = ms.start_publishing(sent, target, str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
    assert ids(ms.messages(spark, target, "told")) == list(range(0, 30, 2))
