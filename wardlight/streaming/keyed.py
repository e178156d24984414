"""Keyed state with expiry in event time: one-time codes, and retries with a dead-letter output.

Rows of a trigger are in no order, so a key's rows are held in a map state under their time until the watermark has passed them, when a timer hands
them out by (time, order). A result so depends on the rows alone and equals the batch form's, however they arrive within ``late``; rows
behind the watermark are dropped. What a state remembers has a timer of its own and goes when it can have no effect any more.

Streams need ``spark.sql.streaming.stateStore.providerClass`` to be RocksDB's; ``use_keyed_state`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from .limits import ATTEMPTS, CODE_S, code_attempts

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Tries after a failure before a message is a dead letter, and seconds before the first of them; each waits twice as long as the one before.
MOST_RETRIES, BACKOFF_S = 3, 60


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Holds a key's rows (at, seq, ..) until the watermark has passed them, then gives them to ``one`` in order.

    ``due`` is asked whenever a timer runs out, before rows of a later time, for results that are not a row's.
    """

    #: Schema of what is held of a row besides (at, seq), in microseconds and as a long.
    HELD = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, seq long", self.HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timers = set()
        for row in rows:
            self.waiting.updateValue((row["at_us"], row["seq"]), self.held(row))
            timers.add(row["at_us"] // 1000 + 1)
        for ms in timers:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # All that the watermark has passed: what a row makes due may lie behind it, too.
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        ready = sorted((k, v) for k, v in self.waiting.iterator() if k[0] < upto) if self.waiting.exists() else []
        for (at, seq), value in ready:
            yield from self.due(key, at)
            yield from self.one(key, at, seq, value)
            self.waiting.removeKey((at, seq))
        yield from self.due(key, upto)

    def close(self) -> None:
        pass

    def held(self, row: Row) -> tuple:
        raise NotImplementedError

    def one(self, key, at: int, seq: int, value) -> Iterator[Row]:
        raise NotImplementedError

    def due(self, key, at: int) -> Iterator[Row]:
        return iter(())


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp")).alias("at_us")


# ---------------------------------------------------------------- codes


class Codes(InOrder):
    """The code of an identity: issued, tried, gone after ``life`` seconds, ``most`` wrong tries or one right one."""

    HELD = "issued boolean, code string"

    def __init__(self, most: int, life: float):
        self.most, self.life = most, int(life * 1_000_000)

    def init(self, handle) -> None:
        super().init(handle)
        self.code = handle.getValueState("code", "code string, issued_at long, wrong int, burned boolean")

    def held(self, row: Row) -> tuple:
        return (row["issued"], row["code"])

    def one(self, key, at, seq, value) -> Iterator[Row]:
        issued, code = value
        if issued:
            self.code.update((code, at, 0, ""))
            self.handle.registerTimer((at + self.life) // 1000 + 1)
            return
        yield Row(identity=key[0], seq=seq, outcome=self._outcome(at, code))

    def _outcome(self, at: int, code) -> str:
        if not self.code.exists() or at - self.code.get()[1] > self.life:
            return "absent"
        own, issued_at, wrong, burned = self.code.get()
        if burned:
            return "burned"
        right = code is not None and code == own
        wrong += not right
        burned = right or wrong >= self.most
        self.code.update((None if burned else own, issued_at, wrong, burned))
        return "accepted" if right else "wrong"

    def due(self, key, at) -> Iterator[Row]:
        if self.code.exists() and at - self.code.get()[1] > self.life:
            self.code.clear()
        return iter(())


def stream_code_attempts(events: DataFrame, most: int = ATTEMPTS, life: float = CODE_S, late: str = "10 minutes") -> DataFrame:
    """(identity, seq, outcome) of a stream's tries (identity string, at timestamp, seq long, issued boolean, code string).

    ``issued`` rows set a new code and forget the one before with its wrong tries; the others try one. Outcomes: accepted, wrong,
    burned (used, or tried ``most`` times, and its life is not over) and absent (never issued, or more than ``life`` seconds ago, when the state is gone). Rows without
    identity, at or seq are left out.
    """
    rows = _rows(events, "identity", F.coalesce("issued", F.lit(False)).alias("issued"), "code", late=late)
    return rows.groupBy("identity").transformWithState(Codes(most, life), "identity string, seq long, outcome string", "append", "eventTime")


def _rows(events: DataFrame, key: str, *more, late: str) -> DataFrame:
    known = events.where(F.col(key).isNotNull() & F.col("at").isNotNull() & F.col("seq").isNotNull())
    timed = known.select(F.col(key).cast("string").alias(key), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), *more)
    return timed.withColumn("at_us", _micros("at")).withWatermark("at", late)


def batch_code_attempts(events: DataFrame, most: int = ATTEMPTS, life: float = CODE_S) -> DataFrame:
    """The batch form of ``stream_code_attempts``: a code's tries are those between its issue and the next."""
    known = events.where("identity is not null and at is not null and seq is not null").withColumn("issued", F.coalesce("issued", F.lit(False)))
    upto = Window.partitionBy("identity").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("issued"), F.struct("at", "seq", "code")), ignorenulls=True).over(upto)
    tries = known.withColumn("last", last).where(~F.col("issued"))
    asked = tries.select(
        F.struct("identity", "last.seq").alias("code_id"), "identity", F.struct("at", "seq").alias("seq"), F.col("seq").alias("n"),  # tries of one code in order of time
        ((F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("last.at").cast("timestamp"))) / 1e6).alias("after"),
        F.coalesce(F.col("code") == F.col("last.code"), F.lit(False)).alias("correct"), F.col("last").isNull().alias("never"),
    )
    there = ~F.col("never") & (F.col("after") <= life)
    judged = code_attempts(asked.where(there), most, life).unionByName(asked.where(~there).withColumn("outcome", F.lit("absent")))
    return judged.select("identity", F.col("n").alias("seq"), "outcome")


# -------------------------------------------------------------- retries

RETRIES = "message_id string, seq long, attempts int, outcome string, at timestamp, first_failed_at timestamp"


class Retries(InOrder):
    """Failures of a message since it last succeeded, and the retry that is due."""

    HELD = "ok boolean"

    def __init__(self, most: int, backoff_s: float):
        self.most, self.backoff = most, int(backoff_s * 1_000_000)

    def init(self, handle) -> None:
        super().init(handle)
        self.failed = handle.getValueState("failed", "n int, first long, seq long, due long")

    def held(self, row: Row) -> tuple:
        return (row["ok"],)

    def one(self, key, at, seq, value) -> Iterator[Row]:
        n, first = self.failed.get()[:2] if self.failed.exists() else (0, at)
        if value[0]:
            self.failed.clear()
        elif n + 1 > self.most:
            self.failed.clear()
            yield self._result(key, seq, n + 1, "dead_letter", at, first)
        else:
            due = at + self.backoff * 2**n
            self.failed.update((n + 1, first, seq, due))
            self.handle.registerTimer(due // 1000 + 1)

    def due(self, key, at) -> Iterator[Row]:
        if self.failed.exists():
            n, first, seq, due = self.failed.get()
            if 0 <= due <= at:
                self.failed.update((n, first, seq, -1))
                yield self._result(key, seq, n, "retry", due, first)

    def _result(self, key, seq, n, outcome, at, first) -> Row:
        return Row(message_id=key[0], seq=seq, attempts=n, outcome=outcome, at=_time(at), first_failed_at=_time(first))


def _time(us: int):
    import datetime as dt

    return dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=us)


def stream_retries(results: DataFrame, most: int = MOST_RETRIES, backoff_s: float = BACKOFF_S, late: str = "10 minutes") -> DataFrame:
    """``RETRIES`` of a stream of results (message_id string, at timestamp, seq long, ok boolean).

    The n-th failure since the last success makes a message due again ``backoff_s`` · 2ⁿ⁻¹ seconds later: a row 'retry' with that time, once the
    watermark is there, unless another result of the message came before. A failure after ``most`` retries is a 'dead_letter' with the number of attempts, and
    counting begins anew. Rows without id, at, seq or ok are left out. ``at`` of a dead letter is the time of the failure.
    """
    rows = _rows(results.where("ok is not null"), "message_id", "ok", late=late)
    return rows.groupBy("message_id").transformWithState(Retries(most, backoff_s), RETRIES, "append", "eventTime")


def batch_retries(results: DataFrame, most: int = MOST_RETRIES, backoff_s: float = BACKOFF_S) -> DataFrame:
    """The batch form of ``stream_retries``; every retry that no other result precedes is due at some time."""
    known = results.where("message_id is not null and at is not null and seq is not null and ok is not null").select(F.col("message_id").cast("string").alias("message_id"), F.col("at").cast("timestamp").alias("at"), "seq", "ok")
    order = Window.partitionBy("message_id").orderBy("at", "seq")
    runs = known.withColumn("run", F.count_if("ok").over(order)).withColumn("next", F.lead("at").over(order)).where("not ok")
    failed = runs.withColumn("k", F.row_number().over(Window.partitionBy("message_id", "run").orderBy("at", "seq")) - 1)
    failed = failed.withColumn("attempts", (F.col("k") % (most + 1) + 1).cast("int")).withColumn("round", F.floor(F.col("k") / (most + 1)))
    first = F.min("at").over(Window.partitionBy("message_id", "run", "round"))
    due = F.timestamp_micros(F.unix_micros("at") + (F.lit(int(backoff_s * 1_000_000)) * F.pow(F.lit(2), F.col("attempts") - 1)).cast("long"))
    out = failed.withColumn("first_failed_at", first).withColumn("due", due).withColumn("outcome", F.when(F.col("attempts") > most, "dead_letter").otherwise("retry"))
    kept = out.where("outcome = 'dead_letter' or next is null or next >= due")
    return kept.select("message_id", "seq", "attempts", "outcome", F.when(F.col("outcome") == "retry", F.col("due")).otherwise(F.col("at")).alias("at"), "first_failed_at")


def start_retries(decided: DataFrame, path: str, checkpoint: str):
    """Both outputs of ``stream_retries`` as tables under ``path``: retries/ and dead_letters/, a folder for each batch, which a repeated batch replaces."""

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for outcome, name in (("retry", "retries"), ("dead_letter", "dead_letters")):
                batch.where(F.col("outcome") == outcome).drop("outcome").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return decided.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
