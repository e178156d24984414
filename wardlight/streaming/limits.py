"""Limits kept per key: requests per window, and attempts at a code.

A window begins with the first request after the last window's end; requests that are turned away count but do not
extend it. That is neither a tumbling nor a session window, so it is a state per key: in batch over sorted groups
that are read one batch at a time, as a stream with a state of two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW_S, ALLOWED = 60, 1
ATTEMPTS, CODE_S = 5, 300


def anchored(seconds: list[float], began: float | None, count: int, window: float = WINDOW_S, allowed: int = ALLOWED) -> tuple[list[bool], float | None, int]:
    """Verdicts for ascending times, and the window's begin and count after them."""
    out = []
    for t in seconds:
        if began is None or t >= began + window:
            began, count = t, 0
        count += 1
        out.append(count <= allowed)
    return out, began, count


def rate_limited(requests: DataFrame, key: str, at: str, order: str, window: float = WINDOW_S, allowed: int = ALLOWED) -> DataFrame:
    """Requests (key, at, order) with ``allowed``. Partitions are sorted and read in batches, so a busy key needs no room."""
    seconds = (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("_s")
    rows = requests.select(F.col(key), F.col(order), seconds).repartition(key).sortWithinPartitions(key, "_s", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, began, count = None, None, 0
        for b in batches:
            verdicts = []
            for k, t in zip(b[key], b["_s"], strict=True):
                if k != now:
                    now, began, count = k, None, 0
                (ok,), began, count = anchored([t], began, count, window, allowed)
                verdicts.append(ok)
            yield pd.DataFrame({key: b[key], order: b[order], "allowed": verdicts})

    kinds = dict(requests.dtypes)
    return rows.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean")


def stream_rate_limited(requests: DataFrame, key: str = "identity", at: str = "at", window: float = WINDOW_S, allowed: int = ALLOWED, late: str = "10 minutes") -> DataFrame:
    """A stream's requests (key string, at timestamp) with ``allowed``, judged by the times of the requests alone.

    All that a trigger brings for a key is put in order first. A key's state goes when the watermark, ``late`` behind the newest
    request, has passed the window's end; requests behind the watermark are dropped, as no state could judge them.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        began, count = state.get if state.exists else (None, 0)
        times = pd.concat([b[at] for b in batches]).sort_values()
        verdicts, began, count = anchored([t.timestamp() for t in times], began, count, window, allowed)
        state.update((began, count))
        # Not before the watermark, which is where an expiry may be set at the earliest.
        state.setTimeoutTimestamp(int(max((began + window) * 1000, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame({key: [k[0]] * len(times), at: times.to_numpy(), "allowed": verdicts})

    marked = requests.withWatermark(at, late)
    return marked.groupBy(key).applyInPandasWithState(run, f"{key} string, {at} timestamp, allowed boolean", "began double, count long", "append", GroupStateTimeout.EventTimeTimeout)


def code_attempts(attempts: DataFrame, most: int = ATTEMPTS, life: float = CODE_S) -> DataFrame:
    """Attempts (code_id, seq, after, correct) with ``outcome``: accepted, wrong, expired, or burned once the code is used or spent."""
    before = Window.partitionBy("code_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    in_time = F.col("after") <= life
    wrong = F.coalesce(F.sum(F.when(in_time & ~F.col("correct"), 1)).over(before), F.lit(0))
    out = attempts.withColumn("_wrong", wrong).withColumn("_right", F.col("correct") & in_time & (F.col("_wrong") < most))
    used = F.coalesce(F.bool_or("_right").over(before), F.lit(False))
    outcome = F.when(used | (F.col("_wrong") >= most), "burned").when(~in_time, "expired").when(F.col("correct"), "accepted").otherwise("wrong")
    return out.withColumn("outcome", outcome).drop("_wrong", "_right")
