"""Importance resampling towards a target distribution over hashed word runs.

A text's features are its runs of one and two words, hashed into buckets. A bucket's gain is the logarithm of its
smoothed share among the target's features over that among all documents' features, and a document's weight the mean
gain of its features. Gumbel noise from a seeded digest of the id is added, so that taking the highest scores
draws without replacement with chances that follow the weights.

Three passes over Spark tables: bucket counts, one array for each task, summed by bucket (the number of buckets is fixed);
scores, with the gains as one array that every task looks up; and the draw. Scores are whole
numbers within bounds that do not depend on the input, so a table of rows by score is small. It gives the score
at which the draw ends and cuts the scores above into ranges of about ``merge_rows`` rows with known first ranks. Every
partition sorts its eligible rows that can be drawn into runs, cuts them at the ranges, and sends a run's part
of a range as one row; a range is merged from the runs' parts by a tournament tree that stops at the exact draw count.
Rows that no range needs never move.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _LOWER, text_bytes, text_slices, written

BUCKETS = 10_000
LEAST_WORDS = 20
#: Rows of one merge, and of one sorted run at most.
MERGE_ROWS = 1 << 18
RUN_ROWS = 1 << 20

# ------------------------------------------------------------------- features

#: A-Z in lower case, every ASCII byte that is no letter or digit a space.
_WORD_BYTES = bytes(int(_LOWER[b]) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_LONGEST = 64


@lru_cache(maxsize=1)
def _crc_steps() -> np.ndarray:
    """``steps[n, k, b]``: what byte k of a CRC register with the value b becomes when n zero bytes follow."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    steps = np.empty((_LONGEST + 1, 4, 256), dtype=np.uint32)
    for k in range(4):
        steps[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(_LONGEST):
        steps[n + 1] = table[steps[n] & 255] ^ (steps[n] >> np.uint32(8))
    return steps


def _followed(crc: np.ndarray, then: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of two strings in a row, from both CRCs and the second's length (at most ``_LONGEST``)."""
    steps = _crc_steps()
    out = then.copy()
    for k in range(4):
        out ^= steps[size, k, (crc >> np.uint32(8 * k)) & 255]
    return out


def feature_buckets(text: bytes, buckets: int = BUCKETS, block: int = 1 << 20):
    """Yields (buckets of the runs of one and two words, number of words) for consecutive blocks of a text, so that a long one takes no more memory."""
    text, start, before = text.translate(_WORD_BYTES), 0, []
    while start < len(text):
        stop = text.find(b" ", min(start + block, len(text)))
        words = text[start : len(text) if stop < 0 else stop].split()
        start = len(text) if stop < 0 else stop
        if words:
            yield _runs_of(before + words, len(before)).astype(np.int64) % buckets, len(words)
            before = words[-1:]


def _runs_of(words: list[bytes], old: int) -> np.ndarray:
    """CRC-32 of all words but the first ``old``, and of all pairs of words in a row."""
    one = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    spaced = np.full(len(words) - 1, zlib.crc32(b" "), dtype=np.uint32)
    first = _followed(one[:-1], spaced, np.ones(len(words) - 1, dtype=np.int64))
    two = _followed(first, one[1:], np.minimum(size[1:], _LONGEST))
    for i in np.flatnonzero(size[1:] > _LONGEST):
        two[i] = zlib.crc32(words[i + 1], int(first[i]))
    return np.concatenate((one[old:], two))


def _texts(column: pa.Array):
    """(first row, bytes of each text) by slices, so that few texts are held beside the batch."""
    for start, part in text_slices(column):
        data, offsets = text_bytes(part)
        yield start, [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is a feature in all texts of a table: one row a bucket and task is shuffled."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in _texts(batch.column(0)):
                for own in (own for text in texts for own, _ in feature_buckets(text, buckets)):
                    np.add.at(total, own, 1)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], names=["bucket", "n"])

    rows = table.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


# ------------------------------------------------------------------- the draw


class Tournament:
    """A tree of matches over sorted runs: every inner node keeps the loser of its match, the root's winner is next.

    A run is a list of keys in order; the next key of a run that won plays again only on its own path to the root.
    """

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(len(runs), 1)
        self.losers = [-1] * self.size
        winners = [-1] * self.size + list(range(len(runs))) + [-1] * (self.size - len(runs))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if runs else -1

    def _head(self, run: int):
        return self.runs[run][self.at[run]] if run >= 0 and self.at[run] < len(self.runs[run]) else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return x is not None and (y is None or (x, a) < (y, b))

    def take(self, most: int):
        """(run, place in the run) of the first ``most`` keys of all runs, in order."""
        for _ in range(most):
            run = self.winner
            if self._head(run) is None:
                return
            yield run, self.at[run]
            self.at[run] += 1
            node = (run + self.size) // 2
            while node:
                if self._before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


_KEPT = ("doc_id", "n_features", "weight", "score")


def _sorted_runs(bounds: np.ndarray, run_rows: int):
    """Cuts a partition's drawable rows, sorted, into parts by range; ``bounds`` are (-score, doc_id) of the ranges' first rows."""

    def run(batches):
        made, have, size = 0, [], 0
        for batch in batches:
            have.append(batch)
            size += batch.num_rows
            if size >= run_rows:
                yield parts(have, made)
                made, have, size = made + 1, [], 0
        if size:
            yield parts(have, made)

    def parts(have, made):
        from pyspark import TaskContext

        table = pa.Table.from_batches(have)
        ids, n, weight, score = (table.column(c).to_numpy() for c in _KEPT)
        order = np.lexsort((ids, -score))
        keys = np.stack((-score[order], ids[order]))
        # The range of each row: how many range starts are at or before its key.
        at = np.searchsorted(bounds[0], keys[0], side="left")
        upto = np.searchsorted(bounds[0], keys[0], side="right")
        for i in np.flatnonzero(upto > at):  # a start with the same score: compare ids
            at[i] += np.searchsorted(bounds[1, at[i] : upto[i]], keys[1, i], side="right")
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ends = np.append(starts[1:], len(at))
        packed = np.stack((ids[order], n[order], weight[order], score[order]), axis=1).astype("<i8")
        number = (TaskContext.get().partitionId() << 20) + made
        rows = [pa.array(at[starts]), pa.array(np.full(len(starts), number)), pa.array([packed[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())]
        return pa.RecordBatch.from_arrays(rows, names=["range", "run", "rows"])

    return run


def _merged(first_rank: np.ndarray, count: int):
    """Merges the parts of a range; rows beyond the draw count get no rank."""

    def run(key, table):
        table = table.sort_by("run")
        parts = [np.frombuffer(x.as_py(), dtype="<i8").reshape(-1, 4) for x in table.column("rows")]
        every = np.concatenate(parts)
        before = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        base = int(first_rank[key[0].as_py()])
        tree = Tournament([list(zip((-p[:, 3]).tolist(), p[:, 0].tolist(), strict=True)) for p in parts])
        taken = np.fromiter((before[r] + i for r, i in tree.take(max(0, count - base))), np.int64)
        rank = np.zeros(len(every), dtype=np.int64)
        rank[taken] = base + 1 + np.arange(len(taken))
        return pa.table([*(pa.array(every[:, i]) for i in range(4)), pa.array(rank, mask=rank == 0)], names=[*_KEPT, "rank"])

    return run


def draw(scored: DataFrame, count: int, merge_rows: int = MERGE_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """``scored`` (doc_id, n_features, weight, score, eligible) with ``rank``: the ``count`` highest scores among the eligible, ties to the smaller doc_id."""
    by_score = scored.where("eligible").groupBy("score").count().toArrow()
    score, rows = by_score.column("score").to_numpy(), by_score.column("count").to_numpy()
    order = np.argsort(-score)
    score, rows = score[order], rows[order]
    upto = np.cumsum(rows)
    count = min(count, int(upto[-1]) if len(upto) else 0)
    kept = [*_KEPT, F.lit(None).cast("long").alias("rank")]
    if not count:
        return scored.select(*kept)
    end = int(np.searchsorted(upto, count))  # the score at which the draw ends
    starts, ranks = [(-int(score[0]), -(1 << 62))], [0]
    held = 0
    for i in range(end + 1):
        crowd = int(rows[i])
        if held and held + crowd > merge_rows:
            starts.append((-int(score[i]), -(1 << 62)))
            ranks.append(int(upto[i]) - crowd)
            held = 0
        held += crowd
        if crowd > merge_rows:  # one score with more rows than a merge takes: ranges of ids, too
            more = _id_ranges(scored.where(F.col("eligible") & (F.col("score") == int(score[i]))), -(-crowd // merge_rows))
            starts += [(-int(score[i]), a) for a, _ in more[1:]]
            ranks += [int(upto[i]) - crowd + n for _, n in more[1:]]
            held = merge_rows
    bounds = np.array(starts[1:], dtype=np.int64).reshape(-1, 2).T
    first_rank = np.array(ranks, dtype=np.int64)
    drawable = F.col("eligible") & (F.col("score") >= int(score[end]))
    parts = scored.where(drawable).select(*_KEPT).mapInArrow(_sorted_runs(bounds, run_rows), "range long, run long, rows binary")
    drawn = parts.groupBy("range").applyInArrow(_merged(first_rank, count), "doc_id long, n_features long, weight long, score long, rank long")
    return scored.where(~drawable).select(*kept).unionByName(drawn)


def _id_ranges(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """(first id, rows before) of about ``n`` ranges of ids with as many rows each."""
    cuts = rows.select(F.percentile_approx("doc_id", [i / n for i in range(n)], 10 * n)).first()[0]
    cuts = sorted(set(cuts[1:]))
    own = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda k, c: k + (F.col("doc_id") >= c).cast("int")) if cuts else F.lit(0)
    sizes = {r["k"]: r["count"] for r in rows.groupBy(own.alias("k")).count().collect()}
    out, before = [], 0
    for k, a in enumerate([-(1 << 62), *cuts]):
        out.append((a, before))
        before += sizes.get(k, 0)
    return out


# ------------------------------------------------------------------- the whole


def score(docs: DataFrame, gains: np.ndarray, seed: int = 7, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible) for each row; without a doc_id the score is null and the row never eligible."""
    buckets = len(gains)

    def run(batches):
        for batch in batches:
            for start, texts in _texts(batch.column("text")):
                out = []
                for text in texts:
                    n, total, words = 0, 0, 0
                    for own, more in feature_buckets(text, buckets):
                        n, total, words = n + len(own), total + int(gains[own].sum()), words + more
                    out.append((n, total // n if n else 0, words))
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), *columns], names=["doc_id", "n_features", "weight", "n_words"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = texts.mapInArrow(run, "doc_id long, n_features long, weight long, n_words long")
    eligible = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    return weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), eligible.alias("eligible"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, buckets: int = BUCKETS, seed: int = 7, least_words: int = LEAST_WORDS, merge_rows: int = MERGE_ROWS, run_rows: int = RUN_ROWS
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``docs``, resampled towards the texts of ``target``.

    Of the rows with at least ``least_words`` words and a doc_id, ``percent`` per cent (rounded down) with the highest scores are drawn and
    ranked from 1; ``rank`` of the others is null. Null and empty texts have no features and weight 0. A row without doc_id has no
    score and is neither counted nor drawn. Repeated rows are counted and drawn each; which of two equal rows
    has the smaller rank is open. An empty target gives each bucket the share that smoothing leaves. Other columns are ignored.

    The scores are written to the shared folder once. Broadcast are the gains (``buckets`` numbers) and the ranges' bounds.
    """
    gains = gains_of(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = written(score(docs, gains, seed, least_words))
    able = scored.where("eligible").count()
    return draw(scored, able * percent // 100, merge_rows, run_rows)
