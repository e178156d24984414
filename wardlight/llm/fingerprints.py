"""Fingerprints from a document's most improbable byte windows.

Every 64-byte window of a text has an entropy (in thousandths of the most that 64 bytes can have). How rare
an entropy is, is counted over all windows of all documents, and the rarer it is, the higher a window ranks. Among any 64
windows in a row the leftmost of the highest rank scores a point; windows with 16 points or more are
the text's features. A feature sets 5 bits of a 2048-bit Bloom filter; after 160 features a filter is full and
the next one of the chain begins. Likeness is the number of bits in common, less what chance gives, over the most
there could be: each filter of the shorter chain against its best match in the other, averaged.

Windows of one batch are computed together with numpy: a window's entropy differs from its left
neighbour's by the byte that leaves and the one that enters, whose counts come from comparing the bytes with themselves
shifted by 1 to 63.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import BLOCK, cut_lineage, mix64, power_table, prefix_hash

SIZE = 64
POINTS = 16
PER_FILTER = 160
BITS = 2048
LEVELS = 1001
_GAP = 2 * SIZE
_UNIT = 1 << 20


def _terms() -> np.ndarray:
    c = np.arange(SIZE + 1, dtype=np.float64)
    c[0] = 1
    out = np.rint(c / SIZE * np.log2(SIZE / c) * _UNIT).astype(np.int64)
    out[0] = 0
    return out


_TERM = _terms()
_STEP = np.diff(_TERM, prepend=0)  # what the n-th equal byte adds


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy level, 0 to 1000, of each window of 64 bytes by its start (len - 63 of them)."""
    n = len(data)
    if n < SIZE:
        return np.empty(0, dtype=np.int32)
    back = np.ones(n, dtype=np.uint8)  # equal bytes among this and the 63 before
    ahead = np.ones(n, dtype=np.uint8)  # and among this and the 63 after
    block = 1 << 18  # stays in the processor's cache
    for a in range(0, n, block):
        b = min(n, a + block)
        for d in range(1, min(SIZE, n)):
            lo = max(a, d)
            if lo < b:
                same = (data[lo:b] == data[lo - d : b - d]).view(np.uint8)
                back[lo:b] += same
                ahead[lo - d : b - d] += same
    start = _TERM[np.bincount(data[:SIZE], minlength=256)].sum()
    change = _STEP[back[SIZE:]] - _STEP[ahead[: n - SIZE]]
    total = np.concatenate(([start], start + np.cumsum(change)))
    return (total * 1000 // (6 * _UNIT)).astype(np.int32)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, apart enough that no window and no run of windows meets two of them."""
    parts, starts, at = [bytes(_GAP)], [], _GAP
    for t in texts:
        starts.append(at)
        parts += [t, bytes(_GAP)]
        at += len(t) + _GAP
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(starts, dtype=np.int64)


def _chunks(texts: list[bytes], most: int = 1 << 20):
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= most):
            size += len(texts[stop]) + _GAP
            stop += 1
        yield at, texts[at:stop]
        at = stop


def entropy_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each level."""
    out = np.zeros(LEVELS, dtype=np.int64)
    for _, part in _chunks(texts):
        if len(part) == 1:  # maybe a long one
            data = np.frombuffer(part[0], dtype=np.uint8)
            for a in range(0, len(data) - SIZE + 1, BLOCK):
                out += np.bincount(entropies(data[a : a + BLOCK + SIZE - 1]), minlength=LEVELS)
            continue
        data, starts = _joined(part)
        levels = entropies(data)
        for s, t in zip(starts, part, strict=True):
            if len(t) >= SIZE:
                out += np.bincount(levels[s : s + len(t) - SIZE + 1], minlength=LEVELS)
    return out


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, 0 for the rarest; windows of nearly one byte (below 100) come last."""
    order = np.lexsort((np.arange(LEVELS), counts, np.arange(LEVELS) < 100))
    ranks = np.empty(LEVELS, dtype=np.int64)
    ranks[order] = np.arange(LEVELS)
    return ranks


def _leftmost_least(keys: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        keys = np.minimum(keys[:-step], keys[step:])
        done += step
    return keys


def _scored(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, block: int):
    """(position, hash) of every feature of joined texts, and the points of all windows, block after block."""
    points = np.zeros(len(data), dtype=np.uint8)
    chosen, hashes = [], []
    for a in range(0, len(data), block):
        b = min(a + block, len(data))
        lo = max(0, a - SIZE + 1)  # a window's points come from the runs of windows that begin up to 63 before it
        own = data[lo : b + 2 * SIZE - 2]
        levels = entropies(own)
        if len(levels) < SIZE:
            continue
        position = np.arange(lo, lo + len(levels), dtype=np.int64)
        text = np.searchsorted(starts, position, side="right") - 1
        valid = (text >= 0) & (position - starts[text] + SIZE <= lengths[text])
        best = _leftmost_least((np.where(valid, ranks[levels], LEVELS) << 40) | position, SIZE)
        got = np.bincount((best[best >> 40 < LEVELS] & ((1 << 40) - 1)) - lo, minlength=len(levels))[a - lo : b - lo]
        points[a : a + len(got)] = got
        at = np.flatnonzero(got >= POINTS) + (a - lo)
        sums, down = prefix_hash(own), power_table(len(own) + 1, "down")
        chosen.append(at + lo)
        hashes.append(mix64((sums[at + SIZE] - sums[at]) * down[at]))
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *chosen]), np.concatenate([none.view(np.uint64), *hashes]), points


def fingerprints(texts: list[bytes], ranks: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The chained Bloom filters of each text, 256 bytes each; none for an empty text. Long texts are taken in blocks."""
    out: list[bytes] = []
    for _, part in _chunks(texts):
        data, starts = _joined(part)
        chosen, hashes, points = _scored(data, starts, np.array([len(t) for t in part]), ranks, block)
        for s, t in zip(starts, part, strict=True):
            a, b = np.searchsorted(chosen, (s, s + len(t)))
            own = hashes[a:b]
            if a == b and t:  # no window has enough points, or the text is shorter than one
                stop = s + len(t) - SIZE + 1
                at = int(s + np.argmax(points[s:stop])) if stop > s else int(s)
                own = mix64(prefix_hash(data[at : min(at + SIZE, s + len(t))])[-1:])
            out.append(_filters(own))
    return out


def _filters(hashes: np.ndarray) -> bytes:
    made = []
    for a in range(0, len(hashes), PER_FILTER):
        bits = np.zeros(BITS, dtype=np.uint8)
        for i in range(5):
            bits[(hashes[a : a + PER_FILTER] >> np.uint64(11 * i)) & np.uint64(BITS - 1)] = 1
        made.append(np.packbits(bits).tobytes())
    return b"".join(made)


def likeness(a: bytes, b: bytes) -> float:
    """0 for no more bits in common than chance gives, 1 for equal fingerprints."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    x = np.frombuffer(a, dtype=np.uint8).reshape(-1, BITS // 8)
    y = np.frombuffer(b, dtype=np.uint8).reshape(-1, BITS // 8)
    n_y = np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    scores = []
    for own in x:
        n = int(np.bitwise_count(own).sum(dtype=np.int64))
        common = np.bitwise_count(own & y).sum(axis=1, dtype=np.int64)
        most, chance = np.minimum(n, n_y), n * n_y / BITS
        scores.append(float(np.max(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1))))
    return float(np.mean(scores))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _finished(rows: list[tuple], ranks: np.ndarray) -> list[list]:
    """Columns of ``_SCHEMA`` from rows (doc_id, text, fingerprint, next text, next fingerprint)."""
    edited = [_edited(text, following).encode() for _, text, _, following, _ in rows]
    prints = fingerprints(edited, ranks)
    text_of = lambda x: base64.b64encode(x).decode()
    return [
        [r[0] for r in rows],
        [len(r[1]) for r in rows],
        [hashlib.sha256(e).hexdigest() for e in edited],
        [text_of(r[2]) for r in rows],
        [text_of(p) for p in prints],
        [likeness(r[2], p) for r, p in zip(rows, prints, strict=True)],
        [likeness(r[2], r[4]) for r in rows],
    ]


def _in_order(ranks: np.ndarray, rows_at_once: int = 256):
    """Runs over a sorted partition: each row is finished by its successor; the first and last row come out too."""
    extra = [pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")] + ["kind", "part", "text", "print"]

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*_FIELDS, *extra], strict=True)], names=names)

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for got in batches:
            for a in range(0, got.num_rows, rows_at_once):
                ids = got.column(0).slice(a, rows_at_once).to_pylist()
                texts = [t or "" for t in got.column(1).slice(a, rows_at_once).to_pylist()]
                prints = fingerprints([t.encode() for t in texts], ranks)
                rows = list(zip(ids, texts, prints, strict=True))
                if last is None:
                    yield batch([[ids[0]], *[[None]] * 6, ["head"], [part], [texts[0]], [prints[0]]])
                pairs = list(zip([last, *rows][last is None :], rows[last is None :], strict=False))
                last = rows[-1]
                if pairs:
                    done = _finished([(*x, y[1], y[2]) for x, y in pairs], ranks)
                    n = len(pairs)
                    yield batch([*done, ["row"] * n, [part] * n, [None] * n, [None] * n])
        if last is not None:
            yield batch([[last[0]], *[[None]] * 6, ["tail"], [part], [last[1]], [last[2]]])

    return run


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropy levels by their counts over all windows of all texts (1001 numbers)."""

    def count(batches):
        total = np.zeros(LEVELS, dtype=np.int64)
        for b in batches:
            total += entropy_counts([(t or "").encode() for t in b.column(0).to_pylist()])
        level = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level, pa.int64()), pa.array(total[level], pa.int64())], names=["level", "n"])

    counts = np.zeros(LEVELS, dtype=np.int64)
    for r in docs.select(F.col("text").cast("string")).mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r["level"]] = r["n"]
    return rarity_ranks(counts)


def document_fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited text, and their likenesses: a row for each row of ``docs``.

    The edited text has the last half of the text replaced by the beginning of the next document's, in descending
    order of doc_id (equal ids by text; nulls last; the first follows the last). Documents are sorted once by
    range, so that the next one is the next row; only the last row of a partition waits for the
    head of the next partition. A null text is an empty text, whose fingerprint is empty; two empty fingerprints are alike.
    """
    ranks = corpus_ranks(docs) if ranks is None else ranks
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    made = cut_lineage(rows.mapInArrow(_in_order(ranks), f"{_SCHEMA}, kind string, part long, text string, print binary"))
    heads = made.where("kind = 'head'").select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("print").alias("next_print"))
    # One short row a partition: which one follows.
    every = Window.orderBy("part")
    ring = heads.select(F.col("after").alias("part"))
    ring = ring.select("part", F.lead("part").over(every).alias("after"), F.first("part").over(every).alias("first"))
    ring = ring.select("part", F.coalesce("after", "first").alias("after"))
    tails = made.where("kind = 'tail'").select("doc_id", "text", "print", "part").join(ring, "part").join(heads, "after")

    def finish(batches):
        for b in batches:
            if b.num_rows:
                done = _finished(list(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)), ranks)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, _FIELDS, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    last = tails.select("doc_id", "text", "print", "next_text", "next_print").mapInArrow(finish, _SCHEMA)
    return made.where("kind = 'row'").drop("kind", "part", "text", "print").unionByName(last)
