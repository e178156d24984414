"""Packing of token sequences in bounded space.

A partition keeps a fixed number of open windows. A document's full-length pieces are sequences of
their own; its remainder goes into the window with the least room that is enough (best fit).
When no window has enough, the fullest is topped up with the head of the piece and emitted, and
the tail goes on. What is left open at the end of a partition is merged: the leftovers of some partitions
are laid end to end and cut at the sequence length, and the last piece of each merge at powers of
two. So every sequence is full or a power of two long.

Space is bounded by windows x length in a partition, and by that times ``fan`` in a merge.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut_lineage

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "slot", "ids"]
_TYPES = [pa.int64()] * 9 + [pa.binary()]
END_ID = 0
#: White space at a stretch from which tiktoken's pattern may run out of stack; such texts go to ``tokenizers``.
_LONG_SPACE = re.compile(r"\s{20000}")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: its own if it can be seen, else one after 255."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(others)}


@lru_cache(maxsize=4)
def encoder(path: str, ranks: str | None = None):
    """A function text -> uint32 ids for the byte-level BPE file of the library ``tokenizers`` at ``path``.

    ``ranks`` is a file of the same vocabulary for tiktoken, which gives the same ids several times as fast.
    Special strings in a text become their ids, as ``tokenizers`` does by default. A text with very much white space at a
    stretch always goes to ``tokenizers``, since tiktoken's pattern runs out of stack there.
    """

    @lru_cache(maxsize=1)
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def encode_whole(text: str) -> np.ndarray:
        return np.array(whole().encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if ranks is None:
        return encode_whole
    import json

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path) as f:
        described = json.load(f)
    special = {x["content"]: x["id"] for x in described["added_tokens"]}
    letters = _byte_letters()
    if {bytes(letters[c] for c in k): v for k, v in described["model"]["vocab"].items() if k not in special} != table:
        raise ValueError("the ranks are not those of the tokenizer's vocabulary")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
    names = set(special)

    def encode(text: str) -> np.ndarray:
        if len(text) >= 20_000 and _LONG_SPACE.search(text):
            return encode_whole(text)
        if any(x in text for x in names):
            return np.array(own.encode(text, allowed_special=names), dtype=np.uint32)
        return np.array(own.encode_ordinary(text), dtype=np.uint32)

    return encode


class Windows:
    """The open windows of one partition: pieces are (doc_id, start, doc_tokens, ids)."""

    def __init__(self, length: int, count: int, emit):
        self.length, self.emit = length, emit
        self.free = [(length, i) for i in range(count)]  # sorted by room, then number
        self.held: list[list] = [[] for _ in range(count)]

    def _put(self, at: int, piece) -> None:
        room, slot = self.free.pop(at)
        self.held[slot].append(piece)
        room -= len(piece[3])
        if room:
            bisect.insort(self.free, (room, slot))
        else:
            self.emit(self.held[slot])
            self.held[slot] = []
            bisect.insort(self.free, (self.length, slot))

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.length:
            self.emit([(doc_id, start, total, ids[start : start + self.length])])
            start += self.length
        while start < total:
            at = bisect.bisect_left(self.free, (total - start, -1))
            if at == len(self.free):
                at = 0  # none fits: fill the fullest
            stop = min(total, start + self.free[at][0])
            self._put(at, (doc_id, start, total, ids[start:stop]))
            start = stop

    def leftovers(self):
        return [(slot, pieces) for slot, pieces in enumerate(self.held) if pieces]


def _rows(pieces, sequence_id: int):
    offset = 0
    for doc_id, start, total, ids in pieces:
        raw = np.ascontiguousarray(ids, dtype="<u4").tobytes()
        yield (doc_id, start, len(ids), zlib.crc32(raw), total, sequence_id, offset, None, None, None)
        offset += len(ids)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _pack_partition(path: str, ranks: str | None, length: int, windows: int):
    def run(batches):
        encode, part = encoder(path, ranks), TaskContext.get().partitionId()
        rows: list[tuple] = []
        made = 0

        def emit(pieces) -> None:
            nonlocal made
            rows.extend(_rows(pieces, (part << 36) + made))
            made += 1

        open_windows = Windows(length, windows, emit)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                open_windows.add(doc_id, np.append(ids, np.uint32(END_ID)))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows.clear()
        for slot, pieces in open_windows.leftovers():
            for n, (doc_id, start, total, ids) in enumerate(pieces):
                rows.append((doc_id, start, len(ids), None, total, None, n, part, slot, np.ascontiguousarray(ids, dtype="<u4").tobytes()))
        if rows:
            yield _batch(rows)

    return run


def _merge(length: int):
    """Leftovers of one merge, end to end, into full sequences and then powers of two."""

    def run(key, table):
        table = table.sort_by([("part", "ascending"), ("slot", "ascending"), ("offset", "ascending")])
        left = int(np.sum(table.column("length").to_numpy())) if len(table) else 0
        made, base = 0, (1 << 62) + (int(key[0].as_py()) << 36)
        rows: list[tuple] = []
        pieces: list = []
        size = 0

        def goal() -> int:
            return length if left >= length else 1 << (left.bit_length() - 1)

        want = goal() if left else 0
        for doc_id, start, total, raw in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
            ids = np.frombuffer(raw, dtype="<u4")
            while len(ids):
                take = min(len(ids), want - size)
                pieces.append((doc_id, start, total, ids[:take]))
                ids, start, size = ids[take:], start + take, size + take
                if size == want:
                    rows.extend(_rows(pieces, base + made))
                    made, pieces, size, left = made + 1, [], 0, left - want
                    want = goal() if left else 0
        return pa.Table.from_batches([_batch(rows)]).select(_NAMES[:7])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, windows: int = 64, fan: int = 8, ranks: str | None = None) -> DataFrame:
    """The pieces (see ``PIECES``) of all texts, each followed by id 0, in sequences of at most ``length`` ids.

    Ids are those of ``tokenizers``; with ``ranks``, a file of the same vocabulary for tiktoken, they are had from there
    (see ``encoder``). Each id lies in exactly one piece. A null or empty text has its end id only. Repeated rows are packed each;
    a row without doc_id is packed under a null. Which documents share a sequence depends on how the table is
    split into partitions; the ids, their pieces' order in a document and the padding bound do not.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = cut_lineage(texts.mapInArrow(_pack_partition(tokenizer, ranks, length, windows), f"{PIECES}, part long, slot long, ids binary"))
    merged = (
        made.where("ids is not null")
        .withColumn("merge", F.floor(F.col("part") / fan))
        .groupBy("merge")
        .applyInArrow(_merge(length), PIECES)
    )
    return made.where("ids is null").drop("part", "slot", "ids").unionByName(merged)
