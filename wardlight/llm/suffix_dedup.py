"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte is removed if some 100-byte string over it also starts earlier (smaller doc_id, or further up in the
same document). Sorting every suffix of a corpus would move each text a hundred times, so the suffix array is
sparse: of the 69 strings of 32 bytes in a 100-byte window, the one with the least hash is the window's anchor.
Equal windows have equal anchors at the same place in them, so it is enough to sort one suffix for
each run of windows with the same anchor, here a *strip*: the bytes from the anchor to the end of its last window,
then those from its first window up to the anchor.

1. Anchors that occur once are ruled out by counting their hashes (map-side combined, so a frequent
   anchor costs a row a batch). Only strips with a repeated anchor go on.
2. Each batch of texts sorts its strips into one run a bucket of anchors, drops strips it has
   twice (all but the first are removed text), front-codes the run, and the runs are exchanged.
3. A bucket's runs are merged by a loser tree that keeps the common prefix of every loser with the last winner
   and never compares those bytes again. Equal strips come out side by side. Different strips with the same
   anchor also come out together; their windows are compared one by one.
4. The strips of an anchor that is too frequent for one bucket are cut into their windows, which are strings of
   the same runs but of buckets by their own hash: so the anchor is spread, and equal windows still meet in one merge.

The removed spans of a document are merged, and its text is read once more to cut them out.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _BYTE, BLOCK, mix64, power_table, prefix_hash, text_bytes, text_slices, written

LENGTH = 100
ANCHOR = 32
_NO_ID = (1 << 63) - 1


# ------------------------------------------------------------------- strips


def _leftmost_least(keys: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        keys = np.minimum(keys[:-step], keys[step:])
        done += step
    return keys


def strips(data: np.ndarray, offsets: np.ndarray):
    """(text number, first window, last window, anchor, anchor hash) of every strip in joined texts.

    Positions count from the start of ``data``. Long data is taken in blocks of windows; a strip
    that goes over the end of a block comes as two.
    """
    parts = [_block_strips(data[at : at + BLOCK + LENGTH - 1], at, offsets) for at in range(0, max(len(data), 1), BLOCK)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _block_strips(data: np.ndarray, start: int, offsets: np.ndarray):
    n = len(data) - LENGTH + 1
    empty = np.empty(0, dtype=np.int64)
    if n <= 0:
        return empty, empty, empty, empty, empty.view(np.uint64)
    sums, m = prefix_hash(data), len(data) - ANCHOR + 1
    hashes = mix64((sums[ANCHOR:] - sums[:m]) * power_table(m, "down"))
    keys = (hashes >> np.uint64(34)).astype(np.int64) << 31 | np.arange(m, dtype=np.int64)
    anchor = _leftmost_least(keys, LENGTH - ANCHOR + 1) & ((1 << 31) - 1)
    owner = np.searchsorted(offsets, np.arange(start, start + n), side="right") - 1
    inside = np.arange(start, start + n) + LENGTH <= offsets[owner + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty, empty, empty, empty, empty.view(np.uint64)
    new = np.concatenate(([True], (anchor[at[1:]] != anchor[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])))
    first = at[new]
    last = at[np.concatenate((np.flatnonzero(new)[1:], [len(at)])) - 1]
    return owner[first], first + start, last + start, anchor[first] + start, hashes[anchor[first]]


def short_hash(hashes: np.ndarray) -> np.ndarray:
    """48 bits of an anchor's hash. Two anchors that share them only cost a comparison of their strips."""
    return (hashes >> np.uint64(16)).view(np.int64)


def bucket_of(short: np.ndarray, buckets: int) -> np.ndarray:
    return (short >> 4) % buckets


def _six_bytes(short: np.ndarray) -> bytes:
    return np.ascontiguousarray(short.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(blobs) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 6)
    return np.concatenate((raw, np.zeros((len(raw), 2), dtype=np.uint8)), axis=1).view("<i8").reshape(-1).astype(np.int64)


# ------------------------------------------------- 1. which anchors are repeated


def _parts(batches, small: int = 2 << 20, large: int = 16 << 20):
    """Slices of a few megabytes, and with each whether enough has come for a run (or no more comes)."""
    size, held = 0, None
    for batch in batches:
        for start, part in text_slices(batch.column("text"), small):
            if held is not None:
                yield *held, size >= large
                size = 0 if size >= large else size
            held = (batch.slice(start, len(part)), part)
            size += part.nbytes
    if held is not None:
        yield *held, True


def _ask(buckets: int):
    """For each run of texts and bucket: anchors seen once with their text, and those seen more often.

    The texts of the latter need no answer; they are sent along to any bucket.
    """

    def rows_of(ids: np.ndarray, keys: np.ndarray, owner: np.ndarray, short: np.ndarray):
        order = np.argsort(short, kind="stable")
        owner, short = owner[order], short[order]
        head = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
        times = np.diff(np.concatenate((head, [len(short)])))
        often, counts = head[times > 1], times[times > 1]
        known = np.ones(len(short), dtype=bool)
        known[head[times == 1]] = False
        for kind, at in ((0, np.flatnonzero(~known)), (1, often), (2, np.flatnonzero(known))):
            place = owner[at] % buckets if kind == 2 else bucket_of(short[at], buckets)
            by = np.lexsort((owner[at], place))
            edge = np.searchsorted(place[by], np.arange(buckets + 1))
            for b in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                pick = by[edge[b] : edge[b + 1]]
                mine = at[pick]
                if kind == 1:
                    texts = (b"", b"", b"", counts[pick].tobytes())
                else:
                    own, index = np.unique(owner[mine], return_inverse=True)
                    texts = (ids[own].tobytes(), keys[own].tobytes(), index.astype(np.uint32).tobytes(), b"")
                yield (b, kind, _six_bytes(short[mine]), *texts)

    def run(batches):
        held: list[tuple] = []
        before = 0
        for batch, part, full in _parts(batches):
            owner, _, _, _, hashes = strips(*text_bytes(part))
            held.append((_longs(batch, "_id"), _longs(batch, "_key"), owner + before, short_hash(hashes)))
            before += batch.num_rows
            if full:
                joined = [np.concatenate(x) for x in zip(*held, strict=True)]
                held.clear()
                before = 0
                if len(joined[2]):
                    yield _arrow(list(rows_of(*joined)), _ASK)

    return run


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


_ASK = {"bucket": pa.int64(), "kind": pa.int64(), "hashes": pa.binary(), "ids": pa.binary(), "keys": pa.binary(), "texts": pa.binary(), "counts": pa.binary()}
_ANSWER = {"_id": pa.int64(), "_key": pa.int64(), "anchors": pa.list_(pa.int64()), "hot": pa.bool_()}


def _arrow(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


def _ddl(schema: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{k} {names[v]}" for k, v in schema.items())


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _answer(most: int):
    """Texts with their repeated anchors, and the anchors that occur more than ``most`` times."""

    def owners(part) -> tuple[np.ndarray, np.ndarray]:
        ids, keys = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for row in zip(*(part.column(c).to_pylist() for c in ("ids", "keys", "texts")), strict=True):
            at = np.frombuffer(row[2], dtype=np.uint32)
            ids.append(np.frombuffer(row[0], dtype=np.int64)[at])
            keys.append(np.frombuffer(row[1], dtype=np.int64)[at])
        return np.concatenate(ids), np.concatenate(keys)

    def run(key, table):
        part = {k: table.filter(pc.equal(table.column("kind"), k)) for k in (0, 1, 2)}
        once, often, known = (_from_six(part[k].column("hashes").to_pylist()) for k in (0, 1, 2))
        every = np.concatenate((once, often))
        times = np.concatenate((np.ones(len(once), dtype=np.int64), _joined(part[1].column("counts"), np.int64)))
        values, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, weights=times, minlength=len(values)).astype(np.int64)
        yes = total[place[: len(once)]] > 1
        (ids_0, keys_0), (ids_2, keys_2) = owners(part[0]), owners(part[2])
        hashes = np.concatenate((once[yes], known))
        ids, keys = np.concatenate((ids_0[yes], ids_2)), np.concatenate((keys_0[yes], keys_2))
        order = np.lexsort((hashes, keys, ids))
        ids, keys, hashes = ids[order], keys[order], hashes[order]
        rows = []
        if len(ids):
            head = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))))
            for a, b in zip(head, [*head[1:], len(ids)], strict=True):
                rows.append((int(ids[a]), int(keys[a]), np.unique(hashes[a:b]), False))
        hot = values[total > most]
        if len(hot):
            rows.append((None, None, hot, True))
        return pa.Table.from_batches([_arrow(rows, _ANSWER)])

    return run


# ------------------------------------------------------- 2. sorted, front-coded runs

_RUN = {
    "bucket": pa.int64(),
    "kind": pa.int64(),  # 0: a run, 1: spans
    "ids": pa.binary(),
    "keys": pa.binary(),
    "starts": pa.binary(),
    "stops": pa.binary(),
    "shared": pa.binary(),
    "lengths": pa.binary(),
    "lefts": pa.binary(),
    "rests": pa.binary(),
}
_FOUND = {"_id": pa.int64(), "_key": pa.int64(), "start": pa.int64(), "stop": pa.int64()}


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known already."""
    most = min(len(a), len(b))
    while known < most:
        x, y = a[known : known + 32], b[known : known + 32]
        if x == y:
            known += len(x)
            continue
        n = min(len(x), len(y))
        differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
        return known + n - (differ.bit_length() + 7) // 8
    return most


def front_code(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Of sorted strings: bytes shared with the one before, and the rest of each."""
    shared = np.zeros(len(strings), dtype=np.uint8)
    rests, before = [], b""
    for i, s in enumerate(strings):
        h = common_prefix(before, s)
        shared[i] = h
        rests.append(s[h:])
        before = s
    return shared, rests


def _squeezed(raw: bytes) -> bytes:
    return pa.Codec("zstd").compress(raw, asbytes=True)


def _run_row(bucket: int, kept: list[tuple]) -> tuple:
    """A run of sorted (string, left, id, key, start)."""
    shared, rests = front_code([e[0] for e in kept])
    return (bucket, 0, *_packed([e[2:] for e in kept]), b"", shared.tobytes(), bytes(len(e[0]) for e in kept), bytes(e[1] for e in kept), _squeezed(b"".join(rests)))


def _span_rows(spans: list[tuple], first: int, count: int):
    """Spans that are found, to any of the ``count`` buckets from ``first`` on."""
    spans = merged_places(spans)
    for i in range(0, len(spans), 20_000):
        some = spans[i : i + 20_000]
        yield (first + (some[0][0] + i) % count, 1, *_packed([s[:3] for s in some]), np.array([s[3] for s in some], dtype=np.int64).tobytes(), b"", b"", b"", b"")


#: In place of the left part's length: the string is one window of a hot anchor.
_WINDOW = 255


def _runs(buckets: int, width: int = 1):
    """Runs by bucket, or by ``width`` neighbouring buckets together."""

    def gather(entries: dict[int, list], batch: pa.RecordBatch, part: pa.Array) -> None:
        ids, keys = batch.column("_id").to_pylist(), batch.column("_key").to_pylist()
        data, offsets = text_bytes(part)
        owner, first, last, anchor, hashes = strips(data, offsets)
        edge = np.searchsorted(owner, np.arange(len(part) + 1))
        short = short_hash(hashes)
        among = lambda c: [np.isin(short[a:b], w.values.to_numpy()) if w.is_valid else np.zeros(b - a, dtype=bool) for a, b, w in zip(edge[:-1], edge[1:], batch.column(c), strict=True)]
        pick, hot = np.flatnonzero(np.concatenate(among("anchors"))), np.concatenate(among("hot"))
        raw = data.tobytes()
        columns = (first[pick], last[pick] + LENGTH, anchor[pick], owner[pick], bucket_of(short[pick], buckets) // width, hot[pick])
        for p, q, a, o, b, h in zip(*(c.tolist() for c in columns), strict=True):
            if not h:
                entries.setdefault(b, []).append((raw[a:q] + raw[p:a], a - p, ids[o], keys[o], p - int(offsets[o])))
                continue
            for i in range(p, q - LENGTH + 1):
                window = raw[i : i + LENGTH]
                entries.setdefault(zlib.crc32(window) % buckets // width, []).append((window, _WINDOW, ids[o], keys[o], i - int(offsets[o])))

    def rows_of(entries: dict[int, list]):
        spans = []
        for b, own in entries.items():
            own.sort()
            kept = []
            for e in own:
                if kept and kept[-1][:2] == e[:2]:
                    if kept[-1][2:] != e[2:]:  # else the same row twice
                        spans.append((*e[2:], e[4] + len(e[0])))
                else:
                    kept.append(e)
            yield _run_row(b, kept)
        yield from _span_rows(spans, 0, -(-buckets // width))

    def run(batches):
        entries: dict[int, list] = {}
        for batch, part, full in _parts(batches):
            gather(entries, batch, part)
            if full:
                rows = list(rows_of(entries))
                entries.clear()
                if rows:
                    yield _arrow(rows, _RUN)

    return run


def merged_places(spans: list[tuple]) -> list[tuple]:
    """(id, key, start, stop) with those of one document that meet or overlap made one."""
    out: list[tuple] = []
    for doc, key, start, stop in sorted(spans):
        if out and out[-1][:2] == (doc, key) and start <= out[-1][3]:
            out[-1] = (doc, key, out[-1][2], max(stop, out[-1][3]))
        else:
            out.append((doc, key, start, stop))
    return out


def _packed(places: list[tuple]) -> tuple[bytes, bytes, bytes]:
    three = np.array(places, dtype=np.int64).reshape(-1, 3)
    return three[:, 0].tobytes(), three[:, 1].astype(np.int32).tobytes(), three[:, 2].astype(np.int32).tobytes()


def _places(row: dict) -> list[list[int]]:
    """ids, keys and starts as ``_packed`` made them."""
    return [np.frombuffer(row[k], dtype=t).tolist() for k, t in (("ids", np.int64), ("keys", np.int32), ("starts", np.int32))]


# ------------------------------------------------------------ 3. merging the runs


class Run:
    """A front-coded run; ``string``, ``shared`` (with the one before) and ``place`` are those of its head."""

    __slots__ = ("place", "shared", "string", "_rows")

    def __init__(self, rows):
        self._rows, self.string, self.shared, self.place = iter(rows), b"", -1, None
        self.step()

    def step(self) -> None:
        got = next(self._rows, None)
        if got is None:
            self.string, self.shared, self.place = None, -1, None
        else:
            self.shared, rest, self.place = got
            self.string = self.string[: self.shared] + rest


class LoserTree:
    """Merges sorted runs of byte strings; yields (bytes shared with the last one, string, place).

    Every run's head has in ``shared`` its common prefix with the last string that passed its node. Of two heads, the one
    that shares more is smaller, with nothing compared; if they share the same, comparing begins after that.
    """

    def __init__(self, runs: list[Run]):
        size = 1 << max(0, (len(runs) - 1).bit_length())
        self.runs = [*runs, *(Run([]) for _ in range(size - len(runs)))]
        for r in self.runs:
            r.shared = min(r.shared, 0)
        self.size, self.losers = size, [0] * size
        winners = [*[0] * size, *range(size)]
        for node in range(size - 1, 0, -1):
            winners[node], self.losers[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if size > 1 else 0

    def _play(self, i: int, j: int) -> tuple[int, int]:
        a, b = self.runs[i], self.runs[j]
        if a.shared != b.shared:
            return (i, j) if a.shared > b.shared else (j, i)
        if a.string is None:
            return i, j
        x, y = a.string, b.string
        h = common_prefix(x, y, a.shared)
        if (len(x), i) <= (len(y), j) if h == min(len(x), len(y)) else x[h] < y[h]:
            b.shared = h
            return i, j
        a.shared = h
        return j, i

    def __iter__(self):
        while (run := self.runs[self.winner]).string is not None:
            yield run.shared, run.string, run.place
            run.step()
            at, node = self.winner, (self.winner + self.size) // 2
            while node:
                at, self.losers[node] = self._play(at, self.losers[node])
                node //= 2
            self.winner = at


def _unpack(row: dict) -> Run:
    places = [np.frombuffer(row[k], dtype=t) for k, t in (("ids", np.int64), ("keys", np.int32), ("starts", np.int32))]
    shared, lengths = row["shared"], row["lengths"]
    rests = pa.Codec("zstd").decompress(row["rests"], sum(lengths) - sum(shared), asbytes=True)

    def rows():
        at = 0
        for h, n, left, *place in zip(shared, lengths, row["lefts"], *places, strict=True):
            yield h, rests[at : at + n - h], (left, *map(int, place))
            at += n - h

    return Run(rows())


def _same_anchor(group: list[tuple[bytes, tuple]], found: list) -> None:
    """Windows of different strips with one anchor: all but the first place of each string are removed.

    Equal windows have their anchor at the same distance from their start, so only those of one distance are compared,
    and a dictionary holds the windows of one distance at a time.
    """
    group = [x for x in group if x[1][0] != _WINDOW]
    if len(group) < 2:
        return
    texts = [(string[len(string) - left :] + string[: len(string) - left], left, (doc, key, start)) for string, (left, doc, key, start) in group]
    gone: list[list[int]] = [[] for _ in texts]
    for before in range(LENGTH - ANCHOR + 1):  # bytes of the window before the anchor
        first: dict[bytes, tuple] = {}
        own = []
        for n, (text, left, (doc, key, start)) in enumerate(texts):
            i = left - before
            if 0 <= i <= len(text) - LENGTH:
                window, place = text[i : i + LENGTH], (doc, key, start + i)
                own.append((n, i, window, place))
                if (was := first.get(window)) is None or place < was:
                    first[window] = place
        if len(first) < len(own):
            for n, i, window, place in own:
                if first[window] < place:
                    gone[n].append(i)
    for (_, _, (doc, key, start)), at in zip(texts, gone, strict=True):
        for i in sorted(at):
            if found and found[-1][:2] == (doc, key) and found[-1][2] <= start + i <= found[-1][3]:
                found[-1] = (doc, key, found[-1][2], max(found[-1][3], start + i + LENGTH))
            else:
                found.append((doc, key, start + i, start + i + LENGTH))


def _strings(table, found: list[tuple]) -> list[Run]:
    """The runs of a group's rows; the spans that its rows carry go to ``found``."""
    runs: list[Run] = []
    for row in (x for b in table.to_batches(max_chunksize=64) for x in b.to_pylist()):
        if row["kind"] == 0:
            runs.append(_unpack(row))
        else:
            found += zip(*_places(row), np.frombuffer(row["stops"], dtype=np.int64).tolist(), strict=True)
    return runs


def _buckets_of(strings: list[bytes], lefts: list[int], buckets: int) -> np.ndarray:
    """The bucket of each string of a run: that of its anchor, its first bytes, or of the whole window."""
    first = np.frombuffer(b"".join(x[:ANCHOR] for x in strings), dtype=np.uint8).reshape(-1, ANCHOR)
    hashes = mix64((_BYTE[first] * power_table(ANCHOR)[None, :]).sum(axis=1, dtype=np.uint64))
    out = bucket_of(short_hash(hashes), buckets)
    for i in np.flatnonzero(np.array(lefts) == _WINDOW):
        out[i] = zlib.crc32(strings[i]) % buckets
    return out


def _longer(buckets: int, width: int):
    """The runs that some tasks have of ``width`` neighbouring buckets, as one run for each bucket, without strings that come again."""

    def run(key, table):
        found: list[tuple] = []
        runs = _strings(table, found)
        kept: list[tuple] = []  # string, left, id, key, start
        seen: dict[int, int] = {}  # among those equal to the last string: by length of the left part
        for shared, string, place in LoserTree(runs) if runs else ():
            if kept and not shared == len(string) == len(kept[-1][0]):
                seen.clear()
            if (at := seen.get(place[0])) is None:
                seen[place[0]] = len(kept)
                kept.append((string, *place))
            else:
                one, two = sorted((kept[at][1:], place), key=lambda x: x[1:])
                kept[at] = (string, *one)
                if one[1:] != two[1:]:
                    found.append((*two[1:], two[3] + len(string)))
        own = _buckets_of([e[0] for e in kept], [e[1] for e in kept], buckets) if kept else np.empty(0, dtype=np.int64)
        order = np.argsort(own, kind="stable")
        rows = [_run_row(int(own[part[0]]), [kept[i] for i in part.tolist()]) for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(part)]
        first = int(key[-1].as_py()) * width
        rows += _span_rows(found, first, min(width, buckets - first))
        return pa.Table.from_batches([_arrow(rows, _RUN)])

    return run


def _merged():
    """Spans found by merging a bucket's runs, and those that its rows carry."""

    def run(key, table):
        found: list[tuple] = []
        runs = _strings(table, found)
        group: list[tuple[bytes, tuple]] = []  # distinct strips of one anchor, each with its first place
        seen: dict[int, int] = {}  # among those equal to the last string: by length of the left part
        for shared, string, place in LoserTree(runs) if runs else ():
            if shared < ANCHOR:
                if len(group) > 1:
                    _same_anchor(group, found)
                group.clear()
                seen.clear()
            elif group and not shared == len(string) == len(group[-1][0]):
                seen.clear()
                if group[-1][1][0] == _WINDOW:
                    group.pop()  # a window meets its equals only
            if (at := seen.get(place[0])) is None:
                seen[place[0]] = len(group)
                group.append((string, place))
            else:
                one, two = sorted((group[at][1], place), key=lambda x: x[1:])
                group[at] = (string, one)
                if one[1:] != two[1:]:
                    found.append((*two[1:], two[3] + len(string)))
        if len(group) > 1:
            _same_anchor(group, found)
        return pa.Table.from_batches([_arrow(merged_places(found), _FOUND)])

    return run


# ---------------------------------------------------------------- the operator


def _cut(with_bytes: bool):
    names = {"_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    names |= {"kept": pa.binary()} if with_bytes else {}

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch.column("_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, at, removed, runs = [], 0, 0, 0
                for start, stop in merge_spans([(s["start"], s["stop"]) for s in spans or ()]):
                    kept.append(raw[at:start])
                    removed, runs, at = removed + stop - start, runs + 1, stop
                rest = b"".join([*kept, raw[at:]]) if spans else raw
                rows.append((doc, len(raw), removed, runs, hashlib.sha256(rest).hexdigest(), *[rest] * with_bytes))
            yield _arrow(rows, names)

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans sorted, with those that meet or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


#: Buckets up to which every run goes to every bucket at once.
DIRECT = 256


def removed_spans(keyed: DataFrame, bucket_bytes: int = 16 << 20, most: int = 50_000, most_broadcast: int = 1_000_000, direct: int = DIRECT) -> DataFrame:
    """(_id, _key, start, stop): byte spans to remove, which may overlap.

    Runs are of a fixed size, so that with more text there are more runs and more buckets, and their product would grow with the square. Beyond ``direct`` buckets they are
    exchanged in two levels: first the square root of the runs (a lane) meets for the square root of the buckets, is merged to longer runs without strings that come again, and these go to their
    buckets. So rows grow with the power 1.5 of the text at most and hold many strings each, and a string that every run has comes to its bucket once a lane.

    A bucket has the strips of about ``bucket_bytes`` of text; an anchor that occurs more than ``most`` times is spread by
    its windows. Which anchors these are (at most strips / ``most``) is sent to every task while they are few, and
    joined by a shuffle beyond ``most_broadcast``.
    """
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, math.ceil(size / bucket_bytes))
    # Counting takes less memory a strip than merging does, and fewer buckets leave fewer rows a text.
    counted = max(8, buckets // 4)
    answers = written(keyed.mapInArrow(_ask(counted), _ddl(_ASK)).groupBy("bucket").applyInArrow(_answer(most), _ddl(_ANSWER)))
    texts = answers.where("not hot")
    anchors = texts.groupBy("_id", "_key").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))
    hot = answers.where("hot").select(F.explode("anchors").alias("anchor"))
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= most_broadcast else hot
        tagged = texts.select("_id", "_key", F.explode("anchors").alias("anchor")).join(hot, "anchor").groupBy("_id", "_key").agg(F.collect_set("anchor").alias("hot"))
        anchors = anchors.join(tagged, ["_id", "_key"], "left")
    else:
        anchors = anchors.withColumn("hot", F.lit(None).cast("array<long>"))
    listed = keyed.join(anchors, ["_id", "_key"])
    if buckets <= direct:
        runs = listed.mapInArrow(_runs(buckets), _ddl(_RUN))
    else:
        width = math.isqrt(buckets - 1) + 1
        lanes = math.isqrt(max(1, size // (16 << 20))) + 1
        first = listed.mapInArrow(_runs(buckets, width), _ddl(_RUN)).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)).cast("long"))
        runs = first.groupBy("lane", "bucket").applyInArrow(_longer(buckets, width), _ddl(_RUN))
    return runs.groupBy("bucket").applyInArrow(_merged(), _ddl(_FOUND))


def suffix_dedup(docs: DataFrame, bucket_bytes: int = 16 << 20, most: int = 50_000, with_bytes: bool = False, direct: int = DIRECT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs``; with ``with_bytes`` also the kept bytes.

    What is left need not be valid UTF-8, since a repeated string may begin or end inside a character. A null text counts
    as empty. A row without doc_id (or with the largest long) comes after all others; rows that repeat a doc_id with the same
    text are one place and keep the same bytes, with other texts they are ordered by the text's hash.
    """
    # The same three columns go into both joins below, so that Spark moves the texts once and reuses the exchange.
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"),
        F.hash(F.col("text").cast("string")).cast("long").alias("_key"),
        F.col("text").cast("string").alias("text"),
    )
    spans = removed_spans(keyed, bucket_bytes, most, direct=direct).groupBy("_id", "_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    out = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    made = keyed.join(spans, ["_id", "_key"], "left").select("_id", "text", "spans").mapInArrow(_cut(with_bytes), out)
    doc_id = F.when(F.col("_id") != _NO_ID, F.col("_id")).alias("doc_id")
    return made.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes)
