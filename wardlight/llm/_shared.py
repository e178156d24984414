"""Helpers that several document operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word rules of the contracts define it.
WHITE = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression class, and its complement.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own, or a temporary one where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wardlight-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, which is deleted when the application ends."""
    path = f"{shared_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores added until no column of ``taken`` has them (in any case of letters)."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever signs it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it without its history.

    Spark's cleaner deletes the shuffle files and checkpoints that nothing refers to any longer, but only once Python and the driver's JVM have
    collected what did. With a large heap that can be after the last step, so both are asked to here.
    """
    shared_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller on disk than a checkpoint where rows are many and short."""
    path = shared_path(df.sparkSession, "table")
    # Small row groups, which a writer holds whole beside what the task computes.
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``, so that a lambda does not repeat it."""
    return F.transform(F.array(value), body)[0]


def text_slices(column: pa.Array, max_bytes: int = 4 << 20):
    """Cut a string column into consecutive slices of about ``max_bytes`` (one row at least)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return
    ends = np.cumsum(np.asarray(_lengths(column), dtype=np.int64))
    start = 0
    while start < len(column):
        done = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, done + max_bytes, side="right")), start + 1)
        yield start, column.slice(start, stop - start)
        start = stop


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a slice as one array, and len + 1 offsets into it (null: empty)."""
    offsets = np.concatenate(([0], np.cumsum(_lengths(column), dtype=np.int64)))
    joined = b"".join(x.as_buffer() if x.is_valid else b"" for x in column.cast(pa.large_binary()))
    return np.frombuffer(joined, dtype=np.uint8), offsets


# ---------------------------------------------------------------- word hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[ord(c) for c in WHITE]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


#: Bytes that are hashed at a time; a longer text is taken in blocks, so that memory beside it stays bounded.
BLOCK = 4 << 20


def power_table(n: int, kind: str = "up") -> np.ndarray:
    """The first n powers of the hash base (or of its inverse) modulo 2**64; those of a block are kept."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= BLOCK + 4096:
            _powers[kind] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """len + 1 sums; the difference of two, times the inverse power of the first, is a substring's hash."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power_table(len(data)), out=sums[1:])
    return sums


def _word_blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK):
    """(start, stop) of consecutive blocks that no word crosses: they end before white space or at a text's end."""
    start = 0
    while len(data) - start > size:
        stop = start + size
        end = int(offsets[np.searchsorted(offsets, stop)])
        while stop < end:
            white = np.flatnonzero(_IS_SPACE[data[stop : min(stop + 65536, end)]])
            if len(white):
                stop += int(white[0])
                break
            stop = min(stop + 65536, end)
        yield start, stop
        start = stop
    yield start, len(data)


def words_of(data: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...] = ()):
    """Hashes, text number, start and end of every word (A-Z in lower case) in a slice of texts, in order.

    The hashes are a list: those of whole words, then for each of ``stems`` those of their first bytes.
    """
    found = [_block_words(data[a:b], a, offsets, stems) for a, b in _word_blocks(data, offsets)]
    hashes = [np.concatenate(x) for x in zip(*(f[0] for f in found), strict=True)]
    return hashes, *(np.concatenate(x) for x in zip(*(f[1:] for f in found), strict=True))


def _block_words(data: np.ndarray, at: int, offsets: np.ndarray, stems: tuple[int, ...]):
    data = _LOWER[data]
    inside = np.concatenate(([False], ~_IS_SPACE[data], [False]))
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    bounds = offsets[np.searchsorted(offsets, at, side="right") : np.searchsorted(offsets, at + len(data))] - at
    cut = bounds[inside[bounds] & inside[bounds + 1]]  # a word never crosses into the next text
    first[cut] = True
    last[cut] = True
    starts, ends = np.flatnonzero(first[: len(data)]), np.flatnonzero(last)
    sums, down = prefix_hash(data), power_table(len(data) + 1, "down")[starts]
    hashes = [mix64((sums[ends] - sums[starts]) * down + (ends - starts).astype(np.uint64))]
    for size in stems:
        hashes.append(mix64((sums[np.minimum(starts + size, ends)] - sums[starts]) * down + np.uint64(1000 + size)))
    owner = np.searchsorted(offsets, starts + at, side="right") - 1
    return hashes, owner, starts + at, ends + at


_WEIGHTS = mix64(np.arange(11, 16, dtype=np.uint64))


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct int64 hashes of its ``width``-word shingles.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    data, offsets = text_bytes(column)
    (hashes,), owner, _, _ = words_of(data, offsets)
    weights = np.resize(_WEIGHTS, width)
    n = max(len(hashes) - width + 1, 0)
    rolled = np.full(n, np.uint64(width))
    for i in range(width):
        rolled = rolled + hashes[i : i + n] * (weights[i] + np.uint64(2 * i + 1))
    rolled = mix64(rolled).view(np.int64)
    first = np.searchsorted(owner, np.arange(len(column) + 1))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            short = np.uint64(b - a)
            for i, h in enumerate(hashes[a:b]):
                with np.errstate(over="ignore"):
                    short = short + h * (weights[i] + np.uint64(2 * i + 1))
            out.append(mix64(np.array([short])).view(np.int64))
        else:
            out.append(np.empty(0, dtype=np.int64))
    return out
