"""Exact token counts at every prefix of a text, by dynamic programming over a BPE vocabulary.

The encoding of a prefix ends in exactly one token, and a token can follow another if and only if the two
together encode to themselves. So the count at a prefix is one more than the count at the prefix that its last
token leaves, and that token is the one in the vocabulary that ends there and can follow what
ends before it. The counts of all prefixes of a text come out of one pass, without
encoding any of them.

They are stored as *steps*: one signed byte a character, by which the count changes when the text grows by it. Running
sums of the steps are the counts, so truncation and budget questions need neither the text nor another encoding.

Pieces of the model never go on after a word's end (a space begins a new piece, a line break is a byte of its own),
so the programme runs once for each word: the pieces of the vocabulary are a trie with failure links, which finds those that
end at each character, and only the states that a piece can reach back to are held. The steps of short words are kept, a
bounded number of them; a longer one (a text without spaces, a minified line) is passed in the same way.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters of the longest unit whose steps are kept.
SHORT = 32
#: A word with the spaces before it; a line break, with the word right after it; spaces at the end.
_UNITS = re.compile(r"\n[^ \n]*| *[^ \n]+| +")


class _Row(dict):
    """Of a piece: for those met after it, whether they can follow."""

    __slots__ = ("token",)

    def __init__(self, token: str):
        super().__init__()
        self.token = token


class PrefixCounter:
    """Counts at prefixes for the sentencepiece BPE model at ``path``; the steps of at most ``most`` short words are kept."""

    def __init__(self, path: str, most: int = 500_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in score):
            raise ValueError("pieces of this model go on after a word's end")
        order = {value: i for i, value in enumerate(sorted({s for p, s in score.items() if len(p) > 1}, reverse=True))}
        #: When a piece is merged; single characters are there from the start.
        self.rank = {p: order[s] if len(p) > 1 else -1 for p, s in score.items()}
        tied = Counter(r for r in self.rank.values() if r >= 0)
        if any(tied[r] > 1 and p.strip(SPACE) for p, r in self.rank.items()):
            raise ValueError("merges of this model are not strictly ordered")
        self.longest = max(map(len, score))
        self.ring = 1 << self.longest.bit_length()
        #: Finds the pieces that end at each character, the longest first.
        self.pieces = ahocorasick.Automaton()
        rows = {p: _Row(p) for p in score}
        for p, row in rows.items():
            self.pieces.add_word(p, (len(p), row))
        self.pieces.make_automaton()
        self.most, self.met = most, 0
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.start = _Row("")
        self.steps = _Steps(self)

    def merge(self, parts: list[str]) -> tuple[str, str] | None:
        """Plain BPE in place, the leftmost among equals first; the last pair that was merged."""
        last = None
        while len(parts) > 1:
            rank, at = min((self.rank.get(a + b, len(self.rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.rank):
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return last

    def split(self, token: str) -> tuple[str, str] | None:
        """The last merge of a piece of two characters or more; None if plain BPE does not arrive at it."""
        if token not in self.halves:
            parts = list(token)
            last = self.merge(parts)
            self.halves[token] = last if len(parts) == 1 else None
        return self.halves[token]

    def can_follow(self, a: str, b: str) -> bool:
        """Whether piece ``b`` stays whole after ``a`` ('': at the start or after a byte).

        Both are taken apart, the later merge first. The boundary would not have lasted if the pieces that met
        there could merge before the one that was taken apart was made.
        """
        rank = self.rank
        if rank[b] >= 0 and self.split(b) is None:
            return False
        if not a:
            return True
        if not b.strip(SPACE):  # runs of spaces have equal ranks
            parts = list(a + b)
            self.merge(parts)
            return parts == [a, b]
        limit = len(rank)
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit = rank[a]
                a = self.split(a)[1]
            elif rank[b] >= 0:
                limit = rank[b] + 1  # of two equal merges the left one comes first
                b = self.split(b)[0]
            else:
                return True

    def walk(self, unit: str) -> bytearray:
        """The steps of a unit of any length, ' ' written as the piece space; keeps ``ring`` states."""
        start, mask = self.start, self.ring - 1
        counts, rows = [0] * self.ring, [start] * self.ring  # the state of the first n characters is at n & mask
        steps, done, now = bytearray(), 0, 0
        for last, (size, row) in self.pieces.iter(unit):
            if last < done:
                continue
            while last > done:
                done, now = self._spelled(unit, done, now, steps, counts, rows)
            at = (last + 1 - size) & mask
            before = rows[at]
            token = row.token
            ok = before.get(token)
            if ok is None:
                before[token] = ok = self._asked(before.token, token)
            if ok:
                count = counts[at] + 1
                steps.append((count - now) & 255)
                done, now = last + 1, count
                counts[done & mask], rows[done & mask] = count, row
        while done < len(unit):
            done, now = self._spelled(unit, done, now, steps, counts, rows)
        return steps

    def _asked(self, before: str, token: str) -> bool:
        self.met += 1
        if self.met > self.most:
            self.met = 0
            for _, row in self.pieces.values():
                row.clear()
            self.start.clear()
        return self.can_follow(before, token)

    def _spelled(self, unit: str, done: int, now: int, steps: bytearray, counts: list, rows: list) -> tuple[int, int]:
        """A character outside the vocabulary: it is spelled in bytes, which never merge."""
        size = len(unit[done].encode())
        steps.append(size)
        done, now = done + 1, now + size
        counts[done & (self.ring - 1)], rows[done & (self.ring - 1)] = now, self.start
        return done, now

    def store(self, text: str) -> np.ndarray:
        """The steps of a text: by how much each character changes the token count."""
        if not text:
            return np.empty(0, dtype=np.int8)
        text = text.replace(SPACE, " ")
        found = (m.group() for m in _UNITS.finditer(" " + text)) if len(text) > 1 << 20 else iter(_UNITS.findall(" " + text))
        parts = []
        while part := b"".join(map(self.steps.__getitem__, islice(found, 1 << 16))):
            parts.append(part)
        steps = np.frombuffer(b"".join(parts), dtype=np.int8)
        first = steps[1] + steps[0]  # the space that the model puts in front is no character of the text
        return np.concatenate(([first], steps[2:])).astype(np.int8)


def counts(steps: np.ndarray) -> np.ndarray:
    """The token count of every prefix, the empty one first."""
    return np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))


def longest_prefix(steps: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    within = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


class _Steps(dict):
    """Steps of a unit as ``_UNITS`` gives it, one signed byte a character."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.counter.most:
            self.clear()
        broken = unit[0] == "\n"  # a line break is one byte, and what follows begins anew
        steps = b"\x01" * broken + self.counter.walk(unit[broken:].replace(" ", SPACE))
        steps = bytes(steps)
        if len(unit) <= SHORT:
            self[unit] = steps
        return steps


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter a worker process, so that tasks share its trie."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, store: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, chars_in_limit, prefix_steps): a row for each row of ``docs``.

    ``chars_in_limit`` is the length of the longest prefix that has at most ``limit`` tokens. ``prefix_steps`` (left out
    without ``store``) has a signed byte for each character, by which it changes the count; ``tokens_at`` reads it.
    A null text counts as empty, with no tokens; repeated rows and null doc_ids are counted each.
    """

    def run(batches):
        own = counter(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n_bytes, n_tokens, chars, stored = [], [], [], []
                for text in part.column(1):
                    text = text.as_py() or ""
                    steps = own.store(text)
                    n_bytes.append(len(text.encode()))
                    n_tokens.append(int(steps.sum(dtype=np.int64)))
                    chars.append(len(text) if n_tokens[-1] <= limit else longest_prefix(steps, limit))
                    if store:
                        stored.append(steps.tobytes())
                columns = [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(chars, pa.int64())]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_in_limit"]
                if store:
                    columns.append(pa.array(stored, pa.binary()))
                    names.append("prefix_steps")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_in_limit long" + ", prefix_steps binary" * store
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def tokens_at(steps: Column, chars: Column | int) -> Column:
    """The token count of a text's first ``chars`` characters, from its stored steps."""
    chars = F.lit(chars) if isinstance(chars, int) else chars
    upto = F.hex(F.substring(steps, F.lit(1), chars.cast("int")))
    value = lambda i: F.conv(F.substring(upto, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    signed = F.transform(F.sequence(F.lit(0), (F.length(upto) / 2).cast("int") - 1), lambda i: F.when(value(i) > 127, value(i) - 256).otherwise(value(i)))
    return F.when((chars > 0) & (F.length(upto) > 0), F.aggregate(signed, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long")
