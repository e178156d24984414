"""Token counts, packing, fingerprints and mixing against the libraries and brute force."""

import base64
import collections
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import fingerprints as fp
from wardlight.llm import token_counts as tc
from wardlight.llm.mixing import leaf_budgets, mix
from wardlight.llm.packing import encoder, pack
from wardlight.llm.token_counts import PrefixCounter, token_counts

from .conftest import ODD, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_prefix_counts_are_the_library_s():
    import sentencepiece

    model, own, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), PrefixCounter(PIECES, most=500), random.Random(1)
    parts = ["a", "e", "th", "er", " ", "  ", "\n", " \n", "▁", "é", "日本", "\t", "\r", "0", "<s>", "the ", "😀", "\x00", "EDTH", "***"]
    for _ in range(600):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        want = [len(model.encode(text[:i])) for i in range(len(text) + 1)]
        steps = own.store(text)
        assert tc.counts(steps).tolist() == want
        for budget in (0, 1, 4):
            assert tc.longest_prefix(steps, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_pairs_that_can_follow_are_those_of_plain_encoding():
    own, r = PrefixCounter(PIECES), random.Random(2)
    pieces = [p for p in own.rank if len(p) > 1]
    runs = [p for p in pieces if not p.strip("▁")]
    pairs = [(r.choice(pieces), r.choice(pieces)) for _ in range(3000)] + [(a, b) for a in ["▁", *runs] for b in [*runs, "▁the"]]
    pairs += [(p[:i], p[i:]) for p in r.sample(pieces, 400) for i in range(1, len(p)) if p[:i] in own.rank and p[i:] in own.rank]
    for a, b in pairs:
        parts = list(a + b)
        own.merge(parts)
        assert own.can_follow(a, b) == (parts == [a, b])


@pytest.mark.parametrize("kind", ["base64", "cjk", "letters", "spaces"])
def test_a_million_characters_without_a_space(kind):
    import sentencepiece

    r = random.Random(3)
    one = {"base64": lambda: r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), "cjk": lambda: chr(r.randrange(0x4E00, 0x9FFF)), "letters": lambda: "ab"[r.random() < 0.5], "spaces": lambda: " "}[kind]
    text = "".join(one() for _ in range(1_000_000 if kind != "spaces" else 100_000))
    own = PrefixCounter(PIECES)
    tracemalloc.start()
    steps = own.store(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # of Python objects; the text itself is made before
    assert int(steps.sum(dtype=np.int64)) == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text))


def test_token_counts(make_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts(make_docs(ODD), PIECES, limit=50, store=True).collect()
    assert len(got) == len(ODD)
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in ODD)
    assert sorted((str(g["doc_id"]), g["n_bytes"], g["n_tokens"]) for g in got) == want
    for g in got:
        assert g["over_limit"] == (g["n_tokens"] > 50)
    text = {r[0]: r[1] or "" for r in ODD}
    at = token_counts(make_docs(ODD), PIECES).where("doc_id is not null").select("doc_id", "prefix_steps", tc.tokens_at(F.col("prefix_steps"), 7).alias("seven"), tc.tokens_at(F.col("prefix_steps"), 0).alias("none")).collect()
    for g in at:
        own = text[g["doc_id"]]
        assert (g["seven"], g["none"]) == (len(model.encode(own[:7])), 0)
        assert tc.counts(np.frombuffer(g["prefix_steps"], dtype=np.int8))[len(own) // 2] == len(model.encode(own[: len(own) // 2]))
    assert token_counts(make_docs([]), PIECES).collect() == []


def test_ranks_give_the_ids_of_the_tokenizer():
    plain, fast, r = encoder(BYTES), encoder(BYTES, RANKS), random.Random(4)
    parts = ["a", "The ", "  ", "\n\n", "é", "日本", "\t", "0123", "<|endoftext|>", "😀", "\x00", "don't", "'LL", "\u2028", "_x_", "ß"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(15)))
        assert plain(text).tolist() == fast(text).tolist()
    with pytest.raises(ValueError):
        encoder(BYTES, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.mark.parametrize("ranks", [None, public_tokenizers.path("byte_bpe_50k.tiktoken")])
def test_packing_is_a_round_trip(make_docs, ranks):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    rows = [r for r in ODD if r[0] is not None and r[0] != 6] + [(20 + i, prose(i, 7 * i % 400)) for i in range(80)] + [(200, "a <|endoftext|> b")]
    got = pack(make_docs(rows).repartition(5), BYTES, length=256, windows=4, fan=2, ranks=ranks).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for g in got:
        pieces[g["doc_id"]].append(g)
        sequences[g["sequence_id"]].append(g)
    for doc, text, *_ in rows:
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], 0
        for g in sorted(pieces[doc], key=lambda g: g["start"]):
            assert (g["start"], g["doc_tokens"]) == (at, len(ids))
            assert g["ids_crc32"] == zlib.crc32(np.array(ids[at : at + g["length"]], dtype="<u4").tobytes())
            at += g["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for g in sorted(own, key=lambda g: g["offset"]):
            assert g["offset"] == at
            at += g["length"]
        assert at <= 256 and at & (at - 1) == 0  # full or a power of two: no padding
    assert pack(make_docs([]), BYTES).collect() == []
    with pytest.raises(ValueError):
        pack(make_docs([]), BYTES, length=1000)


def brute_entropy(window):
    return sum(int(fp._TERM[n]) for n in collections.Counter(window).values()) * 1000 // (6 * fp._UNIT)


def test_entropy_of_every_window():
    data = (prose(3, 40) + "a" * 200 + "é" * 50).encode()
    got = fp.entropies(np.frombuffer(data, dtype=np.uint8))
    assert got.tolist() == [brute_entropy(data[i : i + 64]) for i in range(len(data) - 63)]


def test_blocks_give_the_same_fingerprints():
    texts = [t.encode() for t in (prose(3, 400), "", "x", "a" * 3000, prose(4, 5), "é" * 200 + prose(5, 90), "ab" * 700)]
    ranks = fp.rarity_ranks(fp.entropy_counts(texts))
    whole = fp.fingerprints(texts, ranks)
    for block in (128, 500, 1000):
        assert fp.fingerprints(texts, ranks, block) == whole


def brute_features(data, ranks):
    n = len(data) - 63
    levels = [ranks[brute_entropy(data[i : i + 64])] for i in range(n)]
    points = [0] * n
    for i in range(-63, n):
        own = range(max(i, 0), min(i + 64, n))
        points[min(own, key=lambda j: (levels[j], j))] += 1
    return [i for i in range(n) if points[i] >= 16] or [int(np.argmax(points))]


def test_fingerprints(make_docs):
    rows = [r for r in ODD if r[0] != 7] + [(7, prose(7, 900))]
    docs = make_docs(rows)
    ranks = fp.corpus_ranks(docs)
    got = fp.document_fingerprints(docs.repartition(4)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        x, y = a[1] or "", b[1] or ""
        half = len(x) // 2
        edited = (x[: len(x) - half] + y[:half]).encode()
        prints = [fp.fingerprints([t], ranks)[0] for t in (x.encode(), edited, y.encode())]
        text = [base64.b64encode(p).decode() for p in prints]
        want.append((a[0], len(x), hashlib.sha256(edited).hexdigest(), text[0], text[1], fp.likeness(prints[0], prints[1]), fp.likeness(prints[0], prints[2])))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    data = np.frombuffer(rows[-1][1].encode(), dtype=np.uint8)
    sums, down, at = fp.prefix_hash(data), fp.power_table(len(data) + 1, "down"), np.array(brute_features(bytes(data), ranks))
    assert fp._filters(fp.mix64((sums[at + 64] - sums[at]) * down[at])) == fp.fingerprints([bytes(data)], ranks)[0]
    assert fp.document_fingerprints(make_docs([])).collect() == []
    one = fp.document_fingerprints(make_docs([(1, prose(1, 50))])).first()
    assert one["near_next"] == 1.0


def share(weights, offers, budget):
    """Water filling by hand: settle those that offer less than their share, then share out the rest."""
    open_, out, left = {k for k in offers if weights[k]}, dict.fromkeys(offers, 0), budget
    while open_:
        total = sum(weights[k] for k in open_)
        done = {k for k in open_ if offers[k] * total <= left * weights[k]}
        if not done:
            return out | {k: left * weights[k] // total for k in open_}
        for k in done:
            out[k] = offers[k]
        left -= sum(offers[k] for k in done)
        open_ -= done
    return out


def test_budgets_go_to_siblings_first(spark):
    rows = [("web", "en", "a", 100), ("web", "en", "b", 10), ("web", "de", "a", 50), ("book", "en", "a", 1000), ("code", "en", "c", 5), ("none", "en", "x", 9)]
    weights = {"domain": {"web": 2, "book": 1, "code": 1, "none": 0}, "source": {"b": 3}}
    got = {tuple(r)[:3]: r["target"] for r in leaf_budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), 40, 2, weights).collect()}
    offers = {r[:3]: 2 * r[3] for r in rows}
    tree = lambda i, above: {k[i]: sum(v for o, v in offers.items() if o[: i + 1] == (*above, k[i])) for k in offers if k[:i] == above}
    budget = sum(r[3] for r in rows) * 40 // 100
    want = {}
    for d, x in share({"web": 2, "book": 1, "code": 1, "none": 0}, tree(0, ()), budget).items():
        for la, y in share(dict.fromkeys(("en", "de"), 1), tree(1, (d,)), x).items():
            for s, z in share({"a": 1, "b": 3, "c": 1, "x": 1}, tree(2, (d, la)), y).items():
                want[d, la, s] = z
    assert got == want


def test_mixing_takes_prefixes(make_docs):
    rows = [(i, prose(i, 1 + i % 30), ["en", "de", None][i % 3], ["src0", "src1", None][i % 2]) for i in range(300)] + ODD
    docs, domain = make_docs(rows), F.lit("web")
    small = sorted(map(tuple, mix(docs, domain, percent=150, max_epochs=3, piece_docs=4).collect()), key=str)
    assert small == sorted(map(tuple, mix(docs, domain, percent=150, max_epochs=3).collect()), key=str)  # pieces change nothing
    leaves = collections.defaultdict(list)
    for doc, _, la, s, epoch, n, start, taken in small:
        leaves[la, s].append((start, n, taken, epoch, doc))
    for own in leaves.values():
        at = 0
        for start, n, taken, _, doc in sorted(own):
            if doc != 6:  # the repeated row ties with itself
                assert start == at or any(o[4] == 6 for o in own)
            assert 0 < taken <= n
            at = start + n
        assert sum(taken < n for _, n, taken, _, _ in own) <= 1
    assert mix(make_docs([]), domain).collect() == []


def test_text_without_spaces_in_bounded_memory():
    import sentencepiece
    import tracemalloc

    model, own, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), PrefixCounter(PIECES), random.Random(2)
    mixed = "".join(r.choice(["日", "本", "語", "th", "er", "e", "tion", "0", "é", "YWJj", ";"]) for _ in range(60_000))[:100_000]
    for text in (mixed, "\n" + "日本語の文" * 20_000, "a" * 100_000):
        want = len(model.encode(text))
        tracemalloc.start()
        steps = own.store(text)
        got = int(steps.sum(dtype=np.int64)), tc.longest_prefix(steps, want // 2)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got[0] == want
        assert len(model.encode(text[: got[1]])) <= want // 2 < len(model.encode(text[: got[1] + 1]))
        assert peak < 20 << 20
    assert max(map(len, own.steps), default=0) <= tc.SHORT


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "\t" * 1_000_000, " " * 1_000_000, " " * 1_000_000 + "x", "x" * 1_000_000, "ab \n" * 250_000], ids=["spaces", "breaks", "tabs", "nbsp", "before a letter", "letters", "mixed"])
def test_long_runs_have_the_tokenizer_s_ids(text):
    assert np.array_equal(encoder(BYTES)(text), encoder(BYTES, RANKS)(text))


def test_long_white_space_is_packed(make_docs):
    text = "a" + " " * 1_000_000
    got = pack(make_docs([(1, text), (2, "b")]), BYTES, ranks=RANKS).collect()
    assert sum(g["length"] for g in got if g["doc_id"] == 1) == len(encoder(BYTES)(text)) + 1
