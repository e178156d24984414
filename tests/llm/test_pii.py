"""Personal data: base spans against Python's patterns, the trees, and spellings that only the method finds."""

import random
import re

import numpy as np

from wardlight.llm import pii
from wardlight.llm.pii import KINDS, Trees, boost, calibrated, personal_data, redact

from .conftest import ODD, prose

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in hit.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    """Base spans as the contract words them."""
    return {k: [m.span() for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in BASE.items()}


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def soup(r, n):
    parts = ["a", "b.c", "@", "x-y", ".", "..", " ", "  ", "1", "12", "255", "256", "0", "007", "+", "-", "(", ")", "\n", "é", "😀", "%", "_", "4111111111111111", "4111-1111", "+4930", "9.9.9.9", "me@it.org", "@@", ".@"]
    return "".join(r.choice(parts) for _ in range(n))


def test_base_spans_are_those_of_plain_patterns(make_docs):
    r = random.Random(1)
    rows = [*ODD, *((100 + i, soup(r, r.randrange(60))) for i in range(800))]
    got = personal_data(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = {i: plain(t) for i, t, *_ in rows if i and i >= 100}
    for g in got:
        if g["doc_id"] in want:
            assert g["base_spans"] == joined(want[g["doc_id"]])
            assert [g[f"n_{k}"] for k in KINDS] == [len(want[g["doc_id"]][k]) for k in KINDS]
            assert set(filter(None, g["base_spans"].split(","))) <= set(g["spans"].split(","))
        else:
            assert (g["base_spans"], g["spans"]) == ("", "")
    assert personal_data(make_docs([])).collect() == []


# With what plain patterns find; they take the square of the length on some of these.
LONG = {
    "letters": ("x" * 3_000_000, ""),
    "digits": ("1" * 3_000_000, ""),
    "labels": ("a@" + "b." * 1_000_000 + "c", "email:0:2000003"),
    "dotted": ("1." * 400_000 + "1", ",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(100_000))),
    "spaces": ("+1" + " " * 3_000_000, ""),
    "chain": ("1 " * 1_000_000, ""),
    "signs": ("@" * 1_000_000, ""),
    "words": ("at " * 300_000, ""),
}


def test_long_texts(make_docs):
    got = personal_data(make_docs([(i, text) for i, (text, _) in enumerate(LONG.values())])).collect()
    assert {list(LONG)[g["doc_id"]]: g["base_spans"] for g in got} == {name: want for name, (_, want) in LONG.items()}


def corpus(n=400):
    r = random.Random(3)
    rows = []
    for i in range(n):
        words = prose(i, 30).split()
        kind = i % 8
        if kind < 4:
            card = "".join(str(r.randrange(10)) for _ in range(15))
            card += next(c for c in "0123456789" if luhn(card + c))
            good = (f"u{i}@mail.example.com", f"10.{i % 250}.3.4", card, f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}")[kind]
            words.insert(9, good)
        elif kind == 4:
            words.insert(9, "".join(str(r.randrange(10)) for _ in range(16)))
        elif kind == 5:
            words.insert(9, f"10.{i}.300.4")
        rows.append((i, " ".join(words)))
    return rows


ADDED = {
    "email": ["ann.lee[at]mail.example.com", "bob (at) example (dot) org", "kim AT example DOT com"],
    "ip": ["10[.]2[.]33[.]4", "2001:db8:0:1:2:3:4:5"],
    "card": ["4111.1111.1111.1111", "5105105105105100 4111111111111111"],
    "phone": ["(415) 555-2671", "tel: 030 1234567"],
}


def test_other_spellings_are_added_and_look_alikes_left(make_docs):
    rows = corpus()
    planted = [(1000 + n, kind, f"{prose(n, 8)} {x} {prose(n + 1, 8)}") for n, (kind, x) in enumerate((k, x) for k, xs in ADDED.items() for x in xs)]
    clean = ["met at noon.We left", "on 01/02/2003 and 03.04.2005", "version 300.2.33.4 of it", "3 @ 4.50 each", "the 1234567890123456 of it", "0.5 0.25 0.125", "at 12:30:45 or 1:2", "pages 250 300 400", "x" * 50, prose(9, 300)]
    rows += [(i, t) for i, _, t in planted] + [(2000 + i, t) for i, t in enumerate(clean)]
    got = {g["doc_id"]: g for g in personal_data(make_docs(rows)).collect()}
    for i, kind, text in planted:
        assert kind in {s.split(":")[0] for s in got[i]["spans"].split(",") if s}, text
        assert got[i]["base_spans"] == joined(plain(text))
    for i, text in enumerate(clean):
        assert got[2000 + i]["spans"] == "", text
    for i, text in corpus():
        assert got[i]["base_spans"] == joined(plain(text))
        assert got[i]["spans"] == got[i]["base_spans"], text


def test_spans_of_a_chain(spark):
    names = "row long, generator byte, kind int, base boolean, checked boolean, start int, end int, x array<byte>"
    x = lambda v: [v] * len(pii.FEATURES)
    rows = [(1, 7, 2, False, True, 0, 16, x(1)), (1, 9, 3, False, True, 10, 20, x(2)), (1, 9, 3, False, True, 30, 40, x(0)), (2, 2, 2, True, True, 0, 16, x(0)), (2, 9, 3, False, True, 15, 20, x(2)), (2, 9, 3, False, False, 50, 60, x(2)), (2, 2, 2, True, False, 70, 90, x(2))]
    model = Trees(0.0, ((0, 1, (0, 0, -1.0, 1.0), 2.0),), (0.0,) * 4)
    got = pii.select(spark.createDataFrame(rows, names), model).collect()
    assert sorted((g["row"], g["kind"], g["start"], g["end"]) for g in got) == [(1, 3, 10, 20), (2, 2, 0, 16)]


def test_trees_learn_and_columns_give_their_margins(spark):
    r = np.random.default_rng(4)
    x = r.integers(0, 6, (300, len(pii.FEATURES)))
    truth = (x[:, 2] > 2) ^ (x[:, 5] > 3)
    yes, no = np.where(truth, 9.0, 1.0), np.where(truth, 1.0, 9.0)
    first, trees = boost(x, yes, no)
    model = Trees(first, trees, (0.0,) * 4)
    margin = model.margins(x)
    assert ((margin > 0) == truth).mean() > 0.97
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<byte>")
    got = dict(rows.select("i", model.margin("x")).collect())
    assert np.allclose([got[i] for i in range(len(x))], margin)
    limit = calibrated(margin, yes, no, 0.85)
    assert 0.85 <= yes[margin >= limit].sum() / (yes + no)[margin >= limit].sum()
    assert calibrated(margin, yes, no, 0.99) == np.inf
    assert calibrated(np.empty(0), np.empty(0), np.empty(0), 0.5) == np.inf


def test_redaction(make_docs):
    docs = make_docs([(1, "call +49 30 1234567 or me@it.org now"), (2, "nothing"), (3, None), (4, "4111 1111 1111 1111")])
    found = personal_data(docs)
    got = {g["doc_id"]: g["text"] for g in redact(docs, found).collect()}
    assert got == {1: "call [phone] or [email] now", 2: "nothing", 3: None, 4: "[card]"}
