"""Quality rules, licence scan and classifier on small and odd tables."""

import math
import os
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardlight.llm import license_scan as ls
from wardlight.llm import quality_classifier as qc
from wardlight.llm.quality_classifier import quality_classifier, score, train
from wardlight.llm.quality_rules import bucket, quality_rules

from .conftest import ODD, prose


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams, covered = {}, set()
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_measures(make_docs):
    rows = ODD + [(20, "a b c d e a b c d e f"), (21, "x\nx\n \n \nx y"), (22, "a a a a a a a a a a a a"), (23, "🙂 #*$%&|<> é\x0b\x0cz"), (24, "l1 w\n" * 40)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality_rules(make_docs(rows)).collect()
    assert sorted(str((r["doc_id"], *[r[c] for c in names])) for r in got) == sorted(str((r[0], *brute_measures(r[1]))) for r in rows)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_fences_adapt_and_spare_clean_documents(make_docs):
    clean = [(i, prose(i, 20 + i % 50), "en", "src1") for i in range(120)]
    tables = [(1000 + i, " | ".join(prose(i, 40).split(" ")), "en", "tables") for i in range(80)]
    junk = [(2000 + i, " ".join(w + "***" for w in prose(i, 40).split(" ")), "en", "src1") for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(make_docs(clean + tables + junk), keep_text=True).collect()}
    assert all(got[i] for i, *_ in clean)
    assert all(got[i] for i, *_ in tables)  # a source of tables sets its own fence
    assert not any(got[i] for i, *_ in junk)


def test_rules_on_nothing_and_clashes(make_docs, spark):
    assert quality_rules(make_docs([])).collect() == []
    docs = make_docs(ODD).withColumn("n_words", F.lit("mine"))
    assert dict(quality_rules(docs, keep_text=True).dtypes)["n_words"] == "bigint"


def test_rules_keep_columns_with_any_name(make_docs):
    docs = make_docs(ODD)
    names = ["_lang", "_source", "_words", "_LINES", "_upper", "_symbol_share_hi", "a.b", "kept", "_w", "_l", "_u"]
    own = docs.select("doc_id", "text", "lang", "source", *[F.lit("mine").alias(n) for n in names])
    got = quality_rules(own, keep_text=True)
    assert [c for c in got.columns if c in names] == [n for n in names if n != "kept"] + ["kept"]
    rows = got.drop("kept").collect()
    assert len(rows) == len(ODD) and all(r[n] == "mine" for r in rows for n in names if n != "kept")
    key = lambda r: str((r["doc_id"], r["kept"], r["n_words"]))
    assert sorted(map(key, got.collect())) == sorted(map(key, quality_rules(docs).collect()))


def test_bucket_error(spark):
    values = [0, 1, 63, 64, 65, 1000, 123456, 2**40 + 12345]
    for v, b in spark.createDataFrame([(v,) for v in values], "v long").select("v", bucket(F.col("v"))).collect():
        assert b <= v and v - b <= v / 32


def full(name, title=0):
    titles, body = ls.FULL[name]
    return "\n\n".join(filter(None, (titles[title], *body)))


def test_license_scan(make_docs):
    mit = full("MIT")
    shouted = "Copyright (c) 2020 Somebody\n" + mit.upper().replace(",", " ").replace("\n\n", "\n") + "\n(c) 2021 Another"
    rows = ODD + [(20, mit), (21, shouted), (22, mit + " and more"), (23, "text\nlicenced under the APACHE Licence, version 2.0\nmore"), (24, "Licensed under CC BY-NC 4.0."), (25, "Copyright 2020")]
    got = {r["doc_id"]: (r["text_license"], r["line_licenses"]) for r in ls.license_scan(make_docs(rows)).collect() if r["doc_id"] is not None}
    assert got[20][0] == got[21][0] == "MIT" and got[22][0] is None
    assert got[23] == (None, "Apache-2.0")
    assert got[24] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0")
    assert got[25] == got[1] == got[2] == (None, "")
    assert ls.license_scan(make_docs(rows)).count() == len(rows)
    assert ls.license_scan(make_docs([])).collect() == []


def test_wrapped_licences_are_found(make_docs):
    rows, want = [], {}
    for i, name in enumerate(sorted(ls.FULL)):
        for j, width in enumerate((20, 35, 60, 72, 79)):
            doc = 10 * i + j
            text = "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in full(name, j % len(ls.FULL[name][0])).split("\n\n"))
            head = ("", "Copyright (c) 2019, Some Body\nAll rights reserved.\n", "Copyright © 2020 X. All rights reserved.\r\n", "(c) 2001 by A\n(c) 2002 by B\n\n", " * Copyright 2020 The Authors\n")[j]
            rows.append((doc, head + re.sub(r"\blicense", "licence" if j % 2 else "license", text).replace('"', "“" if j == 3 else '"')))
            want[doc] = name
    assert any(line.startswith("copyright notice") for _, t in rows for line in t.split("\n"))
    got = {r["doc_id"]: r["text_license"] for r in ls.license_scan(make_docs(rows)).collect()}
    assert got == want


def test_longer_licences_are_found(make_docs):
    folder, files = "/usr/share/common-licenses", {"GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-3.0": "LGPL-3", "Artistic-1.0-Perl": "Artistic", "BSD-3-Clause-UC": "BSD"}
    if not os.path.isdir(folder):
        pytest.skip("the copies are not here")
    names = sorted(ls.DIGESTS)
    rows = []
    for i, name in enumerate(names):
        with open(f"{folder}/{files.get(name, name)}", encoding="utf-8", errors="replace") as f:
            text = f.read()
        rows += [(2 * i, text), (2 * i + 1, re.sub(r"[ \t]+", " ", text).upper())]
    got = {r["doc_id"]: r["text_license"] for r in ls.license_scan(make_docs(rows)).collect()}
    assert got == {k: names[k // 2] for k in range(2 * len(names))}


@pytest.mark.parametrize("line", ["(c) You must retain the notices", "copyright notice, this list of conditions", "copyright holders be liable", "Copyright law", "All rights reserved by them"])
def test_ordinary_lines_are_no_statements(make_docs, line):
    got = {r["doc_id"]: r["text_digest"] for r in ls.license_scan(make_docs([(1, f"some text\n{line}"), (2, "some text")])).collect()}
    assert got[1] != got[2]


def _labelled(make_docs, spark, n=400):
    rows, labels = [], []
    for i in range(n):
        text, kind = prose(i, 20 + i % 200), i % 4
        if kind == 1:
            text = text.replace(" ", " nasty ", 1) if i % 8 == 1 else text + " nastiest"
        if kind == 2:
            text = " ".join(w + "%%%" for w in text.split(" "))
        rows.append((i, text))
        labels.append((i, 0 if kind == 2 else 1, 1 if kind == 1 else 0))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_held_out(make_docs, spark):
    docs, labels = _labelled(make_docs, spark)
    model = train(docs, labels.where("doc_id % 5 < 3"), buckets=1 << 14)
    got = score(docs, model).where("doc_id % 5 >= 3").collect()
    right = [r["kept"] == (r["doc_id"] % 4 in (0, 3)) for r in got]
    assert np.mean(right) > 0.97
    assert model.thresholds[0] < model.thresholds[1]
    for r in got:
        assert 0 <= r["p_good"] <= r["p_above_toxic"] <= 1
        assert r["expected_grade"] == pytest.approx(r["p_good"] + r["p_above_toxic"])


def _ratings(seed, texts=40, columns=12):
    r = np.random.default_rng(seed)
    pairs = [(i, c) for i in range(texts) for c in range(columns) if r.random() < 0.4]
    rows, cols = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
    return qc.Ratings(rows, cols, r.random(len(rows)), r.integers(0, 3, texts))


def brute_loss(own, weights, gap):
    """The weighted negative log likelihood, text by text."""
    cuts, total = (gap[0], gap[0] + math.exp(gap[1])), 0.0
    counts = [list(own.grades).count(j) for j in range(3)]
    for i, g in enumerate(own.grades):
        s = sum(weights[c] * (x if weights[c] > 0 else 1) for r, c, x in zip(own.rows, own.columns, own.shares, strict=True) if r == i)
        below = [0, *(1 / (1 + math.exp(s - t)) for t in cuts), 1]
        total -= math.log(below[g + 1] - below[g]) * len(own.grades) / (counts[g] * sum(c > 0 for c in counts))
    return total / len(own.grades)


def test_slopes_are_those_of_the_loss():
    own, r = _ratings(1), np.random.default_rng(2)
    weights, gap, step = r.normal(size=12), np.array([-0.7, 0.4]), 1e-5
    assert own.loss(weights, gap) == pytest.approx(brute_loss(own, weights, gap))
    fault, praise, by_cut = own.slopes(weights, gap)
    for c in range(12):
        way = np.eye(12)[c] * step
        want = (brute_loss(own, weights + way, gap) - brute_loss(own, weights - way, gap)) / (2 * step)
        assert (praise if weights[c] > 0 else fault)[c] == pytest.approx(want, abs=1e-6)
    for j in range(2):
        way = np.eye(2)[j] * step
        assert by_cut[j] == pytest.approx((brute_loss(own, weights, gap + way) - brute_loss(own, weights, gap - way)) / (2 * step), abs=1e-6)


def test_fit_is_as_good_as_a_plain_search():
    own = _ratings(3, texts=120)
    columns = own.columns + qc._FORMS
    grades = np.where(np.isin(np.arange(120), own.rows[own.columns == 0]), 0, own.grades)  # column 0 tells
    own = qc.Ratings(own.rows, columns, own.shares, grades)
    size = qc._FORMS + 12
    use = qc.telling(own, size)
    model = qc.fit(own, size, flat=1e-4)
    assert set(np.flatnonzero(model.weights)) <= set(np.flatnonzero(use))
    one = int(np.flatnonzero(use)[0])

    def loss(x):
        w = np.zeros(size)
        w[one] = x[0]
        return own.loss(w, np.array(x[1:])) + 0.5e-4 * x[0] ** 2

    assert np.count_nonzero(use) == 1
    best, step = [0.0, -2.0, math.log(2.0)], 1.0
    while step > 1e-4:  # one coordinate after the other
        tries = [[b + d * (k == j) for k, b in enumerate(best)] for j in range(3) for d in (-step, step)]
        least = min(tries, key=loss)
        best, step = (least, step) if loss(least) < loss(best) else (best, step / 2)
    cuts = model.thresholds
    assert loss([float(model.weights[one]), cuts[0], math.log(cuts[1] - cuts[0])]) == pytest.approx(loss(best), abs=2e-3)


def test_the_bar_is_chosen_on_held_out_texts():
    own = _ratings(4, texts=103)
    fit, held = qc.split(own)
    assert (len(fit.grades), len(held.grades)) == (83, 20)
    for part, texts in ((fit, [i for i in range(103) if i % 5 != 4]), (held, range(4, 103, 5))):
        assert part.grades.tolist() == own.grades[list(texts)].tolist()
        for n, i in enumerate(texts):
            assert part.columns[part.rows == n].tolist() == own.columns[own.rows == i].tolist()
    weights = np.random.default_rng(5).normal(size=12) * 3
    model = qc.OrdinalModel(weights, np.array([-1.0, 1.0]))
    good = model.tails(held.scores(weights))[:, 1]
    share = lambda g, bar: np.mean(good[held.grades == g] >= bar)
    gains = {bar: share(2, bar) - max(share(0, bar), share(1, bar)) for bar in (k / 20 for k in range(1, 20))}
    assert qc.best_bar(model, held) == min(b for b, x in gains.items() if x >= max(gains.values()) - 1e-9)
    assert qc.best_bar(model, qc.Ratings(held.rows, held.columns, held.shares, np.full(20, 2))) == 0.5


def test_the_fit_ends_where_the_slope_is_flat():
    own = _ratings(6, texts=200)
    own = qc.Ratings(own.rows, own.columns, own.shares, own.grades)
    rough, flat = (qc.fit(own, qc._FORMS, flat=f) for f in (0.3, 0.01))
    loss = lambda m: own.loss(m.weights.astype(float), np.array([m.thresholds[0], math.log(m.thresholds[1] - m.thresholds[0])]))
    assert loss(flat) <= loss(rough)
    with pytest.warns(UserWarning, match="not flat after 2 steps"):
        qc.fit(own, qc._FORMS, flat=1e-9, most_steps=2)


def test_scores_are_those_of_single_texts(make_docs, spark):
    docs, labels = _labelled(make_docs, spark)
    model = train(docs, labels, buckets=1 << 14)
    texts = [prose(900 + i, 3 + i) + (" nasty" if i % 2 else "") for i in range(20)] + ["Ab " * 50, "x%% " * 9]
    many = model.scores(*qc.features(pa.array(texts), 1 << 14))
    for t, s in zip(texts, many, strict=True):
        (n,), _, bucket = qc.features(pa.array([t]), 1 << 14)
        weights = model.weights.astype(float)
        want = sum(weights[b] for b in set(bucket.tolist()) if b < qc._FORMS or weights[b] < 0)
        want += sum(max(weights[b], 0) for b in bucket.tolist() if b >= qc._FORMS) * qc.PRAISE / ((n + qc.PRIOR) * 3)
        assert s == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_wordless_texts_are_not_kept_and_grades_rank(make_docs, spark):
    docs, labels = _labelled(make_docs, spark)
    model = train(docs, labels.where("doc_id % 5 < 3"), buckets=1 << 14)
    odd = {r["doc_id"]: r for r in score(make_docs([(1, None), (2, ""), (3, " \n\t"), (4, "zq")]), model).collect()}
    for i in (1, 2, 3):
        assert (odd[i]["score"], odd[i]["expected_grade"], odd[i]["p_good"], odd[i]["kept"]) == (None, 0, 0, False)
    got = score(docs, model).where("doc_id % 5 >= 3").collect()
    assert max(r["p_good"] for r in got) > odd[4]["p_good"] > 0
    good = [r["expected_grade"] for r in got if r["doc_id"] % 4 in (0, 3)]
    bad = [r["expected_grade"] for r in got if r["doc_id"] % 4 in (1, 2)]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.99


def test_repeated_rows_do_not_pass_the_bound(make_docs, spark):
    docs = make_docs([(1, prose(1, 20))] * 30 + [(1, "another text"), (2, prose(2, 20)), (3, prose(3, 20))])
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 1, 2, 3)], "doc_id long, quality int, toxic int")
    assert qc.rated_texts(docs, labels, 10).count() == 3
    assert qc.rated_texts(docs, labels, 2).count() == 2


def test_classifier_odd_tables(make_docs, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier(make_docs(ODD), labels).count() == len(ODD)
    assert quality_classifier(make_docs(ODD), labels.where("false")).count() == len(ODD)
    assert quality_classifier(make_docs([]), labels).collect() == []


def test_rights_notice_is_found(make_docs):
    rows = [
        (1, "Some text of its own.\nAll rights reserved."),
        (2, "All rights reserved."),
        (3, "Copyright (c) 2020 X\n\n  ALL RIGHTS RESERVED\n"),
        (4, "Copyright (c) 2020 X\n...\n"),
        (5, "All rights reserved by the author of the other text"),
        (6, full("MIT") + "\nAll rights reserved."),
        (7, None),
    ]
    got = {r["doc_id"]: (r["text_license"], r["line_licenses"]) for r in ls.license_scan(make_docs(rows)).collect()}
    assert got == {
        1: (None, "proprietary"),
        2: ("proprietary", "proprietary"),
        3: ("proprietary", "proprietary"),
        4: (None, ""),
        5: (None, ""),
        6: ("MIT", "proprietary"),
        7: (None, ""),
    }


def test_line_after_the_rights_notice_counts(make_docs):
    head, body = "Copyright (c) 2020 X\nAll rights reserved.\n", full("MIT")
    isc = full("ISC", 1)
    rows = [(1, head + isc), (2, head + "No licence is given.\n" + isc), (3, head.replace("\n", "\r\n") + isc.replace("\n", "\r\n")), (4, head + "MIT License\n" + body), (5, head + "Some other text.")]
    got = {r["doc_id"]: r["text_license"] for r in ls.license_scan(make_docs(rows)).collect()}
    assert got == {1: "ISC", 2: None, 3: "ISC", 4: "MIT", 5: None}
