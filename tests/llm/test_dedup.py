"""Near-duplicate, suffix and line deduplication against brute force."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardlight.llm import _shared as shared
from wardlight.llm import suffix_dedup as sd
from wardlight.llm.components import connected_components
from wardlight.llm.line_dedup import line_dedup
from wardlight.llm.near_dedup import _cross_pairs, near_duplicates

from .conftest import ODD, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def edited(text, seed, n):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.randrange(1000)}"
    return " ".join(words)


def near_rows():
    rows, base = list(ODD), prose(100, 150)
    rows += [(20 + i, edited(base, i, i % 9)) for i in range(60)]  # a continuum around the threshold
    rows += [(100 + i, base) for i in range(25)]
    rows += [(200 + i, prose(900, 40) + " " + prose(300 + i, 60)) for i in range(20)]  # a common passage
    rows += [(300 + i, edited(prose(77, 900), i, 3 * i)) for i in range(12)]
    return rows + [(400, "A B C"), (401, "a b c"), (402, "a b c d")]


def test_near_duplicates(make_docs):
    rows = near_rows()
    got = near_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]
    assert sum(1 for v in want.values() if not v[2]) > 50


def test_near_duplicates_with_tiny_sketches(make_docs):
    rows = near_rows()
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(rows), k=16).collect() if r["doc_id"] is not None}
    assert got == {k: v[1] for k, v in brute_classes(rows).items()}


def test_near_duplicates_with_whole_sets(make_docs):
    rows = near_rows()
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(rows), k=None).collect() if r["doc_id"] is not None}
    assert got == {k: v[1] for k, v in brute_classes(rows).items()}


def test_pairs_of_one_list(spark):
    """The pairs that sizes and positions allow, of members at the ends of the bounds, against all pairs."""
    r, rows = random.Random(8), []
    for v in range(6):
        for i in range(40):
            n = r.choice([1, 2, 3, 4, 7, 8, 30, 31, 40, 41, 75, 100, 133, 134])
            rows.append((v, 1000 * v + i, n, r.randrange(12), r.randrange(1, n + 1)))
    share, want = 75 / 175, set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[3] != b[3] and min(a[2], b[2]) * 100 >= max(a[2], b[2]) * 75:
                if all(x[4] + 1e-6 >= (x[2] + y[2]) * share for x, y in ((a, b), (b, a))):
                    want.add((a[1], b[1]))
    lists = spark.createDataFrame(rows, "v long, rep long, n long, part long, after int")
    assert {tuple(p) for p in _cross_pairs(lists, 75).collect()} == want and want


def test_a_common_passage_without_links_takes_linear_time(spark):
    """16,000 documents share four fifths of their shingles and no two are similar."""
    common = prose(4000, 84)
    rows = [(i, f"{common} " + " ".join(f"w{i}x{j}" for j in range(20)), "en", "src0", None, None) for i in range(16_000)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string, lang string, source string, n_chars long, kept string")
    seconds = []
    for part in (docs.where("doc_id < 2000"), docs):
        began = time.time()
        assert part.count() == near_duplicates(part).where("kept and component_id = doc_id").count()
        seconds.append(time.time() - began)
    assert seconds[1] < 4 * seconds[0] + 20  # eight times the documents; all pairs would be 64 times


def test_near_duplicates_of_nothing(make_docs):
    assert near_duplicates(make_docs([])).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 80), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys((80, 90, 100), 80)}


def brute_suffix(rows):
    key = lambda r: ((1 << 63) - 1 if r[0] is None else r[0])
    seen, out = {}, []
    places = sorted({(key(r), (r[1] or "").encode()) for r in rows})
    for doc, raw in places:
        for p in range(len(raw) - 99):
            seen.setdefault(raw[p : p + 100], (doc, p))
    for r in rows:
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if seen[raw[p : p + 100]] < (key(r), p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((r[0], len(raw), len(raw) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def suffix_rows():
    rows = [r for r in ODD if r[0] != 7] + [(7, prose(7, 3000))]
    passage = prose(500, 25)
    rows += [(50 + i, prose(600 + i, 20) + passage[: 90 + 3 * i] + prose(700 + i, 20)) for i in range(20)]
    rows += [(80 + i, prose(5, 60)[i : 200 + i]) for i in range(10)]
    return rows + [(95, "ab" * 300), (96, "x" * 99), (97, "x" * 100), (98, "x" * 101), (99, "é" * 130 + "y")]


TWO_LEVELS = [{"most": most, "bucket_bytes": size, "direct": 1} for most, size in ((50_000, 300), (2, 2000), (0, 300))]


@pytest.mark.parametrize("options", [{}, {"most": 2, "bucket_bytes": 2000}, {"most": 0, "bucket_bytes": 2000}, *TWO_LEVELS])
def test_suffix_dedup(make_docs, options):
    rows = suffix_rows()
    docs = make_docs(rows) if options not in TWO_LEVELS else make_docs(rows).repartition(9)
    got = sorted((tuple(r) for r in sd.suffix_dedup(docs, **options).collect()), key=str)
    assert got == brute_suffix(rows)
    assert sum(g[2] for g in got) > 2000


def test_long_texts_are_taken_in_blocks(make_docs, monkeypatch):
    """Blocks of 1000 bytes give what whole texts give: suffixes, words and features."""
    rows = [(1, prose(1, 900)), (2, "x" * 5000 + prose(1, 300)), (3, prose(2, 50)), (4, ""), (5, "é" * 700), (6, " " * 2500), (7, None)]
    texts = pa.array([r[1] for r in rows], pa.string())
    data, offsets = shared.text_bytes(texts)
    whole = [shared.shingle_sets(texts), shared.words_of(data, offsets, (4,)), sd.strips(data, offsets)]
    monkeypatch.setattr(sd, "BLOCK", 1000)
    monkeypatch.setattr(shared._word_blocks, "__defaults__", (1000,))
    assert len(list(shared._word_blocks(data, offsets))) > 8
    cut = [shared.shingle_sets(texts), shared.words_of(data, offsets, (4,)), sd.strips(data, offsets)]
    assert all((a == b).all() for a, b in zip(whole[0], cut[0], strict=True))
    assert all((a == b).all() for a, b in zip([*whole[1][0], *whole[1][1:]], [*cut[1][0], *cut[1][1:]], strict=True))
    assert sum(whole[2][2] - whole[2][1] + 1) == sum(cut[2][2] - cut[2][1] + 1) and set(whole[2][4]) == set(cut[2][4])


def _exchanged(n_runs, buckets, direct):
    """Rows, strings and the hot string's most copies in a bucket that the last exchange of ``n_runs`` runs has; and the spans found."""
    hot, tables = prose(1000, 60)[:500], []
    for i in range(n_runs):
        texts = [f"{prose(3000 + 7 * i + j, 30)} {hot} {prose(5000 + 7 * i + j, 30)}" for j in range(3)]
        data, offsets = shared.text_bytes(pa.array(texts))
        owner, *_, hashes = sd.strips(data, offsets)
        anchors = [np.unique(sd.short_hash(hashes[owner == k])).tolist() for k in range(3)]
        kind = pa.list_(pa.int64())
        tables.append(pa.RecordBatch.from_arrays([pa.array([10 * i + k for k in range(3)]), pa.array([0] * 3), pa.array(texts), pa.array(anchors, kind), pa.array([None] * 3, kind)], names=["_id", "_key", "text", "anchors", "hot"]))
    width = math.isqrt(buckets - 1) + 1
    lanes = math.isqrt(n_runs) if not direct else 1
    rows = []
    for i, t in enumerate(tables):
        rows += [(i % lanes, r) for b in sd._runs(buckets, 1 if direct else width)(iter([t])) for r in b.to_pylist()]
    first = len(rows)
    if not direct:
        groups = {}
        for lane, r in rows:
            groups.setdefault((lane, r["bucket"]), []).append(r)
        schema = pa.schema(list(sd._RUN.items()))
        rows = [(0, r) for (lane, b), own in groups.items() for r in sd._longer(buckets, width)((pa.scalar(lane), pa.scalar(b)), pa.Table.from_pylist(own, schema)).to_pylist()]
    copies, strings, found = {}, 0, []
    by_bucket = {}
    for _, r in rows:
        by_bucket.setdefault(r["bucket"], []).append(r)
        strings += len(r["lengths"])
        if r["kind"] == 0:
            for _, rest in [(0, s) for s in _all_strings(r)]:
                copies[rest] = copies.get(rest, 0) + 1
    schema = pa.schema(list(sd._RUN.items()))
    for b, own in by_bucket.items():
        assert 0 <= b < buckets
        found += [tuple(x.values()) for x in sd._merged()((pa.scalar(b),), pa.Table.from_pylist(own, schema)).to_pylist()]
    return first, len(rows), strings, max(copies.values()), {(d, p) for d, _, a, z in found for p in range(a, z)}


def _all_strings(row):
    run, out = sd._unpack(row), []
    while run.string is not None:
        out.append(run.string)
        run.step()
    return out


def test_two_levels_find_the_same_and_carry_a_hot_string_once_a_lane():
    for n in (9, 36, 144):
        one, two = _exchanged(n, 4 * n, True), _exchanged(n, 4 * n, False)
        assert one[4] == two[4] and one[4]
        assert one[3] == n and two[3] <= math.isqrt(n)
        # Runs times groups of buckets, then lanes times buckets, each with a row of spans; where a run has a string for every bucket, direct rows are runs times buckets.
        groups = -(-4 * n // (math.isqrt(4 * n - 1) + 1))
        assert two[0] <= n * (groups + 1) and two[1] <= math.isqrt(n) * (4 * n + groups)
        assert max(two[:2]) < one[1]


def test_suffix_dedup_of_nothing(make_docs):
    assert sd.suffix_dedup(make_docs([])).collect() == []


def test_loser_tree_sorts_and_counts_common_bytes():
    r = random.Random(3)
    words = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 12))) for _ in range(300)]
    runs = []
    for i in range(7):
        own = sorted(words[i::7])
        shared, rests = sd.front_code(own)
        runs.append(sd.Run([(int(h), rest, w) for h, rest, w in zip(shared, rests, own)]))
    out = list(sd.LoserTree(runs))
    assert [s for _, s, _ in out] == sorted(words) == [p for _, _, p in out]
    before = b""
    for shared, s, _ in out:
        assert shared == sd.common_prefix(before, s)
        before = s
    assert list(sd.LoserTree([sd.Run([])])) == []


def brute_lines(rows):
    key = lambda r: ((1 << 63) - 1 if r[0] is None else r[0])
    seen, out = {}, []
    for r in sorted((r for r in rows if r[1] is not None), key=key):
        lines = r[1].split("\n")
        for p in range(len(lines) - 2):
            seen.setdefault(tuple(lines[p : p + 3]), (key(r), p))
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        lines, gone = r[1].split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip() and seen[w] < (key(r), p):
                gone |= {p, p + 1, p + 2}
        out.append((r[0], "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


def test_line_dedup(make_docs):
    passage = "first line\nsecond line\nthird line\nfourth line"
    rows = [r[:2] for r in ODD if r[0] != 6] + [(6, "a\nb"), (6, "a\nb")]
    rows += [(20, passage), (21, f"own\n{passage}\nrest"), (22, passage), (23, f"{passage}\n{passage}"), (24, "a\n\nb\n\n\n\nc"), (25, "\n\n\n\n"), (26, "\n\n\n\n")]
    rows += [(27, "q\nq\nq\nq\nq"), (28, "second line\nthird line\nfourth line")]
    got = line_dedup(make_docs(rows))
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str) == brute_lines(rows)
    assert got.columns[:2] == ["doc_id", "lang"] and "kept" in got.columns
    assert line_dedup(make_docs([])).collect() == []
    assert line_dedup(make_docs(rows)).where("n_removed > 0").agg(F.sum("n_runs")).first()[0] == 5


def test_line_dedup_keeps_columns_with_any_name(make_docs):
    rows = [(20, "a\nb\nc\nd"), (21, "x\na\nb\nc\nd"), (None, None)]
    names = ["_id", "_KEY", "runs", "_runs", "w", "h1", "pos", "a.b", "first"]
    docs = make_docs(rows)
    got = line_dedup(docs.select("*", *[F.lit("mine").alias(n) for n in names]))
    assert [c for c in got.columns if c in names] == names
    assert all(r[n] == "mine" for r in got.collect() for n in names)
    key = lambda r: str((r["doc_id"], r["text"], r["n_removed"]))
    assert sorted(map(key, got.collect())) == sorted(map(key, line_dedup(docs).collect()))


def test_rounds_of_components_take_as_many_tasks_as_their_edges(spark, monkeypatch):
    from wardlight.llm import components

    counts, cut = [], components.cut_lineage

    def counted(df):
        counts.append((out := cut(df)).rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components, "cut_lineage", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (300, 100)], "a long, b long")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "97")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert len(counts) > 2 and max(counts[1:]) <= components.PARTS


def test_shuffle_files_of_finished_steps_go(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    kept, before = [], files()
    for _ in range(8):  # some 50 files each
        rows = spark.range(1000, numPartitions=20).repartition(8, "id").groupBy((F.col("id") % 7).alias("g")).count()
        kept.append(shared.cut_lineage(rows))
    made = 8 * 40
    for _ in range(10):  # the last steps' files go with a later one
        if files() < before + made * 0.75:
            break
        kept.append(shared.cut_lineage(spark.range(7)))
        time.sleep(0.5)
    assert files() < before + made * 0.75 and all(k.count() == 7 for k in kept)
