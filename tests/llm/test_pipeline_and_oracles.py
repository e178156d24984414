"""The pipeline stage by stage against brute force, and the SQL-expressible operators against DuckDB."""

import collections
import os
import re
import sys
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from wardlight.llm import queries as q

sys.path.insert(0, os.path.dirname(__file__))
from .test_dedup import brute_classes, brute_lines  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")


def plain(v):
    if v is None or v is pd.NA or v != v:
        return "~"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    ours = q.queries()[name](spark, DIR).toPandas()
    theirs = con.sql(q.oracle_sql()[name]).df()[list(ours.columns)]
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False))
    assert rows(ours) == rows(theirs)


def test_stages(spark, tmp_path):
    docs, kept = q.documents(spark, DIR), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept[name] = (docs, after)
        docs = after
    for name, _ in cp.STAGES[:-1]:
        assert tuple(kept[name][1].columns) == cp.COLUMNS
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]

    def by_sql(name, table):
        con = duckdb.connect()
        con.register("given", table.toArrow())
        con.sql("create view documents as select * from given")
        return con.sql(q.oracle_sql()[name])

    before, after = kept["quality rules"]
    want = [r[0] for r in by_sql("op7_quality_rules", before).filter("kept").select("doc_id").fetchall()]
    assert sorted(i for i, _ in texts(after)) == sorted(want) and 0 < len(want) < before.count()

    before, after = kept["line dedup"]
    want = [(i, t) for i, t, n, gone in brute_lines(texts(before)) if gone < n or not gone]
    assert sorted(texts(after), key=str) == sorted(want, key=str)

    before, after = kept["near dedup"]
    want = sorted(i for i, (_, _, keep) in brute_classes(texts(before)).items() if keep)
    assert sorted(i for i, _ in texts(after)) == want

    before, after = kept["source mixing"]
    known = dict(texts(before))
    taken = by_sql("op1_source_mixing", before).select("doc_id, n_tokens, n_taken").fetchall()
    want = [(i, known[i] if got == n else re.match(rf"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){{{got}}}", known[i])[0]) for i, n, got in taken]
    assert sorted(texts(after)) == sorted(want)
    assert any(got < n for _, n, got in taken) and after.where("n_chars <> length(text)").count() == 0

    before, after = kept["packing"]
    tokenizer = Tokenizer.from_file(q.tokenizer_file("byte_bpe_50k.json"))
    ids = [(i, [*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for i, t in texts(before)]
    want = collections.Counter((i, len(x)) for i, x in ids)
    assert collections.Counter((r[0], r[1]) for r in after.where("start = 0").select("doc_id", "doc_tokens").collect()) == want
    first = {(i, len(x)): x for i, x in ids}
    for r in after.collect():
        part = np.array(first[r["doc_id"], r["doc_tokens"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    assert after.agg(F.sum("length")).first()[0] == sum(len(x) for _, x in ids)


def test_stages_on_odd_documents(spark, make_docs):
    from .conftest import ODD

    for rows in (ODD, []):
        docs = make_docs(rows).select(*cp.COLUMNS)
        for _, stage in cp.STAGES:
            stage(spark, docs, DIR).collect()


def test_near_dedup_keeps_rows_without_id_and_the_first_of_an_id(spark, make_docs):
    rows = [(None, "no id"), (None, None), (1, "zz other words"), (1, "aa some words"), (1, None), (2, None)]
    docs = make_docs(rows).select(*cp.COLUMNS)
    got = [(r["doc_id"], r["text"]) for r in cp.drop_near_duplicates(spark, docs, DIR).collect()]
    assert sorted(got, key=str) == sorted([(None, "no id"), (None, None), (1, "aa some words"), (2, None)], key=str)


def test_mixing_takes_repeated_rows_each(spark, make_docs):
    rows = [(1, "one two three", "en", "src0")] * 3 + [(1, "another text here now", "en", "src0"), (2, "a b", "en", "src0"), (None, "no id", "en", "src0")]
    docs = make_docs(rows).select(*cp.COLUMNS)
    want = q.mix(docs, q.domain_of(), percent=q.MIX_PERCENT, max_epochs=q.MIX_EPOCHS, weights=q.MIX_WEIGHTS, seed=q.MIX_SEED).collect()
    got = cp.mix_sources(spark, docs, DIR).collect()
    assert len(got) == len(want) and {r["doc_id"] for r in got} <= {1, 2}
    assert sum(len(r["text"].split()) for r in got) == sum(r["n_taken"] for r in want)
