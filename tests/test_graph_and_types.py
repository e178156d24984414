"""Deletes over the graph of foreign keys, and typed extractions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wardlight.operators import access
from wardlight.operators import foreign_keys as fk
from wardlight.operators.typed import seen_schema, typed


def plain(tables, doomed, keys):
    """Row by row, until nothing changes; every row is a dict with id."""
    gone = {t: set(doomed.get(t, ())) & {r["id"] for r in rows} for t, rows in tables.items()}
    while True:
        more = [(k.child, r["id"]) for k in keys if k.action == fk.CASCADE for r in tables[k.child] if r[k.column] is not None and r[k.column] in gone[k.parent] and r["id"] not in gone[k.child]]
        if not more:
            break
        for t, i in more:
            gone[t].add(i)
    left = {t: [dict(r) for r in rows if r["id"] not in gone[t]] for t, rows in tables.items()}
    for k in keys:
        for r in left[k.child]:
            if r[k.column] in gone[k.parent]:
                if k.action == fk.RESTRICT:
                    raise fk.Restricted
                if k.action == fk.SET_NULL:
                    r[k.column] = None
    return left, gone


KEYS = (
    fk.ForeignKey("b", "a_id", "a", fk.CASCADE),
    fk.ForeignKey("c", "a_id", "a", fk.SET_NULL),
    fk.ForeignKey("c", "b_id", "b", fk.CASCADE),
    fk.ForeignKey("d", "c_id", "c", fk.CASCADE),
    fk.ForeignKey("d", "b_id", "b", fk.SET_NULL),
    fk.ForeignKey("e", "d_id", "d", fk.RESTRICT),
    fk.ForeignKey("missing", "a_id", "a", fk.CASCADE),
)


@pytest.mark.parametrize("seed", range(3))
def test_deletes_over_the_graph(spark, seed):
    r = random.Random(seed)
    some = lambda n: r.choice([None, *range(n), 999])
    tables = {
        "a": [{"id": i} for i in range(8)],
        "b": [{"id": i, "a_id": some(8)} for i in range(12)],
        "c": [{"id": i, "a_id": some(8), "b_id": some(12)} for i in range(15)],
        "d": [{"id": i, "b_id": some(12), "c_id": some(15)} for i in range(20)],
    }
    kinds = {"a": "id long", "b": "id long, a_id long", "c": "id long, a_id long, b_id long", "d": "id long, b_id long, c_id long"}
    frames = {t: spark.createDataFrame([tuple(x.values()) for x in rows], kinds[t]) for t, rows in tables.items()}
    asked = {"a": [0, 3, 77], "c": [1]}
    doomed = {t: spark.createDataFrame([(i,) for i in [*ids, ids[0], None]], "id long") for t, ids in asked.items()}
    left, gone = fk.deleted(frames, doomed, KEYS)
    want, away = plain(tables, asked, [k for k in KEYS if k.child in tables])
    for t in tables:
        assert sorted(map(str, (x.asDict() for x in left[t].collect()))) == sorted(map(str, want[t]))
        assert sorted(x["id"] for x in gone[t].collect()) == sorted(away[t])


def test_restricted_and_circular(spark):
    a, d = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(5, 1), (6, None)], "id long, a_id long")
    keys = (fk.ForeignKey("d", "a_id", "a", fk.RESTRICT),)
    with pytest.raises(fk.Restricted):
        fk.deleted({"a": a, "d": d}, {"a": a.where("id = 1")}, keys)
    left, _ = fk.deleted({"a": a, "d": d}, {"a": a.where("id = 2")}, keys)
    assert left["d"].count() == 2 and left["a"].count() == 1
    left, _ = fk.deleted({"a": a, "d": d}, {"a": a.where("id = 1"), "d": d.where("id = 5")}, keys)
    assert [x["id"] for x in left["d"].collect()] == [6]
    with pytest.raises(ValueError, match="circle"):
        fk.in_order(["a", "b"], (fk.ForeignKey("a", "x", "b", fk.CASCADE), fk.ForeignKey("b", "x", "a", fk.CASCADE)))
    assert fk.in_order([k.child for k in fk.FOREIGN_KEYS][::-1] + ["person"], ())  # without keys any order is one


REGISTRY = {("lab", "1"): {"name": ("$.name", "string", True), "low": ("$.range.low", "double", False), "n": ("$.n", "int", True)}}


def test_typed(spark):
    rows = {
        1: ("lab", "1", {"name": "a", "range": {"low": 1.5}, "n": 3}, (None, ("a", 1.5, 3))),
        2: ("lab", "1", {"name": "a", "n": 3, "more": [1]}, (None, ("a", None, 3))),
        3: ("lab", "1", {"name": "a", "range": {"low": None}, "n": 3}, (None, ("a", None, 3))),
        4: ("lab", "1", {"range": {"low": "x"}, "n": 3}, ("$.name", None)),
        5: ("lab", "1", {"name": "a", "range": {"low": "x"}, "n": 3}, ("$.range.low", None)),
        6: ("lab", "1", {"name": "a", "n": None}, ("$.n", None)),
        7: ("lab", "1", "[1]", ("$", None)),
        8: ("lab", "1", "{cut", ("$", None)),
        9: ("lab", "1", None, ("$", None)),
        10: ("lab", "2", {"z": 1}, (None, None)),
        11: (None, None, {"z": 1}, (None, None)),
    }
    table = spark.createDataFrame([(i, s, v, json.dumps(d) if isinstance(d, dict) else d) for i, (s, v, d, _) in rows.items()], "id int, schema_name string, schema_version string, data string")
    out = typed(table, REGISTRY)
    got = {r["id"]: (r["broken"], tuple(r["lab_v1"]) if r["lab_v1"] else None) for r in out.collect()}
    assert got == {i: want for i, (*_, want) in rows.items()}
    assert [r["id"] for r in out.where("other is not null").orderBy("id").collect()] == [10, 11]
    assert typed(table.limit(0), REGISTRY).collect() == []
    seen = {r["schema_version"]: r["seen"] for r in seen_schema(table.where("id in (2, 10)")).collect()}
    assert "more: ARRAY<BIGINT>" in seen["1"] and "z: BIGINT" in seen["2"]


def test_permissions_need_no_shuffle_by_role(spark):
    roles, permissions, links = access.catalogue(spark)
    held = spark.range(1000).select(F.col("id").alias("account_id"), (F.col("id") % 5 + 1).cast("int").alias("role_id"))
    out = access.permissions_of(held, links, permissions)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan or "broadcast" in plan.lower()
    assert out.count() == 200 * (4 + 9 + 1 + 11)
