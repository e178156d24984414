"""Masked bodies against a plain version over generated JSON."""

import json
import random

from pyspark.sql import functions as F

from wardlight.functions import redaction as rd

NAMES = ["a", "k", "Kind", "userEmail", "PIN", "token_x", "pa\\ss", "p\"in", "sécret", "Secret\n", "x:y", "size", "", "日本", "nested", "session id", "author"]


def made(r, depth=0):
    kind = r.randrange(9 if depth < 5 else 6)
    if kind < 6:
        return [None, True, 1.5, "plain", 'q"uo\\te: {[,]}', -12][kind]
    if kind < 8:
        return {r.choice(NAMES): made(r, depth + 1) for _ in range(r.randrange(5))}
    return [made(r, depth + 1) for _ in range(r.randrange(4))]


def plain(value):
    if isinstance(value, list):
        return [plain(v) for v in value]
    if not isinstance(value, dict):
        return value
    return {k: (None if v is None else rd.REDACTED) if any(t in k.lower() for t in rd.FIELD_TERMS) else plain(v) for k, v in value.items()}


def masked(spark, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").select("i", rd.mask_json(F.col("body")).alias("m"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    return [r["m"] for r in rows.orderBy("i").collect()]


def test_json_of_any_depth(spark):
    r = random.Random(1)
    values = [made(r) for _ in range(400)] + [[{"a": {"b": {"c": {"password": {"d": [1, {"e": "]}"}]}, "z": 1}}}}], {"password": [1, [2]], "n": 0}]
    bodies = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=(None, 1)[i % 3 == 0]) for i, v in enumerate(values)]
    bodies += ['{"\\u0070assword" : {"a": [1]}, "x": [ 1 , 2 ]}', '{"auth":{},"b":[],"code":[]}']
    got = masked(spark, bodies)
    for body, m in zip(bodies, got, strict=True):
        assert json.loads(m) == plain(json.loads(body)), body


def test_the_rest_keeps_its_spelling(spark):
    assert masked(spark, ['{ "pin" :12, "x":1.50e3 }', "[]", "5", '"token"', None]) == ['{ "pin" :"<redacted>", "x":1.50e3 }', "[]", "5", '"token"', None]


def test_long_bodies(spark):
    deep = "[" * 400 + '{"pin": 1}' + "]" * 400
    wide = json.dumps({f"k{i}": {"email": i, "n": i} for i in range(20_000)})
    got = masked(spark, [deep, wide])
    assert '"pin": "<redacted>"' in got[0]
    assert json.loads(got[1]) == plain(json.loads(wide))


def test_what_is_no_json_is_masked_as_text(spark):
    got = masked(spark, ["user=1&password=abc&n=2", '{"password": "abc", ', "token: x1 4111 1111 1111 1111", ""])
    assert got == ["user=1&password=***&n=2", '{"password": "abc", ', "token: *** ****-****-****-****", ""]


def test_bodies_by_bytes(spark):
    bodies = [b'{"pin": 1}', b"name=x", "é".encode() * 6, b"\xff\xfe", b"", None, b"a" * 13]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body binary")
    got = [r["m"] for r in rows.select("i", rd.logged_body(F.col("body"), 12).alias("m")).orderBy("i").collect()]
    assert got == ['{"pin": "<redacted>"}', "name=***", "é" * 6, "<binary data: 2 bytes>", None, None, "<body too large: 13 bytes>"]
    text = spark.createDataFrame([("é" * 6,), ("é" * 7,)], "t string").select(rd.capped_body(F.col("t"), 12).alias("m"))
    assert [r["m"] for r in text.collect()] == ["é" * 6, "<body too large: 14 bytes>"]
