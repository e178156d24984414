"""Truth tables and literal cases that the Parquet tables have no rows for."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardlight import schema
from wardlight.functions import redaction, scalars
from wardlight.operators import access, mutations, reads, uploads
from wardlight.plans import analytics
from wardlight.sources import files
from wardlight.streaming import events as ev
from wardlight.streaming import limits

NOW = dt.datetime(2024, 1, 1)
LATER, BEFORE = dt.datetime(2025, 1, 1), dt.datetime(2023, 1, 1)


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'binary' if isinstance(v, bytes) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column).first()[0]


def decision(spark, *, status="active", person=1, role="specialist", grant=None, flag="can_view"):
    accounts = spark.createDataFrame([(10, status, person)], "id int, status string, person_id int")
    patients = spark.createDataFrame([(5, 1)], "id int, person_id int")
    roles = spark.createDataFrame([(10, role)], "account_id int, role_code string")
    grants = spark.createDataFrame([(10, 5, *grant)] if grant else [], "account_id int, patient_id int, status string, expires_at timestamp, can_view boolean")
    return [r["via"] for r in access.may_access(accounts, patients, roles, grants, F.lit(NOW), flag).collect()]


def test_access_truth_table(spark):
    assert decision(spark) == ["owner"]
    assert decision(spark, status="blocked") == []
    assert decision(spark, person=2) == []
    assert decision(spark, person=2, grant=("active", LATER, True)) == ["grant"]
    assert decision(spark, person=2, grant=("active", None, True)) == ["grant"]
    assert decision(spark, person=2, grant=("active", LATER, False)) == []
    assert decision(spark, person=2, grant=("active", LATER, None)) == []
    assert decision(spark, person=2, grant=("active", LATER, False), flag=None) == ["grant"]
    assert decision(spark, person=2, grant=("active", BEFORE, True)) == []
    assert decision(spark, person=2, grant=("revoked", LATER, True)) == []
    assert decision(spark, person=2, role="client", grant=("active", LATER, True)) == []
    assert decision(spark, person=None, role="system_admin") == []


def test_role_links(spark):
    links = access.role_permissions(spark)
    assert links.count() == 25
    counts = {r["role_code"]: r["count"] for r in links.groupBy("role_code").count().collect()}
    assert counts == {"client": 4, "specialist": 9, "organization_admin": 1, "system_admin": 11}
    again = mutations.insert_missing(links, links.union(links), ["role_code", "permission_code"])
    assert again.count() == 25 and again.where("created").count() == 0


def test_unique_lookup_fails_on_two(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert reads.one_by_key(rows, k=2).collect()[0]["v"] == "c"
    with pytest.raises(Exception, match="more than one row"):
        reads.one_by_key(rows, k=1).collect()


def test_page_bounds_and_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 5)], "id int, at int")
    assert [r["id"] for r in reads.page(rows, "at", "id", 0, -3).collect()] == [1]
    assert [r["id"] for r in reads.page(rows, "at", "id", 2, 1).collect()] == [3, 2]


def test_patch_keeps_null_and_unset_apart(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    patches = spark.createDataFrame([(1, (True, None)), (2, (False, "x"))], "id int, v struct<set: boolean, value: string>")
    assert {r["id"]: r["v"] for r in mutations.patch(rows, patches, ["id"]).collect()} == {1: None, 2: "b", 3: "c"}


def test_upsert_lets_nulls_win(spark):
    rows = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "id int, v string, n int")
    changes = spark.createDataFrame([(2, None), (3, "z")], "id int, v string")
    assert sorted(map(tuple, mutations.upsert(rows, changes, ["id"]).collect())) == [(1, "a", 7), (2, None, 8), (3, "z", None)]


def test_numbering_over_ranges(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(50)], "a long, b long")
    got = [r["rn"] for r in mutations.numbered(rows, "a", "b").orderBy("a", "b").collect()]
    assert got == list(range(1, 51))


def test_quota(spark):
    accounts = spark.createDataFrame([(1, False), (2, True), (3, False)], "id int, is_subscribed boolean")
    documents = spark.createDataFrame([(1,), (1,), (2,), (2,)], "owner int")
    assert [tuple(r) for r in uploads.over_quota(accounts, documents, "owner", 1).collect()] == [(1, 2)]


def test_upload_outcomes(spark):
    rows = spark.createDataFrame(
        [("image/png", 5, True), ("text/plain", 5, True), ("image/png", 10**9, True), ("image/png", 5, False), (None, 5, True)], "mime_type string, size_bytes long, there boolean"
    ).selectExpr("*", "'t' as tenant_id", "1 as patient_id", "2 as document_id", "3 as document_version_id")
    got = [(r["outcome"], r["error_code"], r["storage_key"]) for r in uploads.upload_outcome(rows, F.col("there")).collect()]
    assert got[0] == ("stored", None, "tenants/t/patients/1/documents/2/versions/3/original.png")
    assert [g[1] for g in got[1:]] == ["unsupported_type", "too_large", "missing_file", "unsupported_type"]


def test_types_names_and_hashes(spark):
    assert one(spark, scalars.sniff_mime(F.col("c")), c=b"%PDF-1.7") == "application/pdf"
    assert one(spark, scalars.sniff_mime(F.col("c")), c=b"MM\x00*rest") == "image/tiff"
    assert one(spark, scalars.sniff_mime(F.col("c")), c=b"hello") is None
    assert one(spark, scalars.basename(F.col("p")), p="../../etc/passwd") == "passwd"
    assert one(spark, scalars.stored_name(F.col("m")), m="text/plain") == "original.bin"
    assert one(spark, scalars.chosen_mime(F.col("m"), F.col("n")), m="text/plain", n="a.JPEG") == "image/jpeg"
    assert one(spark, F.sha2("t", 256), t="hello").startswith("2cf24dba")
    assert one(spark, scalars.hmac_sha256("key")(F.col("t")), t="The quick brown fox jumps over the lazy dog").startswith("f7bc83f430538424")
    assert one(spark, scalars.normalize_email(F.col("e")), e="\t A@B.c\n") == "a@b.c"
    assert one(spark, scalars.channel(F.col("e")), e=" a@b.c") == "phone"
    assert one(spark, scalars.client_ip(F.col("f"), F.col("r"), F.lit("p")), f=" 1.2.3.4 , 5.6.7.8", r=None) == "1.2.3.4"
    assert one(spark, scalars.failure_status(F.col("f")), f="Anything") == 400
    assert one(spark, scalars.config_list(F.col("s")), s="a, b,,c ") == ["a", "b", "c"]


def test_redaction(spark):
    body = '{"a": {"PIN": 1, "deep": [{"original_filename": "x", "ok": 2}]}, "code": null}'
    assert one(spark, redaction.mask_json(F.col("b")), b=body) == '{"a": {"PIN": "<redacted>", "deep": [{"original_filename": "<redacted>", "ok": 2}]}, "code": null}'
    assert one(spark, redaction.mask_json(F.col("b")), b="no json, token: x") == "no json, token: ***"
    assert one(spark, redaction.mask_text(F.col("t")), t="Password: abc&x=1 card 1234-5678-9012-3456") == "Password: ***&x=1 card ****-****-****-****"


EVENT = "seq long, document_id long, document_version_id string, type string, succeeded boolean, checksum string, confidence double, size_bytes long, storage_key string, mime_type string, occurred_at timestamp, error_code string, extraction_id long, error_message string"
VERSION = "document_id long, document_version_id string, checksum string"


def _events(spark, *rows):
    """(version, type, succeeded) of document 1, in order."""
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, 1, v, t, ok, f"c{i}", 0.5, 10 + i, f"k{i}", "m", at + dt.timedelta(seconds=i), f"E{i}", 5, f"M{i}") for i, (v, t, ok) in enumerate(rows)], EVENT)


def test_fold_last_event_wins(spark):
    versions = spark.createDataFrame([(1, "a", None), (1, "b", None)], VERSION)
    events = _events(spark, ("a", "DocumentStored", True), ("a", "DocumentAnalysisCompleted", True), ("b", "DocumentStored", True), ("x", "DocumentStored", True), ("a", "DocumentConverted", True), ("a", "DocumentStored", True))
    known = ev.with_known(events, versions)
    got = {r["document_version_id"]: r for r in ev.folded(known.where("known"), ev.VERSIONS).collect()}
    assert {k: (r["checksum"], r["job_status"], r["first_stored_seq"]) for k, r in got.items()} == {"a": ("c5", "succeeded", 0), "b": ("c2", "queued", 2)}
    assert ev.folded(known, ev.DOCUMENTS).first()["status"] == "processing"
    assert ev.folded(events, ev.EXTRACTIONS).select("extraction_status", "confidence").first() == ("succeeded", 0.5)
    assert sorted(map(tuple, ev.to_publish(events, versions).collect())) == [(1, "a", 0), (1, "b", 2)]
    assert [r["document_version_id"] for r in ev.unknown(events, versions).collect()] == ["x"]
    told = spark.createDataFrame([(1, "a", "c"), (1, "b", None)], VERSION)
    assert [tuple(r) for r in ev.to_publish(events, told).collect()] == [(1, "b", 2)]


def test_failure_of_an_unknown_version_counts_for_its_document_only(spark):
    versions = spark.createDataFrame([(1, "a", None)], VERSION)
    events = ev.with_known(_events(spark, ("a", "DocumentConverted", True), ("x", "DocumentProcessingFailed", True)), versions)
    assert ev.folded(events, ev.DOCUMENTS).first()["status"] == "failed"
    assert [(r["job_status"], r["error_code"]) for r in ev.folded(events.where("known"), ev.VERSIONS).collect()] == [("succeeded", None)]


@pytest.mark.parametrize("fold", [ev.VERSIONS, ev.DOCUMENTS, ev.EXTRACTIONS])
def test_stream_fold_equals_batch(spark, tmp_path, fold):
    kinds, at = list(schema.EVENT_FIELDS), dt.datetime(2024, 1, 1)
    rows = [(i, i % 5, f"{i % 5}-{i % 3}", kinds[(i * 7) % 6], i % 3 == 0, f"c{i}", i / 10, i, f"k{i}", "m", at, f"E{i}", i % 4, f"M{i}") for i in range(80)]
    events = spark.createDataFrame(rows, EVENT)
    versions = spark.createDataFrame([(i, f"{i}-{v}", None) for i in range(5) for v in (0, 1)], VERSION)
    for k in range(4):
        events.where(f"seq % 4 = {k}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = ev.start_fold(stream, fold, str(tmp_path / "state"), str(tmp_path / "cp"), buckets=4, prepare=lambda b: ev.with_known(b, versions)).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = ev.current_states(spark, str(tmp_path / "state"), 3)
    want = ev.folded(ev.with_known(events, versions), fold).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    folders = [p for p in (tmp_path / "state").glob("batch=*/bucket=*")]
    assert len(folders) <= 8  # no more than the last two batches need


def test_topk_in_blocks_is_the_same(spark):
    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 6)]) for i in range(60)] + [(99, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, many = (analytics.cosine_topk(vectors, vectors.where("vec_id % 3 = 0"), 3, most_bytes=b) for b in (1 << 20, 300))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() > 0


def test_numbers_follow_strings_and_ties(spark):
    rows = spark.createDataFrame([("same", i) for i in range(50)] + [(f"k{i:03}", i) for i in range(50)] + [(None, 1)], "a string, b long").repartition(7)
    got = mutations.numbered(rows, "a", "b").collect()
    order = sorted(got, key=lambda r: (r["a"] is not None, r["a"] or "", r["b"]))
    assert [r["rn"] for r in order] == list(range(1, 102))


def test_messages(spark):
    rows = spark.createDataFrame([(1, "DocumentStored", '{"document_id": "7", "checksum": "x"}'), (2, "DocumentStored", "{broken"), (3, "Other", "{}")], "seq long, type string, body string")
    got = {r["seq"]: (r["valid"], r["event"]["checksum"]) for r in ev.parsed(rows).collect()}
    assert got == {1: (True, "x"), 2: (False, None)}
    keys = spark.createDataFrame([("a",), ("b",)], "routing_key string")
    assert files.routed(keys, " a ,,").count() == 1


def test_anchored_window():
    assert limits.anchored([0, 10, 59, 60, 61, 121], None, 0)[0] == [True, False, False, True, False, True]
    assert limits.anchored([70], 0.0, 3)[0] == [True]


def test_code_burns_after_five(spark):
    rows = spark.createDataFrame([(1, i, 1.0, i == 5) for i in range(6)] + [(2, 0, 1.0, True), (2, 1, 1.0, True), (3, 0, 400.0, True)], "code_id long, seq long, after double, correct boolean")
    got = {(r["code_id"], r["seq"]): r["outcome"] for r in limits.code_attempts(rows).collect()}
    assert got[1, 4] == "wrong" and got[1, 5] == "burned"
    assert (got[2, 0], got[2, 1], got[3, 0]) == ("accepted", "burned", "expired")


def test_file_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.bin").write_bytes(b"x")
    got = {r["file_name"]: (r["size_bytes"], r["sniffed"]) for r in files.inspected(files.uploads(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": (10, "application/pdf"), "b.bin": (1, None)}
    wanted = spark.createDataFrame([("k1",), ("k1",), ("k2",)], "storage_key string")
    assert [r[0] for r in files.missing_objects(wanted, wanted.where("storage_key = 'k2'")).collect()] == ["k1"]


def test_empty_and_domains(spark):
    grants = spark.createDataFrame([], "status string, expires_at timestamp")
    assert reads.active_grants(grants, F.lit(NOW)).count() == 0
    rows = spark.createDataFrame([("active",), ("odd",), (None,)], "status string")
    assert [r[0] for r in schema.outside_domain(rows, "status", "grant_status").collect()] == ["odd"]


def test_hmac_is_that_of_the_standard_library(spark):
    import hashlib
    import hmac

    texts = ["", "abc", "Grüße \u4e2d\u6587 \U0001f600", "x" * 1000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for secret in ("k", "ключ", "s" * 64, "s" * 65):
        got = [r[0] for r in rows.select(scalars.hmac_sha256(secret)(F.col("t"))).collect()]
        assert got == [None if t is None else hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_times_and_codes(spark):
    row = spark.createDataFrame([(dt.datetime(2024, 7, 1, 12), dt.datetime(2024, 7, 1, 12, 0, 1, 999_999))], "a timestamp_ntz, b timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            got = row.select(F.unix_seconds(scalars.as_utc(F.col("a"))), scalars.elapsed_ms(F.col("a"), F.col("b")), scalars.elapsed_ms(F.col("a"), F.lit(None).cast("timestamp"))).first()
            assert tuple(got) == (1719835200, 1999, None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    codes = spark.range(2000).select(scalars.random_code(7).alias("c"))
    assert codes.where(~scalars.is_otp(F.col("c"))).count() == 0 and codes.distinct().count() > 1900
    assert codes.where("c like '0%'").count() > 100


def test_records_are_ensured_once(spark):
    have = spark.createDataFrame([("r1", 1, NOW)], "id string, patient_id int, created_at timestamp")
    patients = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    out = mutations.ensure_records(have, patients, F.lit(LATER)).collect()
    assert sorted((r["patient_id"], r["created_at"]) for r in out) == [(1, NOW), (2, LATER)]
    assert mutations.ensure_records(have, patients.limit(0), F.lit(LATER)).collect() == have.collect()


def test_evolved_and_inserted(spark):
    table = spark.createDataFrame([(1, "a", True)], "id int, x string, gone boolean")
    after = mutations.evolved(table, {"x": "y"}, {"n": "bigint"}, ("gone",))
    assert after.dtypes == [("id", "int"), ("y", "string"), ("n", "bigint")]
    more = spark.createDataFrame([("7", "extra")], "id string, other string")
    assert [tuple(r) for r in mutations.insert_select(after, more, n=F.lit(5)).collect()] == [(1, "a", None), (7, None, 5)]


def test_notification_providers(spark):
    to = spark.createDataFrame([("a@b.c",), ("+100",), (None,)], "recipient string")
    errors = lambda provider: [r["error_code"] for r in files.addressed(to, provider).collect()]
    assert errors("console") == [None, None, "unsupported_channel"]
    assert errors("smtp") == [None, "unsupported_channel", "unsupported_channel"]
    with pytest.raises(ValueError):
        files.addressed(to, "pigeon")


def test_retries_end_with_a_dead_letter(spark):
    kinds = ["DocumentProcessingFailed"] * 5 + ["DocumentConverted"] + ["DocumentProcessingFailed"] * 4
    rows = [(i, "d", "v", k) for i, k in enumerate(kinds)] + [(99, "d", "w", "DocumentProcessingFailed"), (100, "d", "x", "DocumentConverted")]
    events = spark.createDataFrame(rows, "seq int, document_id string, document_version_id string, type string")
    got = {r["document_version_id"]: (r["n_failed"], r["outcome"]) for r in ev.retry_or_bury(events).collect()}
    assert got == {"v": (4, "dead_letter"), "w": (1, "retry")}


def test_failures_keep_their_message(spark):
    versions = spark.createDataFrame([(1, "a", None)], VERSION)
    events = ev.with_known(_events(spark, ("a", "DocumentProcessingFailed", True), ("a", "DocumentProcessingFailed", True), ("a", "DocumentStored", True)), versions)
    assert [(r["error_code"], r["error_message"]) for r in ev.folded(events.where("known"), ev.VERSIONS).collect()] == [("E1", "M1")]


def test_sketches_merge(spark):
    rows = spark.range(20_000).select((F.col("id") % 7).alias("part"), F.when(F.col("id") % 100 > 0, F.pow(F.col("id").cast("double"), 1.5)).alias("s"))
    merged = analytics.merged_quantiles(analytics.sketched(rows, "s", "part"), {"p50": 0.5, "p95": 0.95}).first()
    values = sorted(r["s"] for r in rows.where("s is not null").collect())
    assert merged["n"] == len(values) and abs(merged["mean"] - sum(values) / len(values)) < 1e-3
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        rank = sum(v <= merged[name] for v in values) / len(values)
        assert abs(rank - q) < 0.02
    assert analytics.merged_quantiles(analytics.sketched(rows.limit(0), "s", "part"), {"p50": 0.5}, "part").collect() == []


def test_timelines_are_newest_first(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    a = spark.createDataFrame([(1, 1, at(5)), (1, 2, None), (2, 3, at(1)), (None, 9, at(1))], "p long, i long, t timestamp")
    b = spark.createDataFrame([(1, 7, at(5)), (1, 6, at(5)), (1, 5, at(9))], "p long, i long, t timestamp")
    got = analytics.ordered_timeline(("b", b, "p", "i", "t"), ("a", a, "p", "i", "t")).orderBy("patient_id", "place").collect()
    assert [(r["patient_id"], r["kind"], r["item_id"], r["place"]) for r in got] == [(1, "b", 5, 1), (1, "a", 1, 2), (1, "b", 6, 3), (1, "b", 7, 4), (1, "a", 2, 5), (2, "a", 3, 1)]


def test_saved_sessions_keep_account_and_creation(spark):
    columns = ["id", "account_id", "created_at", *mutations.SESSION_COLUMNS]
    kinds = ", ".join(f"{c} {'long' if c in ('id', 'account_id') else 'timestamp' if c.endswith('_at') else 'string'}" for c in columns)
    at = lambda d: dt.datetime(2024, 1, d)
    row = lambda i, account, day, tag: (i, account, at(day), f"h{tag}", at(day), at(day), at(day), f"u{tag}", f"i{tag}", f"d{tag}", f"p{tag}", f"v{tag}")
    table = spark.createDataFrame([row(1, 10, 1, "a"), row(2, 20, 1, "b")], kinds)
    empty = (2, 99, at(9), None, None, None, at(9), None, None, None, None, None)
    saved = spark.createDataFrame([empty, row(2, 98, 5, "x"), row(3, 30, 2, "c"), row(None, 1, 1, "n")], kinds)
    got = {r["id"]: tuple(r) for r in mutations.save_sessions(table, saved).collect()}
    assert got == {1: row(1, 10, 1, "a"), 2: (2, 20, at(1), None, None, None, at(9), *[None] * 5), 3: row(3, 30, 2, "c")}
    assert mutations.save_sessions(table.limit(0), saved.limit(0)).collect() == []


def test_lists_come_in_order(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5) for i in range(40)], "id long, at int").repartition(6)
    want = sorted(range(40), key=lambda i: (i % 7 != 0, -(i % 5) if i % 7 else 0, -i))
    assert [r["id"] for r in reads.newest_first(rows, "at", "id").collect()] == want
    assert [r["id"] for r in reads.page(rows, "at", "id", 5, 3).collect()] == want[3:8]
    assert [r["id"] for r in reads.page(rows, "at", "id", 0, -2).collect()] == want[:1]
