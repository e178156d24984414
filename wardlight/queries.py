"""The registered queries over the clinical entities, each beside the DuckDB SQL with the same result."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import redaction, scalars
from .operators import access, foreign_keys, mutations, reads, typed, uploads
from .plans import analytics, vector_index
from .session import shared_path
from .sources import artifacts, files, ledger, messages, objects
from .sources.projection import NOW, entity, oracle_views, table
from .streaming import events as ev
from .streaming import keyed, limits
from .streaming.scaling import windowed_counts as _windowed

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


_NOW_SQL = f"timestamp '{NOW}'"


def _query(sql: str | None = None, views: str = ""):
    """Registers a function (get, spark, sf_dir) -> DataFrame, where ``get`` reads an entity, under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: entity(spark, sf_dir, name), spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        text = None if sql is None else (oracle_views(*views.split()) + " " + sql if views else sql)
        _FOUND[f.__name__] = (run, text)
        return f

    return add


_LINKS = "(values " + ", ".join(f"('{r}', '{p}')" for r, ps in schema.ROLE_PERMISSIONS.items() for p in ps) + ") as links(role_code, permission_code)"
_EMAIL_SQL = "lower(regexp_replace(email, '^\\s+|\\s+$', '', 'g'))"

# ---------------------------------------------------------------------- reads


@_query("select * from account where id = 42", "account")
def key_lookup(get, spark, sf_dir):
    return reads.by_key(get("account"), id=42)


@_query("select * from specialist where person_id = 7", "specialist")
def unique_lookup(get, spark, sf_dir):
    return reads.one_by_key(get("specialist"), person_id=7)


@_query(f"select id, email from account where email = 'customer#000000042@example.com' or {_EMAIL_SQL} = 'customer#000000042@example.com'", "account")
def identity_lookup(get, spark, sf_dir):
    return reads.by_identity(get("account"), "customer#000000042@example.com").select("id", "email")


@_query("select * from access_grant where account_id = 5 and patient_id = 11", "access_grant")
def grant_lookup(get, spark, sf_dir):
    return reads.by_key(get("access_grant"), account_id=5, patient_id=11)


@_query(f"select patient_id, account_id, expires_at from access_grant where status = 'active' and (expires_at is null or expires_at > {_NOW_SQL}) and can_view_documents", "access_grant")
def active_grants(get, spark, sf_dir):
    return reads.active_grants(get("access_grant"), _now(), "can_view_documents").select("patient_id", "account_id", "expires_at")


@_query("select * from audit_log where action = 'purchase' order by created_at desc, id desc limit 100 offset 50", "audit_log")
def audit_search(get, spark, sf_dir):
    return reads.page(reads.search(get("audit_log"), action="purchase", patient_id=None), "created_at", "id", 100, 50)


@_query("select id, account_id from session_row where revoked_at is null and expires_at > timestamp '1995-01-01 00:00:00'", "session_row")
def session_valid(get, spark, sf_dir):
    return reads.valid_sessions(get("session_row"), F.lit("1995-01-01").cast("timestamp_ntz")).select("id", "account_id")


@_query("select id, size_bytes, status from document where medical_record_id = 3", "document")
def documents_by_record(get, spark, sf_dir):
    return reads.newest_first(reads.by_key(get("document"), medical_record_id=3), "size_bytes", "id").select("id", "size_bytes", "status")


@_query("select id, started_at, status from encounter where medical_record_id = 3", "encounter")
def encounters_by_record(get, spark, sf_dir):
    return reads.newest_first(reads.by_key(get("encounter"), medical_record_id=3), "started_at", "id").select("id", "started_at", "status")


@_query("select version, s3_key from document_version where document_id = 5", "document_version")
def versions_ascending(get, spark, sf_dir):
    return reads.by_key(get("document_version"), document_id=5).select("version", "s3_key").orderBy("version")


@_query("select distinct role_code from account_role", "account_role")
def roles_sorted(get, spark, sf_dir):
    """The roles that accounts hold, in order."""
    return get("account_role").select("role_code").distinct().orderBy("role_code")


@_query("select document_id, max(version) as version, max_by(s3_key, version) as s3_key from document_version group by document_id", "document_version")
def latest_version(get, spark, sf_dir):
    return reads.newest_of_each(get("document_version"), ["document_id"], F.desc("version")).select("document_id", "version", "s3_key")


_FLAGS = ["can_view_documents", "can_upload_documents"]


@_query(
    f""", g as (select patient_id, account_id % 3 as account_id, account_id as id, created_at, can_view_documents, can_upload_documents from access_grant where status = 'active' and (expires_at is null or expires_at > {_NOW_SQL})),
    f as (select patient_id, account_id, id, created_at, 'can_view_documents' as flag from g where can_view_documents union all select patient_id, account_id, id, created_at, 'can_upload_documents' from g where can_upload_documents)
    select patient_id, account_id, flag, id, created_at from (select *, row_number() over (partition by patient_id, account_id, flag order by created_at desc, id desc) as k from f) where k = 1""",
    "access_grant",
)
def newest_grant(get, spark, sf_dir):
    """Of each patient, account and flag the newest active grant."""
    grants = reads.active_grants(get("access_grant"), _now())
    return access.newest_by_flag(grants.withColumn("id", F.col("account_id")).withColumn("account_id", F.col("account_id") % 3), _FLAGS)


@_query("select account_id, organization_id from (select *, row_number() over (partition by account_id order by joined_no desc) as k from membership where status = 'active') where k = 1", "membership")
def newest_membership(get, spark, sf_dir):
    return reads.newest_of_each(get("membership").where("status = 'active'"), ["account_id"], F.desc("joined_no")).select("account_id", "organization_id")


@_query("select id from (select id, row_number() over (order by started_at, id) as k from encounter where status = 'in_progress') where k = 1", "encounter")
def earliest_open(get, spark, sf_dir):
    return get("encounter").where("status = 'in_progress'").orderBy("started_at", "id").limit(1).select("id")


@_query("select id, case when size_bytes <= 0 then 'size' when size_bytes > 5000 then 'size' when not regexp_matches(path, '\\.(PDF|jpg|png|tiff)$') then 'name' end as reason from document", "document")
def payload_checks(get, spark, sf_dir):
    rules = {"size": (F.col("size_bytes") > 0) & (F.col("size_bytes") <= 5000), "name": F.col("path").rlike(r"\.(PDF|jpg|png|tiff)$")}
    return reads.checked(get("document"), **rules).select("id", "reason")


@_query("select p.id as patient_id, n.full_name, n.sex from patient p join person n on p.person_id = n.id", "patient person")
def patient_profile(get, spark, sf_dir):
    person = get("person").withColumnRenamed("id", "person_id")
    return get("patient").join(person, "person_id").select(F.col("id").alias("patient_id"), "full_name", "sex")


@_query(
    f"""select id, case when first_name is null and date_of_birth is null and sex is null then 'empty' when first_name = '' then 'first_name' when date_of_birth > {_NOW_SQL} then 'date_of_birth'
    when sex = 'unknown' then 'sex' end as reason from profile_patch""",
    "profile_patch",
)
def patch_checks(get, spark, sf_dir):
    return get("profile_patch").select("id", reads.patch_reason(["first_name", "date_of_birth", "sex"], _now()).alias("reason"))


@_query("select doc_id as id, case when doc_id % 6 = 0 and doc_id % 2 = 0 or doc_id % 6 in (1, 4) and doc_id % 2 = 1 then null else 'unsupported_type' end as error_code from documents")
def declared_types(get, spark, sf_dir):
    """Whether a file's leading bytes are of its declared type: PDF, PNG, JPEG, TIFF, bytes of no type, none at all."""
    heads = ["255044462D312E34", "89504E470D0A1A0A", "FFD8FFE000104A46", "49492A00", "0000000000", ""]
    head = F.get(F.array(*map(F.lit, heads)), (F.col("doc_id") % 6).cast("int"))
    declared = F.when(F.col("doc_id") % 2 == 0, "Application/PDF").otherwise("image/png")
    staged = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.unhex(head).alias("content"), declared.alias("declared"))
    return files.accepted(staged).select("id", "error_code")


# ---------------------------------------------------------------------- joins


@_query("select id, a.role_code from account a join account_role r on a.id = r.account_id where a.status = 'active'", "account account_role")
def account_roles(get, spark, sf_dir):
    able = get("account").where("status = 'active'").select("id")
    return able.join(get("account_role").withColumnRenamed("account_id", "id"), "id")


@_query(f"select distinct account_id, permission_code from account_role join {_LINKS} using (role_code)", "account_role")
def account_permissions(get, spark, sf_dir):
    """From accounts with role ids by way of the tables of roles, their links and permissions."""
    roles, permissions, links = access.catalogue(spark)
    held = get("account_role").join(F.broadcast(roles), "role_code").select("account_id", "role_id")  # five roles
    return access.permissions_of(held, links, permissions)


@_query("select a.id, a.status, p.full_name from account a left join person p on a.person_id = p.id", "account person")
def account_person_left(get, spark, sf_dir):
    return get("account").join(get("person").toDF("person_id", "full_name", "sex"), "person_id", "left").select("id", "status", "full_name")


@_query("select d.id as document_id, r.patient_id from document d join medical_record r on d.medical_record_id + 1000000 = r.id", "document medical_record")
def document_owner_chain(get, spark, sf_dir):
    """From document by its medical record to the patient."""
    return reads.owners(get("document").withColumn("medical_record_id", F.col("medical_record_id") + 1000000), get("medical_record"))


@_query("select j.id, j.job_status, d.id as document_id, r.patient_id from processing_job j join document d on j.job_document_id = d.id join medical_record r on d.medical_record_id + 1000000 = r.id", "processing_job document medical_record")
def job_owner_chain(get, spark, sf_dir):
    """From job by document and medical record to the patient; a job whose chain is broken is not found."""
    owned = reads.owners(get("document").withColumn("medical_record_id", F.col("medical_record_id") + 1000000), get("medical_record"))
    return get("processing_job").withColumnRenamed("job_document_id", "document_id").join(owned, "document_id").select("id", "job_status", "document_id", "patient_id")


@_query("select a.id, s.id as specialist_id from account a left join specialist s on a.person_id = s.person_id", "account specialist")
def account_specialist(get, spark, sf_dir):
    return get("account").join(get("specialist").select("person_id", F.col("id").alias("specialist_id")), "person_id", "left").select("id", "specialist_id")


@_query("select p from (select distinct permission_code as p from " + _LINKS + " where role_code in (select role_code from account_role where account_id in (1, 2, 3)))", "account_role")
def permission_semi(get, spark, sf_dir):
    held = get("account_role").where(F.col("account_id").isin(1, 2, 3)).select("role_code")
    return access.role_permissions(spark).join(held, "role_code", "left_semi").select(F.col("permission_code").alias("p")).distinct()


@_query("select id from account a where exists (select 1 from access_grant g where g.patient_id = a.id and g.status = 'active')", "account access_grant")
def has_active_grant(get, spark, sf_dir):
    return get("account").select("id").join(get("access_grant").where("status = 'active'").select(F.col("patient_id").alias("id")), "id", "left_semi")


@_query("select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def unlabelled_documents(get, spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


_DECISION = f"""
able as (select id as account_id, person_id from account where status = 'active'),
own as (select distinct a.account_id, p.id as patient_id from able a join patient p on a.person_id = p.person_id),
given as (select distinct g.account_id, g.patient_id from access_grant g join able using (account_id)
 where g.account_id in (select account_id from account_role where role_code = 'specialist') and g.status = 'active' and (g.expires_at is null or g.expires_at > {_NOW_SQL}) and g.can_view_documents),
allowed as (select account_id, patient_id, 'owner' as via from own union all
 select g.account_id, g.patient_id, 'grant' as via from given g where not exists (select 1 from own o where o.account_id = g.account_id and o.patient_id = g.patient_id))"""


def _allowed(get) -> DataFrame:
    return access.may_access(get("account"), get("patient"), get("account_role"), get("access_grant"), _now(), "can_view_documents")


@_query(f", {_DECISION} select * from allowed", "account patient account_role access_grant")
def access_decision(get, spark, sf_dir):
    return _allowed(get)


@_query(
    f", {_DECISION}, requests as (select distinct user_id % 50 as account_id, user_id % 40 as patient_id from events) select r.account_id as actor_account_id, 'view_document' as action, r.patient_id, a.via is not null as allowed from requests r left join allowed a using (account_id, patient_id)",
    "account patient account_role access_grant",
)
def access_audit(get, spark, sf_dir):
    requests = table(spark, sf_dir, "events").selectExpr("user_id % 50 as account_id", "user_id % 40 as patient_id").distinct()
    rows = access.audit_rows(access.decided(requests, _allowed(get)), "view_document", _now())
    return rows.select("actor_account_id", "action", "patient_id", F.get_json_object("metadata", "$.allowed").cast("boolean").alias("allowed"))


@_query(
    f"""select specialist_id, patient_id, encounter_id from (
      select s.id as specialist_id, g.patient_id, e.id as encounter_id, row_number() over (partition by s.id, g.patient_id order by e.started_at desc, e.id desc) as k
      from specialist s join access_grant g on g.account_id = s.id join encounter e on e.medical_record_id = g.patient_id
      where s.active and g.status = 'active' and g.can_view_documents and (g.expires_at is null or g.expires_at > {_NOW_SQL})) where k = 1""",
    "specialist access_grant encounter",
)
def authorised_latest_encounter(get, spark, sf_dir):
    """For each active specialist, the latest encounter of every patient whose documents they may view."""
    latest = reads.newest_of_each(get("encounter"), ["medical_record_id"], F.desc("started_at"), F.desc("id")).select(F.col("medical_record_id").alias("patient_id"), F.col("id").alias("encounter_id"))
    grants = reads.active_grants(get("access_grant"), _now(), "can_view_documents")
    able = get("specialist").where("active").select(F.col("id").alias("account_id"))
    return grants.join(able, "account_id", "left_semi").join(latest, "patient_id").select(F.col("account_id").alias("specialist_id"), "patient_id", "encounter_id")


# ----------------------------------------------------------- aggregates, sets


@_query("select a.id, coalesce(n, 0) as n_documents from account a left join (select medical_record_id, count(*) as n from document group by 1) d on d.medical_record_id = a.id where not is_subscribed and coalesce(n, 0) >= 10", "account document")
def quota_violations(get, spark, sf_dir):
    return uploads.over_quota(get("account"), get("document"), "medical_record_id")


@_query("select medical_record_id, count(*) as n from document group by medical_record_id", "document")
def documents_owned(get, spark, sf_dir):
    return get("document").groupBy("medical_record_id").agg(F.count("*").alias("n"))


@_query("select d.id, coalesce(max(version), 0) + 1 as next_version from document d left join document_version v on v.document_id = d.id group by d.id", "document document_version")
def next_version(get, spark, sf_dir):
    return mutations.next_versions(get("document"), get("document_version"))


@_query("select account_id, bool_or(role_code in ('system_admin', 'support')) as allowed from account_role group by account_id", "account_role")
def role_overlap(get, spark, sf_dir):
    return access.holds_any(get("account_role"), ["system_admin", "support"])


_WANTED = "select distinct c_custkey as account_id, case when c_nationkey < 10 then 'client' else 'specialist' end as role_code from customer"


@_query(f", wanted as ({_WANTED}) select account_id, role_code, 'remove' as change from (select * from account_role except select * from wanted) union all select account_id, role_code, 'add' from (select * from wanted except select * from account_role)", "account_role")
def role_difference(get, spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").selectExpr("c_custkey as account_id", "case when c_nationkey < 10 then 'client' else 'specialist' end as role_code")
    return mutations.set_difference(get("account_role"), wanted, ["account_id", "role_code"])


@_query(f"select account_id, permission_code from (select account_id from account_role where role_code = 'system_admin') cross join (select distinct permission_code from {_LINKS})", "account_role")
def admin_permissions(get, spark, sf_dir):
    admins = get("account_role").where("role_code = 'system_admin'").select("account_id")
    return admins.withColumn("permission_code", F.explode(F.array(*map(F.lit, schema.ENUMS["permission"]))))


@_query("select x.id as encounter_id, y.id as event_id from (select id, row_number() over (order by started_at, id) as rn from encounter) x join (select id, row_number() over (order by created_at, id) as rn from audit_log) y using (rn)", "encounter audit_log")
def zip_backfill(get, spark, sf_dir):
    left = get("encounter").select(F.col("id").alias("encounter_id"), "started_at")
    right = get("audit_log").select(F.col("id").alias("event_id"), "created_at")
    return mutations.zip_rows(left, ["started_at", "encounter_id"], right, ["created_at", "event_id"]).select("encounter_id", "event_id")


# -------------------------------------------------------------------- scalars


@_query(f"select id, {_EMAIL_SQL} as normalized, lower(trim(email)) as normalized_sql, case when regexp_matches(trim(coalesce(email, phone)), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') then 'email' else 'phone' end as channel from account", "account")
def email_channel(get, spark, sf_dir):
    e = F.col("email")
    return get("account").select("id", scalars.normalize_email(e).alias("normalized"), scalars.normalize_email_sql(e).alias("normalized_sql"), scalars.channel(F.trim(F.coalesce("email", "phone"))).alias("channel"))


_MIME_SQL = "case ext when 'pdf' then 'application/pdf' when 'jpg' then 'image/jpeg' when 'jpeg' then 'image/jpeg' when 'png' then 'image/png' when 'tif' then 'image/tiff' when 'tiff' then 'image/tiff' end"


@_query(
    f""", n as (select *, regexp_extract(path, '[^/]*$') as file_name from document), x as (select *, lower(regexp_extract(file_name, '[^.]\\.([^.]+)$', 1)) as ext from n)
    select id, file_name, ext as extension, case when content_type = 'application/pdf' then content_type else {_MIME_SQL} end as mime,
     'original.' || case (case when content_type = 'application/pdf' then content_type else {_MIME_SQL} end) when 'application/pdf' then 'pdf' when 'image/jpeg' then 'jpg' when 'image/png' then 'png' when 'image/tiff' then 'tiff' else 'bin' end as stored_name,
     coalesce(nullif(title, ''), regexp_replace(file_name, '([^.])\\.[^.]+$', '\\1')) as title from x""",
    "document",
)
def mime_and_name(get, spark, sf_dir):
    name = scalars.basename(F.col("path"))
    mime = scalars.chosen_mime(F.col("content_type"), name)
    return get("document").select("id", name.alias("file_name"), scalars.extension(name).alias("extension"), mime.alias("mime"), scalars.stored_name(mime).alias("stored_name"), scalars.title_or_stem(F.col("title"), name).alias("title"))


@_query("select doc_id, sha256(text) as checksum from documents")
def sha256_text(get, spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


@_query("select document_id, version, 'tenants/main/patients/' || (document_id % 100) || '/documents/' || document_id || '/versions/' || version || '/original.pdf' as storage_key from document_version", "document_version")
def object_key(get, spark, sf_dir):
    key = scalars.object_key(F.lit("main"), F.expr("document_id % 100"), F.col("document_id"), F.col("version"), F.lit("original.pdf"))
    return get("document_version").select("document_id", "version", key.alias("storage_key"))


@_query("select event_id, case when user_id % 3 = 0 then '10.0.0.' || (user_id % 200) when user_id % 3 = 1 then '172.16.0.1' else '127.0.0.1' end as client_ip, case when event_id % 600 >= 500 then 'error' when event_id % 600 >= 400 then 'warning' else 'info' end as level from events")
def client_ip(get, spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "case when user_id % 3 = 0 then concat(' 10.0.0.', user_id % 200, ' , 9.9.9.9') else '' end as forwarded", "case when user_id % 3 = 1 then '172.16.0.1' end as real_ip")
    return e.select("event_id", scalars.client_ip(F.col("forwarded"), F.col("real_ip"), F.lit("127.0.0.1")).alias("client_ip"), scalars.log_level(F.col("event_id") % 600).alias("level"))


def _masked_sql(x: str) -> str:
    for name in redaction.TEXT_NAMES:
        x = f"regexp_replace({x}, '({name}[=:]\\s*)([^&\\s\\n\\r]+)', '\\1***', 'gi')"
    return f"regexp_replace({x}, '\\d{{4}}[-\\s]?\\d{{4}}[-\\s]?\\d{{4}}[-\\s]?\\d{{4}}', '****-****-****-****', 'g')"


@_query(f"select doc_id, md5({_masked_sql('text')}) as masked_md5 from documents")
def mask_text(get, spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redaction.mask_text(F.col("text"))).alias("masked_md5"))


_HEADER_NAMES = ("Authorization", "COOKIE", "X-Api-Key", "x-auth-token", "X-Access-Token", "Accept", "X-Api-Keys", "Host")


@_query(
    f""", h as (select event_id, unnest([[{", ".join(f"'{h}'" for h in _HEADER_NAMES)}][event_id % 8 + 1], 'User-Agent']) as name, event_type as value from events)
    select event_id, name, case when regexp_matches(name, '^(authorization|cookie|x-(api-key|auth-token|access-token))$', 'i') then '<redacted>' else value end as value from h""".replace(", h as", "with h as", 1)
)
def mask_headers(get, spark, sf_dir):
    name = F.get(F.array(*map(F.lit, _HEADER_NAMES)), (F.col("event_id") % 8).cast("int"))
    headers = F.create_map(name, F.col("event_type"), F.lit("User-Agent"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(redaction.mask_headers(headers)).alias("name", "value"))


_JSON_FIELDS = ("pin_code", "Kind", "userEmail", "size", "sessionId", "k")


@_query(
    f"""with n as (select *, [{", ".join(f"'{f}'" for f in _JSON_FIELDS)}][event_id % 6 + 1] as field, event_id % 6 in (0, 2, 4) as telling from events)
    select event_id, case when not telling then event_type when event_type <> 'view' then '<redacted>' end as first,
     case when telling then '<redacted>' else cast(event_id as varchar) end as second, cast(json_extract(props, '$.k') as bigint) as k, event_type as plain, null as form from n where event_id % 10 <> 9
    union all select event_id, null, null, null, null, 'k=' || event_id || '&userEmail=***&pin_code: *** ' || substr('{{"a": [{{"' || field || '": "' || event_type || '"}}, ', 1, 20) from n where event_id % 10 = 9"""
)
def mask_json(get, spark, sf_dir):
    """Fields in lists and in objects of objects, telling names in any case, nulls that stay null ('view'); every tenth body is a form that ends in JSON cut short, and masked as text."""
    field = F.get(F.array(*map(F.lit, _JSON_FIELDS)), (F.col("event_id") % 6).cast("int"))
    telling = F.col("event_id") % 6 % 2 == 0
    value = F.when(telling & (F.col("event_type") == "view"), "null").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    body = F.format_string('{"a": [{"%s": %s}, [{"in": {"%s": %d}}]], "b": {"inner": %s, "plain": "%s"}}', field, value, field, "event_id", "props", "event_type")
    form = F.format_string("k=%d&userEmail=%s&pin_code: %d %s", "event_id", "event_type", "event_id", F.substring(body, 1, 20))
    is_form = F.col("event_id") % 10 == 9
    masked = table(spark, sf_dir, "events").select("event_id", field.alias("f"), redaction.mask_json(F.when(is_form, form).otherwise(body)).alias("m"))
    at = lambda path: F.when(~is_form, F.expr(f"get_json_object(m, {path})"))
    return masked.select(
        "event_id",
        at("concat('$.a[0].', f)").alias("first"),
        at("concat('$.a[1][0].in.', f)").alias("second"),
        at("'$.b.inner.k'").cast("long").alias("k"),
        at("'$.b.plain'").alias("plain"),
        F.when(is_form, F.col("m")).alias("form"),
    )


@_query("select page_id, not (regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) in ('/health', '/metrics', '/docs', '/redoc', '/openapi.json', '/favicon.ico', '/')) as logged, case when strlen(html) > 3000 then '<body too large: ' || strlen(html) || ' bytes>' else html end as body from pages")
def request_log(get, spark, sf_dir):
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", redaction.is_logged_path(path).alias("logged"), redaction.capped_body(F.col("html"), 3000).alias("body"))


@_query("select id, created_at + interval 30 days as session_ends, created_at + interval 15 minutes as token_ends from audit_log", "audit_log")
def expiry_times(get, spark, sf_dir):
    at = F.col("created_at")
    return get("audit_log").select("id", (at + F.expr("interval 30 days")).alias("session_ends"), (at + F.expr("interval 15 minutes")).alias("token_ends"))


@_query("select event_id, regexp_matches(code, '^[0-9]{6}$') as valid from (select event_id, case event_id % 4 when 0 then lpad(event_id::varchar, 6, '0') when 1 then event_id::varchar when 2 then lpad(event_id::varchar, 6, 'x') else lpad(event_id::varchar, 6, '0') || ' ' end as code from events)")
def code_format(get, spark, sf_dir):
    i = F.col("event_id")
    text, rest = i.cast("string"), i % 4
    code = F.when(rest == 0, F.lpad(text, 6, "0")).when(rest == 1, text).when(rest == 2, F.lpad(text, 6, "x")).otherwise(F.concat(F.lpad(text, 6, "0"), F.lit(" ")))
    return table(spark, sf_dir, "events").select("event_id", scalars.is_otp(code).alias("valid"))


_HMAC_KEY = "wardlight"
_PADDED = [bytes(b ^ pad for b in _HMAC_KEY.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@_query(f"select doc_id, sha256(unhex('{_PADDED[1]}') || unhex(sha256(unhex('{_PADDED[0]}') || encode(text)))) as digest from documents")
def hmac_text(get, spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.hmac_sha256(_HMAC_KEY)(F.col("text")).alias("digest"))


_FAILURES = ("RateLimitError", "PersonNotFoundError", "FileTooLargeError", "StorageUnavailableError", "RefreshTokenError", "PatientAlreadyExistsError", "UnsupportedFileTypeError", "SomeOtherError")


@_query("select event_id, [429, 404, 413, 503, 401, 409, 415, 400][event_id % 8 + 1] as status from events")
def failure_answers(get, spark, sf_dir):
    name = F.get(F.array(*map(F.lit, _FAILURES)), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", scalars.failure_status(name).alias("status"))


_BODY_TYPES = ("application/json; charset=utf-8", "text/plain", "image/png", "application/xml", "application/octet-stream", " text/html", "")


@_query("select page_id, page_id % 7 in (0, 1, 3) as logged from pages")
def logged_types(get, spark, sf_dir):
    kind = F.nullif(F.get(F.array(*map(F.lit, _BODY_TYPES)), (F.col("page_id") % 7).cast("int")), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", redaction.is_logged_type(kind).alias("logged"))


@_query("select event_id, epoch_us(ts) as micros, datediff('microsecond', timestamp '1970-01-01', ts) // 1000 as ms, coalesce(nullif(case when event_id % 3 = 0 then '' when event_id % 3 = 1 then event_type end, ''), 'unknown') as device from events")
def request_times(get, spark, sf_dir):
    """Naive times as moments in UTC, milliseconds that passed, and the first filled of several values."""
    given = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("event_type"))
    at = scalars.as_utc(F.col("ts"))
    start = scalars.as_utc(F.lit("1970-01-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(at).alias("micros"), scalars.elapsed_ms(start, at).alias("ms"), scalars.first_filled(given, F.lit("unknown")).alias("device"))


# ------------------------------------------------------------------ mutations


@_query(
    "select p.id as patient_id, r.id is null as created, epoch_us(case when r.id is null then timestamp '1998-01-01' else timestamp '1990-01-01' end) as created_micros from patient p left join medical_record r on r.patient_id = p.id",
    "patient medical_record",
)
def ensure_records(get, spark, sf_dir):
    """A medical record for each patient; those there keep theirs."""
    have = get("medical_record").select(F.col("id").cast("string").alias("id"), "patient_id", scalars.as_utc(F.lit("1990-01-01").cast("timestamp_ntz")).alias("created_at"))
    patients = get("patient")
    out = mutations.ensure_records(have, patients.unionByName(patients), scalars.as_utc(_now()))
    return out.select("patient_id", (F.length("id") == 36).alias("created"), F.unix_micros("created_at").alias("created_micros"))


@_query("select id as encounter_id, started_at, type as kind, cast(null as varchar) as note, cast(null as bigint) as seat from encounter union all select id + 10000000, created_at, action, null, actor_account_id from audit_log", "encounter audit_log")
def evolve_and_insert(get, spark, sf_dir):
    """A table with columns dropped, renamed and added, and rows of another table appended."""
    rows = get("encounter").select("id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "type", "status")
    after = mutations.evolved(rows, {"id": "encounter_id", "type": "kind"}, {"note": "string", "seat": "long"}, ("status",))
    more = get("audit_log").selectExpr("id + 10000000 as encounter_id", "created_at as started_at", "action as kind", "actor_account_id as seat")
    return mutations.insert_select(after, more)




@_query(
    """, a as (select account_id, role_code from account_role), w as (select distinct account_id, role_code from a union select account_id, 'client' from a)
    select account_id, role_code, account_id % 3 = 0 or role_code <> (select min(b.role_code) from a b where b.account_id = w.account_id) as created from w""",
    "account_role",
)
def seed_missing(get, spark, sf_dir):
    """Roles of accounts seeded twice over: two thirds are there, every account is to have its own role and 'client', asked for twice each."""
    held = get("account_role").select("account_id", "role_code")
    wanted = held.unionByName(held.withColumn("role_code", F.lit("client")))
    return mutations.insert_missing(held.where("account_id % 3 <> 0"), wanted.unionByName(wanted), ["account_id", "role_code"])


@_query("select d.id as document_id, case when e.id is not null then e.status else 'pending' end as status, e.confidence from document d left join extraction e on e.document_id = d.id", "document extraction")
def upsert_extraction(get, spark, sf_dir):
    before = get("document").select(F.col("id").alias("document_id"), F.lit("pending").alias("status"), F.lit(None).cast("double").alias("confidence"))
    changes = get("extraction").select("document_id", "status", F.col("confidence").cast("double").alias("confidence"))
    return mutations.upsert(before, changes, ["document_id"])


@_query("select id, case when id % 3 = 0 then null when id % 3 = 1 then 'patched' else type end as type, case when id % 2 = 0 then 'cancelled' else status end as status from encounter", "encounter")
def patch_fields(get, spark, sf_dir):
    rows = get("encounter").select("id", "type", "status")
    field = lambda when, value: F.struct(when.alias("set"), value.alias("value"))
    i = F.col("id")
    patches = rows.select("id", field(i % 3 < 2, F.when(i % 3 == 1, "patched")).alias("type"), field(i % 2 == 0, F.lit("cancelled")).alias("status"))
    return mutations.patch(rows, patches, ["id"])


@_query("select patient_id, account_id, case when account_id % 4 = 0 then 'revoked' else status end as status, account_id % 4 = 0 and status <> 'revoked' as changed from access_grant", "access_grant")
def revoke_grants(get, spark, sf_dir):
    key = ["patient_id", "account_id"]
    grants = get("access_grant").select(*key, "status")
    after, changed = mutations.revoke(grants, grants.where("account_id % 4 = 0"), key)
    return after.join(changed.withColumn("c", F.lit(True)), key, "left").select(*key, "status", F.coalesce("c", F.lit(False)).alias("changed"))


@_query("select id, case when id % 2 = 0 and email is not null then lower(trim(email)) else case when id % 2 = 1 then 'kept' end end as email_normalized from account", "account")
def normalise_update(get, spark, sf_dir):
    rows = get("account").select("id", "email", F.when(F.col("id") % 2 == 1, "kept").alias("email_normalized"))
    return mutations.fill_when_null(rows, "email_normalized", scalars.normalize_email_sql(F.col("email"))).select("id", "email_normalized")


@_query("select document_id, version from document_version where document_id not in (select id from document where status = 'failed')", "document_version document")
def cascade_delete(get, spark, sf_dir):
    return mutations.cascade(get("document_version"), "document_id", get("document").where("status = 'failed'"), "id").select("document_id", "version")


@_query("select id, case when medical_record_id in (select id from patient where id % 2 = 0) then medical_record_id end as medical_record_id from encounter", "encounter patient")
def set_null(get, spark, sf_dir):
    return mutations.set_null_orphans(get("encounter").select("id", "medical_record_id"), "medical_record_id", get("patient").where("id % 2 = 0"), "id")


@_query("select document_id, count(*) as n_rows from document_version group by document_id having count(*) > 1", "document_version")
def unique_check(get, spark, sf_dir):
    return schema.duplicate_keys(get("document_version"), "document_id")


@_query("select document_id, version from document_version where document_id not in (select id from extraction)", "document_version extraction")
def foreign_key_check(get, spark, sf_dir):
    return schema.orphans(get("document_version"), "document_id", get("extraction"), "id").select("document_id", "version")


# ------------------------------------------------------------------- pipeline

_KNOWN = ", k as (select e.*, v.document_id is not null as known from pipeline_event e left join (select distinct document_id, document_version_id from document_version) v using (document_id, document_version_id))"""
_VERSION_SQL = _KNOWN + """ select document_id, document_version_id,
 max_by(storage_key, seq) filter (type = 'DocumentStored') as storage_key, max_by(mime_type, seq) filter (type = 'DocumentStored') as mime_type, max_by(checksum, seq) filter (type = 'DocumentStored') as checksum,
 coalesce(max_by(case type when 'DocumentConverted' then 'succeeded' else 'failed' end, seq) filter (type in ('DocumentConverted', 'DocumentProcessingFailed')), 'queued') as job_status,
 max_by(occurred_at, seq) filter (type in ('DocumentConverted', 'DocumentProcessingFailed')) as finished_at, max_by(error_code, seq) filter (type = 'DocumentProcessingFailed') as error_code, max_by(error_message, seq) filter (type = 'DocumentProcessingFailed') as error_message
 from k where known group by document_id, document_version_id"""
_DOCUMENT_SQL = _KNOWN + """, d as (select document_id, max_by(case when type = 'DocumentStored' then 'processing' when type = 'DocumentAnalysisCompleted' and succeeded then 'completed' else 'failed' end, seq)
  filter (known and type = 'DocumentStored' or type in ('DocumentProcessingFailed', 'DocumentAnalysisCompleted')) as status,
 max_by(size_bytes, seq) filter (known and type = 'DocumentStored') as size_bytes from k group by document_id)
 select document_id, coalesce(status, 'pending') as status, size_bytes from d"""
_STATE = ["document_id", "document_version_id", "storage_key", "mime_type", "checksum", "job_status", "finished_at", "error_code", "error_message"]


def _known_events(get) -> DataFrame:
    return ev.with_known(get("pipeline_event"), get("document_version"))


@_query(_VERSION_SQL, "pipeline_event document_version")
def fold_events(get, spark, sf_dir):
    """The state of each version; events of versions that are not there are skipped."""
    return ev.folded(_known_events(get).where("known"), ev.VERSIONS).select(*_STATE)


@_query(_DOCUMENT_SQL, "pipeline_event document_version")
def fold_documents(get, spark, sf_dir):
    """The state of each document over all its versions."""
    return ev.folded(_known_events(get), ev.DOCUMENTS).select("document_id", "status", "size_bytes")


@_query("select extraction_id, max_by(case when succeeded then 'succeeded' else 'failed' end, seq) as extraction_status, max_by(confidence, seq) as confidence from pipeline_event where type = 'DocumentAnalysisCompleted' group by extraction_id", "pipeline_event")
def fold_extractions(get, spark, sf_dir):
    return ev.folded(get("pipeline_event").where("type = 'DocumentAnalysisCompleted'"), ev.EXTRACTIONS).select("extraction_id", "extraction_status", "confidence")


@_query(_VERSION_SQL, "pipeline_event document_version")
def fold_in_batches(get, spark, sf_dir):
    """The same states from two halves of the events, merged."""
    events = _known_events(get).where("known")
    halves = [ev.folded(events.where(f"seq % 2 = {i}"), ev.VERSIONS) for i in (0, 1)]
    return ev.merged(*halves, ev.VERSIONS).select(*_STATE)


@_query("select document_id, document_version_id, min(seq) as seq from pipeline_event where type = 'DocumentStored' and (document_id, document_version_id) in (select (document_id, document_version_id) from document_version where checksum is null) group by all", "pipeline_event document_version")
def publish_once(get, spark, sf_dir):
    return ev.to_publish(get("pipeline_event"), get("document_version"))


@_query("select seq, document_id from pipeline_event where (document_id, document_version_id) not in (select (document_id, document_version_id) from document_version)", "pipeline_event document_version")
def unknown_versions(get, spark, sf_dir):
    return ev.unknown(get("pipeline_event"), get("document_version")).select("seq", "document_id")


@_query(
    """select seq, case when type = 'DocumentConverted' then 'unsupported_type' when size_bytes > 20000000 then 'too_large' when seq % 9 = 0 then 'missing_file' end as error_code,
    case when type <> 'DocumentConverted' and size_bytes <= 20000000 and seq % 9 <> 0 then 'tenants/main/patients/' || (document_id % 40) || '/documents/' || document_id || '/versions/' || seq || '/original.png' end as storage_key from pipeline_event""",
    "pipeline_event",
)
def upload_outcome(get, spark, sf_dir):
    requests = get("pipeline_event").selectExpr("seq", "'main' as tenant_id", "document_id % 40 as patient_id", "document_id", "seq as document_version_id", "size_bytes", "case when type = 'DocumentConverted' then 'text/plain' else 'image/PNG' end as mime_type")
    return uploads.upload_outcome(requests, F.col("seq") % 9 != 0, 20_000_000).select("seq", "error_code", "storage_key")


_KEY_SQL = "case type when 'DocumentStored' then 'document.stored' when 'DocumentConverted' then 'document.converted' else 'document.other' end"


@_query(f"select seq, {_KEY_SQL} as routing_key from pipeline_event where type in ('DocumentStored', 'DocumentConverted')", "pipeline_event")
def routed_events(get, spark, sf_dir):
    events = get("pipeline_event").select("seq", F.expr(_KEY_SQL).alias("routing_key"))
    return files.routed(events, " document.stored, ,document.converted,document.store")


@_query("select distinct s3_key as storage_key from document_version where checksum is not null and s3_key not in (select s3_key from document_version where version % 2 = 0)", "document_version")
def objects_to_write(get, spark, sf_dir):
    """Objects that are still to be written, each once, though asked for twice."""
    versions = get("document_version").withColumnRenamed("s3_key", "storage_key")
    wanted = versions.where("checksum is not null").select("storage_key")
    return files.missing_objects(wanted.unionByName(wanted), versions.where("version % 2 = 0"))


@_query("select id, case when email is null then 'phone' else 'email' end as channel, case when email is null then 'unsupported_channel' end as error_code from account", "account")
def notifications(get, spark, sf_dir):
    """What a provider of e-mail takes and refuses."""
    out = files.addressed(get("account").select("id", F.trim(F.coalesce("email", "phone")).alias("recipient")), "smtp")
    return out.select("id", "channel", "error_code")


@_query(
    "select document_id, count(*) as n_events, "
    + ", ".join(f"min(occurred_at) filter (type = '{kind}') as {c}" for kind, c in ev.STEPS.items())
    + " from pipeline_event group by document_id",
    "pipeline_event",
)
def correlated_events(get, spark, sf_dir):
    return ev.correlated(get("pipeline_event"))


@_query(
    """, x as (select document_id, document_version_id, type, max(seq) filter (type in ('DocumentConverted', 'DocumentAnalysisCompleted')) over (partition by document_id, document_version_id) as done, seq from pipeline_event)
    select document_id, document_version_id, count(*) as n_failed, case when count(*) > 2 then 'dead_letter' else 'retry' end as outcome
    from x where type = 'DocumentProcessingFailed' and seq > coalesce(done, -1) group by all""",
    "pipeline_event",
)
def retry_or_bury(get, spark, sf_dir):
    return ev.retry_or_bury(get("pipeline_event"), 2)


@_query("select patient_id, account_id, purpose from (select *, case when can_upload_documents then 'treatment' else 'research' end as purpose from access_grant) where status = 'active' and (expires_at is null or expires_at > timestamp '1998-01-01 00:00:00') and purpose = 'research'", "access_grant")
def consents(get, spark, sf_dir):
    given = get("access_grant").withColumn("purpose", F.when(F.col("can_upload_documents"), "treatment").otherwise("research"))
    return reads.consented(given, "research", _now()).select("patient_id", "account_id", "purpose")


@_query("select seq, type in ('DocumentStored', 'DocumentConverted') and document_id % 4 in (0, 1) as valid from pipeline_event where type <> 'DocumentUploadRequested'", "pipeline_event")
def rejected_messages(get, spark, sf_dir):
    """Whole messages, messages cut short, without an id, and of no body; those of types that nobody hears are not there."""
    i = F.col("document_id") % 4
    whole = F.to_json(F.struct(F.col("document_id").cast("string").alias("document_id"), "checksum"))
    bad = F.when(F.col("seq") % 2 == 0, F.substring(whole, 1, 9)).otherwise(F.to_json(F.struct("checksum")))
    good = F.col("type").isin("DocumentStored", "DocumentConverted") & i.isin(0, 1)
    body = F.when(good, whole).when(i == 3, F.lit(None)).otherwise(bad)
    kind = F.when(F.col("type") == "DocumentUploadRequested", "Unheard").otherwise(F.col("type"))
    return ev.parsed(get("pipeline_event").select("seq", kind.alias("type"), body.alias("body"))).select("seq", "valid")


@_query("select seq, type, document_id from pipeline_event where type in ('DocumentStored', 'DocumentConverted')", "pipeline_event")
def parsed_messages(get, spark, sf_dir):
    e = get("pipeline_event")
    kind = F.when(F.col("type").isin("DocumentStored", "DocumentConverted"), F.col("type")).otherwise("Unheard")
    messages = e.select("seq", kind.alias("type"), F.to_json(F.struct(F.col("document_id").cast("string").alias("document_id"), "checksum")).alias("body"))
    return ev.parsed(messages).where("valid").select("seq", "type", F.col("event.document_id").cast("long").alias("document_id"))


@_query(
    """, e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
    r as (select user_id, event_id, k, t as began, true as allowed from e where k = 1 union all
     select e.user_id, e.event_id, e.k, case when e.t >= r.began + 86400000000 then e.t else r.began end, e.t >= r.began + 86400000000 from r join e on e.user_id = r.user_id and e.k = r.k + 1)
    select user_id, event_id, allowed from r""".replace(", e as", "with recursive e as", 1)
)
def rate_limit(get, spark, sf_dir):
    """One request a day for each user, counted from the first of a window."""
    return limits.rate_limited(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", window=86_400.0)


# ------------------------------------------------------------------ analytics


@_query(
    """select patient_id, 'encounter' as kind, id as item_id, started_at as at from (select medical_record_id as patient_id, id, started_at from encounter)
    union all select patient_id, 'observation', encounter_id, observed_at from observation""",
    "encounter observation",
)
def patient_timeline(get, spark, sf_dir):
    return analytics.timeline(("encounter", get("encounter"), "medical_record_id", "id", "started_at"), ("observation", get("observation"), "patient_id", "encounter_id", "observed_at"))


@_query(
    """, t as (select medical_record_id as patient_id, 'encounter' as kind, id as item_id, started_at as at from encounter
    union all select document_id, 'document', seq, occurred_at from pipeline_event where type = 'DocumentStored'
    union all select patient_id, 'observation', encounter_id * 10 + line_no, observed_at from observation
    union all select patient_id, 'diagnosis', encounter_id * 10 + line_no, observed_at from observation where value >= 45
    union all select patient_id, 'medication', encounter_id * 10 + line_no, observed_at + interval 1 day from observation where value >= 48)
    select *, row_number() over (partition by patient_id order by "at" desc nulls last, kind, item_id) as place from t""",
    "encounter pipeline_event observation",
)
def full_timeline(get, spark, sf_dir):
    """Five kinds of items of each patient, newest first; high values stand for diagnoses, the highest for medication from the next day on."""
    seen = get("observation").withColumn("item", F.expr("encounter_id * 10 + line_no"))
    return analytics.ordered_timeline(
        ("encounter", get("encounter"), "medical_record_id", "id", "started_at"),
        ("document", get("pipeline_event").where("type = 'DocumentStored'"), "document_id", "seq", "occurred_at"),
        ("observation", seen, "patient_id", "item", "observed_at"),
        ("diagnosis", seen.where("value >= 45"), "patient_id", "item", "observed_at"),
        ("medication", seen.where("value >= 48").withColumn("observed_at", F.expr("observed_at + interval 1 day")), "patient_id", "item", "observed_at"),
    )


_SERIES = ("observed_at", "encounter_id", "line_no", "part_id", "supplier_id", "price", "value")


@_query(
    f"""select patient_id, code, encounter_id, line_no, value, lag(value) over w as previous, value - lag(value) over w as change, value - first_value(value) over w as total_change
    from observation window w as (partition by patient_id, code order by {", ".join(_SERIES)})""",
    "observation",
)
def observation_trend(get, spark, sf_dir):
    return analytics.trend(get("observation"), *_SERIES).select("patient_id", "code", "encounter_id", "line_no", "value", "previous", "change", "total_change")


@_query("select encounter_id, line_no, part_id, value, case when value < 10 then 'low' when value > 40 then 'high' else 'normal' end as flag from observation", "observation")
def out_of_range(get, spark, sf_dir):
    flag = analytics.range_flag(F.col("value"), F.lit(10), F.lit(40))
    return get("observation").select("encounter_id", "line_no", "part_id", "value", flag.alias("flag"))


@_query("select id, 'n' || i as test_name, cast(id % 50 + i as double) as value, case when id % 50 + i < 10 then 'low' when id % 50 + i > 30 then 'high' else 'normal' end as flag from (select id, unnest([1, 2]) as i from audit_log)", "audit_log")
def observations_exploded(get, spark, sf_dir):
    part = lambda i: F.struct(F.lit(f"n{i}").alias("test_name"), (F.col("id") % 50 + i).alias("value"), F.lit(10).alias("reference_min"), F.lit(30).alias("reference_max"))
    data = F.to_json(F.struct(F.array(part(1), part(2)).alias("results")))
    return analytics.exploded_results(get("audit_log").select("id", data.alias("data"))).select("id", "test_name", "value", "flag")


@_query("select doc_id, (row_number() over (partition by doc_id order by s)) - 1 as chunk_no, s as start, substring(text, s, 1000) as chunk from (select doc_id, text, unnest(range(1, greatest(length(text) - 100, 1) + 1, 900)) as s from documents where length(text) > 0)")
def text_chunks(get, spark, sf_dir):
    out = analytics.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 100)
    return out.withColumns({"chunk_no": F.col("chunk_no").cast("long"), "start": F.col("start").cast("long")})


@_query("select query_id, vec_id, place from (select a.vec_id as query_id, b.vec_id, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) desc, b.vec_id) as place from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0) where place <= 5")
def cosine_topk(get, spark, sf_dir):
    """The five nearest vectors of every fiftieth, in blocks of queries."""
    vectors = table(spark, sf_dir, "embeddings")
    return analytics.cosine_topk(vectors, vectors.where("vec_id % 50 = 0"), 5).select("query_id", "vec_id", "place")


@_query("select id, case when confidence < 0.8 then 'review_required' else 'accepted' end as review from extraction", "extraction")
def review_required(get, spark, sf_dir):
    return analytics.needs_review(get("extraction"), 0.8).select("id", "review")


@_query("select seq, sum(case type when 'DocumentUploadRequested' then 1 when 'DocumentConverted' then -1 else 0 end) over (partition by document_id order by seq)::bigint as depth from pipeline_event", "pipeline_event")
def queue_depth(get, spark, sf_dir):
    kind = F.col("type")
    return analytics.queue_depth(get("pipeline_event"), kind == "DocumentUploadRequested", kind == "DocumentConverted", ["seq"], "document_id").select("seq", "depth")


@_query("select type, count(*) as n, count(distinct document_id) as n_documents, min(seq) as first_seq, max(seq) as last_seq from pipeline_event group by type", "pipeline_event")
def pipeline_metrics(get, spark, sf_dir):
    return analytics.pipeline_metrics(get("pipeline_event"))


@_query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by all")
def events_by_day(get, spark, sf_dir):
    return _windowed(table(spark, sf_dir, "events").select("ts", "event_type"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query(
    """select p.id as patient_id, n.full_name, r.id as record_id, case when n.id is null then 'no person' when r.id is null then 'no medical record' end as problem
    from patient p left join (select * from person where id % 11 <> 0) n on p.person_id = n.id left join medical_record r on r.patient_id = p.id""",
    "patient person medical_record",
)
def entity_composition(get, spark, sf_dir):
    """Patient, person and medical record as one, or what is missing."""
    out = reads.patient_context(get("patient"), get("person").where("id % 11 <> 0"), get("medical_record"))
    return out.select("patient_id", F.col("person.full_name").alias("full_name"), F.col("medical_record.id").alias("record_id"), "problem")


@_query(
    """, c as (select document_id, min(occurred_at) as came from pipeline_event where type = 'DocumentUploadRequested' group by 1),
    w as (select document_id, came, min(occurred_at) as went from pipeline_event join c using (document_id) where type = 'DocumentConverted' and occurred_at >= came group by all),
    s as (select (epoch_us(went) - epoch_us(came)) / 1e6 as s from w)
    select count(*) as n, round(avg(s), 3) as mean_seconds, round(quantile_cont(s, 0.5), 3) as p50_seconds, round(quantile_cont(s, 0.95), 3) as p95_seconds from s""",
    "pipeline_event",
)
def pipeline_latency(get, spark, sf_dir):
    kind = F.col("type")
    return analytics.latencies(get("pipeline_event"), kind == "DocumentUploadRequested", kind == "DocumentConverted", "occurred_at", "document_id")


@_query("select actor_account_id, count(*) as n, count(*) filter (action = 'error') as n_errors from audit_log group by actor_account_id", "audit_log")
def audit_summary(get, spark, sf_dir):
    return get("audit_log").groupBy("actor_account_id").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "error").alias("n_errors"))


_CODE_LIFE = 86_400


@_query(
    f"""with e as (select user_id, event_id, ts, event_type = 'signup' as issued, event_type = 'purchase' as ok, count(*) filter (event_type = 'signup') over (partition by user_id order by ts, event_id) as code_no from events),
    t as (select e.*, coalesce(epoch_us(e.ts) - epoch_us(c.ts) <= {_CODE_LIFE} * 1000000::bigint, false) as there from e left join (select user_id, code_no, ts from e where issued) c using (user_id, code_no) where not e.issued),
    w as (select *, coalesce(sum(case when there and not ok then 1 end) over before, 0) as wrong from t window before as (partition by user_id, code_no order by ts, event_id rows between unbounded preceding and 1 preceding)),
    u as (select *, coalesce(bool_or(there and ok and wrong < 5) over (partition by user_id, code_no order by ts, event_id rows between unbounded preceding and 1 preceding), false) as used from w)
    select user_id::varchar as identity, event_id as seq, case when not there then 'absent' when used or wrong >= 5 then 'burned' when ok then 'accepted' else 'wrong' end as outcome from u"""
)
def code_attempts(get, spark, sf_dir):
    """Sign-ups issue a code for a day; all other events try one, purchases the right one."""
    e = table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as identity", "ts as at", "event_id as seq", "event_type = 'signup' as issued", "if(event_type in ('signup', 'purchase'), 'right', 'wrong') as code")
    return keyed.batch_code_attempts(e, life=_CODE_LIFE)


@_query(
    """with e as (select user_id, event_id, ts, event_type <> 'error' as ok, lead(ts) over w as following, count(*) filter (event_type <> 'error') over w as run from events
     where event_type in ('error', 'view', 'purchase') window w as (partition by user_id order by ts, event_id)),
    f as (select *, row_number() over (partition by user_id, run order by ts, event_id) - 1 as k from e where not ok),
    n as (select *, (k % 4 + 1)::integer as attempts, ts + to_seconds(7200 * (1 << (k % 4)::integer)) as due, min(ts) over (partition by user_id, run, k // 4) as first_failed_at from f)
    select user_id::varchar as message_id, event_id as seq, attempts, case when attempts > 3 then 'dead_letter' else 'retry' end as outcome, case when attempts > 3 then ts else due end as at, first_failed_at
    from n where attempts > 3 or following is null or following >= due"""
)
def retries_and_dead_letters(get, spark, sf_dir):
    """Errors of a user since its last success are tried again after 2, 4 and 8 hours; the fourth in a row is a dead letter."""
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'view', 'purchase')").selectExpr("user_id as message_id", "ts as at", "event_id as seq", "event_type <> 'error' as ok")
    out = keyed.batch_retries(e, backoff_s=7200)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "first_failed_at")})


_KEYS = {"DocumentStored": "document.stored", "DocumentConverted": "document.converted", "DocumentProcessingFailed": "document.failed.conversion", "DocumentUploadRequested": "document.requested"}


@_query(
    f"""select seq, document_id, type, case type {" ".join(f"when '{t}' then '{k}'" for t, k in _KEYS.items())} end as routing_key, 'application/json' as content_type
    from pipeline_event where type in ('DocumentStored', 'DocumentProcessingFailed')""",
    "pipeline_event",
)
def queue_messages(get, spark, sf_dir):
    """All pipeline events published to a topic, and those of two binding keys consumed from it as a stream, in batches of at most 20,000."""
    key = F.element_at(F.create_map(*[F.lit(x) for kv in _KEYS.items() for x in kv]), F.col("type"))
    sent = get("pipeline_event").select(F.coalesce(key, F.lit("document.other")).alias("routing_key"), "type", F.to_json(F.struct("seq", "document_id")).alias("body"))
    topic, out = shared_path(spark, "topic"), shared_path(spark, "consumed")
    messages.publish(sent, topic)
    stream = messages.consume(spark, topic, "document.stored, document.failed.#", "reader", 20_000)
    got = stream.select("routing_key", "type", "content_type", F.from_json("body", "seq long, document_id long").alias("b"))
    got = got.select("b.seq", "b.document_id", "type", "routing_key", "content_type")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = got.writeStream.foreachBatch(keep).option("checkpointLocation", shared_path(spark, "offsets")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(out).drop("batch")


_SESSION_ROW = """select event_id as id, user_id as account_id, ts as created_at, 'h' || event_id as refresh_token_hmac, case when event_type = 'error' then ts end as revoked_at, ts + interval 30 day as expires_at,
 ts as last_used_at, 'agent ' || user_id % 5 as user_agent, '10.0.0.' || user_id % 200 as ip_address, case when event_type <> 'view' then 'device ' || user_id end as device_id, event_type as platform, '1.' || event_id % 3 as app_version"""


@_query(
    f"""with t as ({_SESSION_ROW} from events where event_id % 3 <> 0), s as ({_SESSION_ROW} from events where event_id % 2 = 0)
    select coalesce(t.id, s.id) as id, coalesce(t.account_id, s.account_id + 1) as account_id, coalesce(t.created_at, s.created_at + interval 1 hour) as created_at,
    case when s.id is null then t.refresh_token_hmac else s.refresh_token_hmac || '+' end as refresh_token_hmac, case when s.id is null then t.revoked_at end as revoked_at, coalesce(s.expires_at + interval 1 day, t.expires_at) as expires_at,
    coalesce(s.last_used_at + interval 2 hour, t.last_used_at) as last_used_at, coalesce(s.user_agent, t.user_agent) as user_agent, case when s.id is null then t.ip_address else '10.1.1.1' end as ip_address,
    case when s.id is null then t.device_id else s.device_id end as device_id, coalesce(s.platform, t.platform) as platform, coalesce(s.app_version, t.app_version) as app_version
    from t full join s using (id)"""
)
def save_sessions(get, spark, sf_dir):
    """Two thirds of the sessions are there; every second one is saved twice, with other values and for another account, and the later use counts."""
    at = table(spark, sf_dir, "events")
    rows = at.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("account_id"), F.col("ts").alias("created_at"), F.concat(F.lit("h"), "event_id").alias("refresh_token_hmac"),
        F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"), F.expr("ts + interval 30 day").alias("expires_at"), F.col("ts").alias("last_used_at"),
        F.concat(F.lit("agent "), F.col("user_id") % 5).alias("user_agent"), F.concat(F.lit("10.0.0."), F.col("user_id") % 200).alias("ip_address"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("device "), "user_id")).alias("device_id"), F.col("event_type").alias("platform"), F.concat(F.lit("1."), F.col("event_id") % 3).alias("app_version"),
    )
    given = rows.where("id % 2 = 0").withColumns({"account_id": F.col("account_id") + 1, "created_at": F.expr("created_at + interval 1 hour"), "expires_at": F.expr("expires_at + interval 1 day"), "ip_address": F.lit("10.1.1.1"), "revoked_at": F.lit(None).cast("timestamp_ntz")})
    later = given.withColumns({"last_used_at": F.expr("last_used_at + interval 2 hour"), "refresh_token_hmac": F.concat("refresh_token_hmac", F.lit("+"))})
    return mutations.save_sessions(rows.where("id % 3 <> 0"), given.unionByName(later))


_ROTATED = "(id % 4 = 0 and revoked_at is null and expires_at > timestamp '1995-01-01 00:00:00')"
_ROTATE_SQL = f"""r as (select id, account_id, case when {_ROTATED} then timestamp '1995-01-01 00:00:00' else revoked_at end as revoked_at, expires_at from session_row
 union all select id + 1000000, account_id, null, timestamp '1995-01-31 00:00:00' from session_row where {_ROTATED})"""


def _rotated(get) -> tuple[DataFrame, DataFrame]:
    sessions = get("session_row")
    asked = sessions.where("id % 4 = 0").selectExpr("id", "id + 1000000 as new_id")
    return sessions, mutations.rotate_sessions(sessions, asked, F.lit("1995-01-01").cast("timestamp_ntz"))


@_query(f", {_ROTATE_SQL} select * from r", "session_row")
def session_rotation(get, spark, sf_dir):
    return _rotated(get)[1]


@_query(f", {_ROTATE_SQL} select r.id, case when s.id is null then 'created' else 'revoked' end as event from r left join session_row s on s.id = r.id where s.id is null or (s.revoked_at is null and r.revoked_at is not null)", "session_row")
def session_events(get, spark, sf_dir):
    return mutations.session_events(*_rotated(get))


@_query("select document_id % 7 as pool, count(*) filter (type = 'DocumentUploadRequested') as queued, round(avg(seq) filter (type = 'DocumentConverted'), 6) as mean_seconds, round(count(*) filter (type = 'DocumentUploadRequested') * round(avg(seq) filter (type = 'DocumentConverted'), 6), 3) as work_seconds from pipeline_event group by 1", "pipeline_event")
def estimated_work(get, spark, sf_dir):
    events = get("pipeline_event").withColumn("pool", F.expr("document_id % 7"))
    return analytics.estimated_work(events.where("type = 'DocumentUploadRequested'"), events.where("type = 'DocumentConverted'"), "pool", "seq")


@_query("select 'documents/' || doc_id % 10 || '/' || doc_id || '.txt' as storage_key, case when doc_id % 5 = 0 then 'exists' else 'written' end as state, strlen(t) as size_bytes, sha256(t) as checksum, sha256(t) as there from (select doc_id, case when doc_id % 5 = 0 then 'old ' || text else text end as t from documents)")
def object_writes(get, spark, sf_dir):
    """All texts written as objects, of which every fifth is there in an older form; their checksums read back from the store."""
    docs = table(spark, sf_dir, "documents")
    key = F.concat_ws("/", F.lit("documents"), F.col("doc_id") % 10, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    texts = docs.select(key.alias("storage_key"), F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("content_type"), "doc_id")
    root = shared_path(spark, "store")
    objects.put_objects(texts.where("doc_id % 5 = 0").withColumn("content", F.concat(F.lit("old ").cast("binary"), F.col("content"))), root, "before").count()
    report = objects.put_objects(texts, root, "all")
    return report.join(objects.stored(spark, root).select("storage_key", F.col("checksum").alias("there")), "storage_key", "left")


@_query("select id, action, 'api' as application, (id % 3)::varchar as batch from audit_log", "audit_log")
def audit_append(get, spark, sf_dir):
    """The audit rows appended in three batches, each of which comes twice."""
    rows, path = get("audit_log").select("id", "action"), shared_path(spark, "audit")
    for n in (0, 1, 0, 2, 2, 1):
        ledger.append(rows.where(F.col("id") % 3 == n), path, "api", n)
    return ledger.read(spark, path)


@_query(
    """, p as (select id from patient where id % 4 = 1), e as (select id, medical_record_id from encounter),
    d as (select id, medical_record_id, id % 400 as encounter_id from document), gone as (select id from d where medical_record_id in (select id from p))
    select 'patient' as entity, id::varchar as id, null as ref from patient where id not in (select id from p)
    union all select 'medical_record', id::varchar, id::varchar from patient where id not in (select id from p)
    union all select 'encounter', id::varchar, medical_record_id::varchar from e where medical_record_id not in (select id from p)
    union all select 'document', id::varchar, case when encounter_id not in (select id from e where medical_record_id in (select id from p)) then encounter_id::varchar end from d where id not in (select id from gone)
    union all select 'document_version', document_version_id::varchar, document_id::varchar from document_version where document_id not in (select id from gone)
    union all select 'processing_job', id::varchar, job_document_id::varchar from processing_job where job_document_id not in (select id from gone)
    union all select 'extraction', id::varchar, document_id::varchar from extraction where document_id not in (select id from gone)
    union all select 'audit_log', id::varchar, case when patient_id not in (select id from p) then patient_id::varchar end from audit_log""",
    "patient encounter document document_version processing_job extraction audit_log",
)
def delete_patients(get, spark, sf_dir):
    """Every fourth patient deleted, with all that refers to it: what is left of eight tables, and one reference of each row."""
    patients = get("patient").select("id")
    tables = {
        "patient": patients,
        "medical_record": patients.select("id", F.col("id").alias("patient_id")),
        "encounter": get("encounter").select("id", "medical_record_id"),
        "document": get("document").select("id", "medical_record_id", (F.col("id") % 400).alias("encounter_id")),
        "document_version": get("document_version").select(F.col("document_version_id").alias("id"), "document_id"),
        "processing_job": get("processing_job").select("id", F.col("job_document_id").alias("document_id")),
        "extraction": get("extraction").select("id", "document_id"),
        "audit_log": get("audit_log").select("id", "patient_id"),
    }
    left, _ = foreign_keys.deleted(tables, {"patient": patients.where("id % 4 = 1")})
    refs = {"patient": None, "medical_record": "patient_id", "encounter": "medical_record_id", "document": "encounter_id", "audit_log": "patient_id"}
    parts = [left[t].select(F.lit(t).alias("entity"), F.col("id").cast("string").alias("id"), (F.col(c) if (c := refs.get(t, "document_id")) else F.lit(None)).cast("string").alias("ref")) for t in tables]
    return functools.reduce(DataFrame.unionByName, parts)


_SCHEMAS: typed.Registry = {
    ("lab_result", "1"): {"test": ("$.test", "string", True), "value": ("$.result.value", "double", True), "unit": ("$.result.unit", "string", False)},
    ("lab_result", "2"): {"test": ("$.name", "string", True), "value": ("$.values[0]", "double", True)},
    ("prescription", "1"): {"drug": ("$.drug", "string", True), "days": ("$.days", "int", True)},
}


@_query(
    """select event_id as id, case event_id % 5 when 2 then case when event_id % 3 = 0 then '$.days' end when 1 then case when event_type = 'view' then '$.values[0]' end when 3 then '$' end as broken,
    case when event_id % 5 = 0 then event_type when event_id % 5 = 1 and event_type <> 'view' then event_type end as test, case when event_id % 5 = 0 then value when event_id % 5 = 1 and event_type <> 'view' then value end as value,
    case when event_id % 5 = 2 and event_id % 3 <> 0 then user_id % 30 end as days, case when event_id % 5 = 4 then json_extract(props, '$.k')::bigint end as k from events"""
)
def typed_extractions(get, spark, sf_dir):
    """Extractions of three schemas, some broken, cut short or of a schema that nobody registered."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 5
    lab1 = F.to_json(F.struct(F.col("event_type").alias("test"), F.struct("value").alias("result")))
    lab2 = F.when(F.col("event_type") == "view", F.to_json(F.struct(F.col("event_type").alias("name"), F.array(F.lit("high")).alias("values")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("name"), F.array("value").alias("values"))))
    days = F.when(F.col("event_id") % 3 == 0, F.lit("soon")).otherwise((F.col("user_id") % 30).cast("string"))
    drug = F.to_json(F.struct(F.col("event_type").alias("drug"), days.alias("days")))
    rows = e.select(
        F.col("event_id").alias("id"),
        F.when(n == 2, "prescription").when(n == 4, "imaging").otherwise("lab_result").alias("schema_name"),
        F.when(n == 1, "2").otherwise("1").alias("schema_version"),
        F.when(n == 0, lab1).when(n == 1, lab2).when(n == 2, drug).when(n == 3, F.substring(lab1, 1, 12)).otherwise(F.col("props")).alias("data"),
    )
    out = typed.typed(rows, _SCHEMAS)
    test, value = (F.coalesce(F.col(f"lab_result_v1.{c}"), F.col(f"lab_result_v2.{c}")) for c in ("test", "value"))
    return out.select("id", "broken", test.alias("test"), value.alias("value"), F.col("prescription_v1.days").cast("long").alias("days"), F.try_variant_get("other", "$.k", "long").alias("k"))


@_query(
    """, c as (select document_id, min(occurred_at) as came from pipeline_event where type = 'DocumentUploadRequested' group by 1),
    w as (select document_id, came, min(occurred_at) as went from pipeline_event join c using (document_id) where type = 'DocumentConverted' and occurred_at >= came group by all)
    select extract(hour from came)::integer % 4 as part, count(*) as n, round(avg((epoch_us(went) - epoch_us(came)) / 1e6), 3) as mean_seconds, true as p50_near, true as p95_near from w group by 1""",
    "pipeline_event",
)
def latency_sketches(get, spark, sf_dir):
    """Quantile sketches by hour of arrival, kept as a table and merged into four parts; whether the rank of each quantile is within two hundredths."""
    kind = F.col("type")
    took = analytics.times_taken(get("pipeline_event"), kind == "DocumentUploadRequested", kind == "DocumentConverted", "occurred_at", "document_id")
    took = took.withColumn("hour", F.hour("came")).withColumn("part", F.col("hour") % 4)
    path = shared_path(spark, "sketches")
    analytics.sketched(took, "s", "hour", "part").write.parquet(path)
    merged = analytics.merged_quantiles(spark.read.parquet(path), {"p50": 0.5, "p95": 0.95}, "part")
    # A quantile's rank lies between the shares of rows below it and up to it.
    share = {q: (F.avg((F.col("s") < F.col(q)).cast("int")).alias(f"{q}_low"), F.avg((F.col("s") <= F.col(q)).cast("int")).alias(f"{q}_high")) for q in ("p50", "p95")}
    ranks = took.join(F.broadcast(merged), "part").groupBy("part", "n", "mean").agg(*share["p50"], *share["p95"])
    near = lambda c, q: (F.col(f"{c}_low") <= q + 0.02) & (F.col(f"{c}_high") >= q - 0.02)
    return ranks.select("part", "n", F.round("mean", 3).alias("mean_seconds"), near("p50", 0.5).alias("p50_near"), near("p95", 0.95).alias("p95_near"))


@_query("select count(*) as n_queries, count(*) * 5 as n_found, true as recall_reached from embeddings where vec_id % 50 = 0")
def similar_vectors_index(get, spark, sf_dir):
    """The five nearest vectors of every fiftieth by an index over all, tuned on 200 queries at most; and whether nine tenths of the exact ones are among them."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0")
    cells = max(1, round(vectors.count() ** 0.5))
    index = vector_index.build(vectors, vector_index.fit_centroids(vectors, cells))
    found = vector_index.search(index, asked, 5, vector_index.tuned(index, vectors, asked, 5))
    exact = analytics.cosine_topk(vectors, asked, 5).select("query_id", "vec_id")
    hits = found.select("query_id", "vec_id", F.lit(True).alias("found")).join(exact.withColumn("exact", F.lit(True)), ["query_id", "vec_id"], "full")
    return hits.agg(F.count_distinct("query_id").alias("n_queries"), F.count("found").alias("n_found"), (F.count_if(F.col("found") & F.col("exact")) >= 0.9 * F.count("exact")).alias("recall_reached"))


@_query(
    r"""with md as (select doc_id, list_transform(string_split(text, chr(10)), lambda l, i: case when (doc_id + i - 1) % 4 = 0 then repeat('#', ((i - 1) % 3 + 1)::int) || ' ' || substr(l, 1, 20) else l end) as lines from documents),
    marks as (select *, regexp_matches(line, '^[ \t]{0,3}(```|~~~)') as fence from (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as n from md)),
    fences as (select *, count(*) filter (fence) over (partition by doc_id order by n) as k from marks where fence or regexp_matches(line, '^#{1,6}[ \t]+')),
    heads as (select doc_id, n, length(regexp_extract(line, '^#+')) as level, regexp_extract(line, '^#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$', 1) as title, row_number() over w as section_no, lead(n) over w as following
     from fences where not fence and k % 2 = 0 window w as (partition by doc_id order by n)),
    parts as (select doc_id, section_no, level, title, n, following from heads union all select doc_id, 0, 0, null, 0, (select min(n) from heads h where h.doc_id = md.doc_id) from md),
    texts as (select p.*, array_to_string(list_slice(lines, n + 1, coalesce(following, len(lines))), chr(10)) as text, coalesce(following, len(lines)) - n as n_lines from parts p join md using (doc_id))
    select t.doc_id, t.section_no::bigint as section_no, t.level::bigint as level, t.title, t.n_lines::bigint as n_lines, md5(t.text) as text_md5, (select max_by(h.title, h.n) from heads h where h.doc_id = t.doc_id and h.n < t.n and h.level < t.level) as parent
    from texts t where section_no > 0 or n_lines > 0 and regexp_matches(text, '[^ \t\n]')"""
)
def artifact_sections(get, spark, sf_dir):
    """Documents with every fourth line or so made a heading, in sections under the heading that they belong to."""
    docs = table(spark, sf_dir, "documents")
    heading = lambda line, i: F.concat(F.repeat(F.lit("#"), i % 3 + 1), F.lit(" "), F.substring(line, 1, 20))
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.when((F.col("doc_id") + i) % 4 == 0, heading(line, i)).otherwise(line))
    parts = artifacts.sections(docs.select("doc_id", F.array_join(lines, "\n").alias("text")), "doc_id")
    number = {c: F.col(c).cast("long").alias(c) for c in ("section_no", "level", "n_lines")}
    parent = F.get("headings", F.array_size("headings") - 2)
    return parts.select("doc_id", number["section_no"], number["level"], "title", number["n_lines"], F.md5("text").alias("text_md5"), parent.alias("parent"))


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql is not None}
