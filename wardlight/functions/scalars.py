"""Column functions: normalising, names and types of files, keys, addresses, hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content types by file extension and file extensions by content type (fixed values).
MIME_BY_EXTENSION = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff"}
EXTENSION_BY_MIME = {"application/pdf": "pdf", "image/jpeg": "jpg", "image/png": "png", "image/tiff": "tiff"}
#: Leading bytes of the accepted types, in hexadecimal (fixed values).
LEADING_BYTES = (("255044462D", "application/pdf"), ("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"))
#: Answers to failures by name (fixed values); anything else is 400.
STATUS_BY_FAILURE = {
    "RateLimitError": 429, "OtpVerificationError": 400, "RefreshTokenError": 401, "PersonNotFoundError": 404, "PatientAlreadyExistsError": 409,
    "DocumentNotFoundError": 404, "DocumentQuotaExceededError": 429, "FileTooLargeError": 413, "UnsupportedFileTypeError": 415,
    "StorageUnavailableError": 503, "JobNotFoundError": 404, "EncounterNotFoundError": 404, "PatientAccessGrantNotFoundError": 404, "RoleNotFoundError": 404,
}
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
OTP = "^[0-9]{6}$"


def _lookup(values: dict, key: Column) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def normalize_email(value: Column) -> Column:
    """Lower case, without white space of any kind around."""
    return F.lower(F.regexp_replace(value, r"^(?U:\s)+|(?U:\s)+$", ""))


def normalize_email_sql(value: Column) -> Column:
    """Lower case, without spaces around; tabs and line breaks stay."""
    return F.lower(F.trim(value))


def channel(identity: Column) -> Column:
    """'email' or 'phone', by the form of the identity as it is."""
    return F.when(identity.rlike(EMAIL), "email").otherwise("phone")


def is_otp(value: Column) -> Column:
    return value.rlike(OTP)


def basename(path: Column) -> Column:
    """What follows the last slash, so that a name can't leave its folder."""
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension without the dot; '' if there is none."""
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def title_or_stem(title: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), stem(name))


def chosen_mime(content_type: Column, name: Column) -> Column:
    """The declared type if it is accepted, else the extension's; null if neither is."""
    declared = F.lower(content_type)
    return F.when(declared.isin(*EXTENSION_BY_MIME), declared).otherwise(_lookup(MIME_BY_EXTENSION, extension(name)))


def sniff_mime(content: Column) -> Column:
    """Type by leading bytes; null if unknown."""
    out = F.lit(None).cast("string")
    for head, mime in reversed(LEADING_BYTES):
        out = F.when(F.startswith(content, F.unhex(F.lit(head))), mime).otherwise(out)
    return out


def stored_name(mime: Column) -> Column:
    return F.concat(F.lit("original."), F.coalesce(_lookup(EXTENSION_BY_MIME, mime), F.lit("bin")))


def object_key(tenant: Column, patient: Column, document: Column, version: Column, name: Column) -> Column:
    """tenants/../patients/../documents/../versions/../name"""
    return F.concat_ws("/", F.lit("tenants"), tenant, F.lit("patients"), patient.cast("string"), F.lit("documents"), document.cast("string"), F.lit("versions"), version.cast("string"), name)


def client_ip(forwarded_for: Column, real_ip: Column, peer: Column) -> Column:
    """The first forwarded address, else the proxy's, else the peer's; blank ones don't count."""
    first = F.trim(F.split_part(forwarded_for, F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.trim(real_ip), F.lit("")), peer)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def log_level(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("info")


def failure_status(name: Column) -> Column:
    return F.coalesce(_lookup(STATUS_BY_FAILURE, name), F.lit(400))


def config_list(value: Column) -> Column:
    """Items of a comma-separated setting, trimmed, without blanks."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def hmac_sha256(secret: str):
    """A function of a string column: its HMAC-SHA256 in hexadecimal, from two SHA-256 over padded keys; null stays null."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))

    def digest(value: Column) -> Column:
        first = F.sha2(F.concat(inner, F.encode(value, "utf-8")), 256)
        return F.sha2(F.concat(outer, F.unhex(first)), 256)

    return digest


def as_utc(naive: Column) -> Column:
    """The moment of a timestamp without zone that is meant in UTC, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), naive).cast("timestamp")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from one moment to another, the rest cut off; null if either is."""
    return ((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000).cast("long")


def random_code(seed: int | None = None) -> Column:
    """Six random digits, with zeros in front. Spark's generator is not a cryptographic one: for test data only."""
    return F.lpad(F.floor(F.rand(seed) * 1_000_000).cast("string"), 6, "0")
