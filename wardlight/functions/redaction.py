"""Redaction of headers, JSON bodies and plain text before they are logged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "<redacted>"
#: Headers whose values are never logged (fixed values).
HEADERS = ("authorization", "cookie", "x-api-key", "x-auth-token", "x-access-token")
#: A JSON field is masked if its lower-case name contains one of these (fixed values).
FIELD_TERMS = (
    "password", "passwd", "pwd", "pass", "passphrase", "confirm_password", "new_password", "old_password", "current_password", "password_confirmation",
    "password_confirm", "repeat_password",
    "token", "access_token", "refresh_token", "auth_token", "bearer_token", "jwt", "jwt_token", "session_token", "csrf_token", "xsrf_token",
    "secret", "api_key", "apikey", "api_secret", "client_secret", "private_key", "public_key", "encryption_key", "signing_key",
    "auth", "authorization", "credential", "credentials", "session", "session_id", "cookie", "cookies",
    "pin", "ssn", "email", "phone", "name", "social_security", "social_security_number", "credit_card", "card_number", "card_num", "cvv", "cvc", "cvv2",
    "bank_account", "account_number", "routing_number",
    "otp", "verification_code", "reset_code", "activation_code", "code", "recipient", "security_question", "security_answer", "backup_codes",
)
#: Names before = or : whose value is masked in plain text, in this order (fixed values).
TEXT_NAMES = ("password", "passwd", "pwd", "token", "secret", "key", "api[_-]?key", "access[_-]?token", "email", "phone", "recipient", "code", "name")
#: Sixteen digits in groups of four (fixed value).
CARD = r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}"
#: Paths that are not logged, and types of bodies that are (fixed values).
QUIET_PATHS = ("/health", "/metrics", "/docs", "/redoc", "/openapi.json", "/favicon.ico", "/")
LOGGED_TYPES = ("application/json", "application/x-www-form-urlencoded", "text/plain", "text/html", "text/xml", "application/xml")


def mask_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*HEADERS), F.lit(REDACTED)).otherwise(v))


def mask_text(text: Column) -> Column:
    """Values after telling names, and card numbers, replaced by stars."""
    out = text
    for name in TEXT_NAMES:
        out = F.regexp_replace(out, rf"(?i)({name}[=:]\s*)([^&\s\n\r]+)", "$1***")
    some = text.rlike(rf"(?i)(?:{'|'.join(TEXT_NAMES)})[=:]")  # most texts have none, and need one pass only
    return F.regexp_replace(F.when(some, out).otherwise(text), CARD, "****-****-****-****")


# A name contains one of the terms if it contains one that contains no other: a shorter pattern, same verdicts.
_SHORTEST = tuple(t for t in FIELD_TERMS if not any(o != t and o in t for o in FIELD_TERMS))


#: A name with its colon, any other string, a sign, white space, or a bare word or number. In JSON a string before a colon is always a name.
_TOKEN = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?+|[{}\[\],]|\s++|[^\s{}\[\],:"]++'
#: Tokens that are folded at a time, so that a long body's result is not copied for each token.
_BLOCK = 64


def _telling(token: Column) -> Column:
    """Whether a token is a name with one of the terms in it; escapes are read first."""
    name = F.regexp_replace(token, r"\s*+:$", "")
    name = F.when(F.instr(name, "\\") > 0, F.get_json_object(F.concat(F.lit('{"k":'), name, F.lit("}")), "$.k")).otherwise(name)
    return token.endswith(":") & F.lower(name).rlike("|".join(_SHORTEST))


def _step(state: Column, token: Column) -> Column:
    """One token: ``skip`` counts open brackets of a value that is left out, ``pending`` says that such a value is next."""
    opens, closes, white = token.isin("{", "["), token.isin("}", "]"), token.rlike(r"^\s")
    skipping = state["skip"] > 0
    hides = state["pending"] & ~white & ~skipping
    kept = F.when(token == "null", token).otherwise(F.lit(f'"{REDACTED}"'))
    return F.struct(
        F.when(skipping, state["skip"] + opens.cast("int") - closes.cast("int")).when(hides & opens, 1).otherwise(0).alias("skip"),
        F.when(skipping, False).when(state["pending"], white).otherwise(_telling(token)).alias("pending"),
        F.concat(state["out"], F.when(skipping, "").when(hides, kept).otherwise(token)).alias("out"),
    )


def _fold(tokens: Column) -> Column:
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.array_size(tokens) - 1, F.lit(0)), F.lit(_BLOCK)), lambda i: F.slice(tokens, i + 1, _BLOCK))
    empty = F.struct(F.lit(0).alias("skip"), F.lit(False).alias("pending"), F.lit("").alias("out"))

    def block(state: Column, own: Column) -> Column:
        begun = F.struct(state["skip"].alias("skip"), state["pending"].alias("pending"), F.lit("").alias("out"))
        return F.aggregate(own, begun, _step, lambda done: F.struct(done["skip"].alias("skip"), done["pending"].alias("pending"), F.concat(state["out"], done["out"]).alias("out")))

    return F.aggregate(blocks, empty, block, lambda done: done["out"])


def mask_json(body: Column) -> Column:
    """JSON of any depth with the values of telling fields masked; what is no JSON is masked as text.

    Null values stay null; the rest keeps its spelling. Objects that repeat a name, NaN and Infinity are no JSON here.
    """
    tokens = F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0))
    # Most bodies have no telling name, and need no fold.
    some = body.rlike(rf"(?i)(?:{'|'.join(_SHORTEST)})|\\u")
    folded = F.transform(F.array(tokens), _fold)[0]
    return F.when(F.try_parse_json(body).isNotNull(), F.when(some, folded).otherwise(body)).otherwise(mask_text(body))


def logged_body(body: Column, most: int = 10_000) -> Column:
    """What is logged of a binary body: masked JSON or text, or a note in its place if it is longer than ``most`` bytes or no UTF-8; null for an empty one."""
    n, text = F.octet_length(body), body.cast("string")
    masked = F.when(F.is_valid_utf8(text), mask_json(text)).otherwise(F.format_string("<binary data: %d bytes>", n))
    return F.when(n > most, F.format_string("<body too large: %d bytes>", n)).when(n > 0, masked)


def is_logged_path(path: Column) -> Column:
    return ~path.isin(*QUIET_PATHS)


def is_logged_type(content_type: Column) -> Column:
    wanted = F.lit(False)
    for t in LOGGED_TYPES:
        wanted = wanted | content_type.startswith(t)
    return F.coalesce(wanted, F.lit(False))


def capped_body(body: Column, most: int = 10_000) -> Column:
    """The body, or a note in its place if it is longer than ``most`` bytes in UTF-8."""
    n = F.octet_length(body)
    return F.when(n > most, F.format_string("<body too large: %d bytes>", n)).otherwise(body)
