"""Detection and replacement of personal data and credentials, on whole texts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.text import squeeze

# Credential patterns, applied in this order.
TOKEN_PREFIX = r"(?i)\b(?:sk|pk|rk|xox[baprs]|gh[pousr]|pat)_[a-z0-9_-]{8,}\b"
JWT = r"(?i)eyj[a-z0-9_-]{8,}\.[a-z0-9_-]{8,}\.[a-z0-9_-]{8,}"
BEARER = r"(?i)\bBearer\s+[a-z0-9_.\-/+=]{8,}\b"
SECRET_ASSIGNMENT = r"(?i)\b(?:password|secret|token)\s*=\s*\S{4,}"
CREDENTIALS = (TOKEN_PREFIX, JWT, BEARER, SECRET_ASSIGNMENT)
CREDENTIAL_MARK = "[CREDENTIAL_REDACTED]"
SHORTEST_CREDENTIAL = 8

# Our choice: conservative patterns for mail, phone and social security numbers.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[-. ])?\(?\b[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
TOKEN_LIKE = "(?i)" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in (TOKEN_PREFIX, JWT, SECRET_ASSIGNMENT))

# Detector name and pattern, applied in this order.
DETECTORS = {"email": EMAIL, "phone": PHONE, "ssn": SSN, "token_like": TOKEN_LIKE}

# JSON keys whose values are always replaced.
DENIED_KEYS = ("email", "phone", "password", "token", "secret", "ssn", "api_key", "authorization")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _worth(pattern: str, text: Column) -> Column:
    """Cheap test that must hold wherever the pattern matches; most texts end here."""
    tests = {
        TOKEN_PREFIX: lambda: text.contains("_"),
        JWT: lambda: F.lower(text).contains("eyj"),
        BEARER: lambda: F.lower(text).contains("bearer"),
        SECRET_ASSIGNMENT: lambda: text.contains("="),
        EMAIL: lambda: text.contains("@"),
        TOKEN_LIKE: lambda: text.contains("_") | text.contains("=") | F.lower(text).contains("eyj"),
    }
    return tests.get(pattern, lambda: F.lit(True))()


def scrub_credentials(text: Column) -> Column:
    """Replace credentials; the result is trimmed only if something was replaced."""

    def replace(value: Column, pattern: str) -> Column:
        return _let(value, lambda t: F.when(_worth(pattern, t), F.regexp_replace(t, pattern, CREDENTIAL_MARK)).otherwise(t))

    def scrubbed(whole: Column) -> Column:
        cleaned = whole
        for pattern in CREDENTIALS:
            cleaned = replace(cleaned, pattern)
        return _let(cleaned, lambda c: F.when(c == whole, whole).otherwise(squeeze(c)))

    return F.when(F.octet_length(text) < SHORTEST_CREDENTIAL, text).otherwise(scrubbed(text))


def contains_credential(text: Column) -> Column:
    found = F.lit(False)
    for pattern in CREDENTIALS:
        found = found | (_worth(pattern, text) & text.rlike(pattern))
    return (F.octet_length(text) >= SHORTEST_CREDENTIAL) & found


def telemetry_label(text: Column) -> Column:
    """Safe metric label: no credentials, never blank."""
    return F.coalesce(F.nullif(scrub_credentials(squeeze(F.coalesce(text, F.lit("")))), F.lit("")), F.lit("unknown"))


def detector_counts(text: Column, detectors: Sequence[str] = tuple(DETECTORS)) -> dict[str, Column]:
    return {
        name: F.when(text.isNotNull(), F.when(_worth(DETECTORS[name], text), F.regexp_count(text, F.lit(DETECTORS[name]))).otherwise(F.lit(0)))
        for name in detectors
    }


def value_hash(salt: Column, value: Column) -> Column:
    return F.sha2(F.concat(salt, value), 256)


def placeholder(kind: Column | str, salt: Column, value: Column) -> Column:
    label = F.lit(kind.upper()) if isinstance(kind, str) else F.upper(kind)
    return F.concat(F.lit("["), label, F.lit("_REDACTED:"), value_hash(salt, value), F.lit("]"))


def redact_matches(text: Column, name: str, salt: Column) -> Column:
    """Replace every match by a placeholder with the hash of salt and value.

    The text is split at the matches and stitched together again, so each match gets its own hash
    without leaving the JVM.
    """
    pattern = DETECTORS[name]

    def stitched(t: Column) -> Column:
        def joined(found: Column) -> Column:
            pieces = F.zip_with(
                F.split(t, pattern, -1), found, lambda gap, hit: F.concat(gap, F.coalesce(placeholder(name, salt, hit), F.lit("")))
            )
            return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(t)

        return F.when(_worth(pattern, t), _let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), joined)).otherwise(t)

    return _let(text, stitched)


def redact_text(text: Column, salt: Column, detectors: Sequence[str] = tuple(DETECTORS)) -> Column:
    out = text
    for name in detectors:
        out = redact_matches(out, name, salt)
    return out


def field_label(key: Column) -> Column:
    """Placeholder label of a denied key: its own name for mail, phone and SSN, else FIELD."""
    lowered = F.lower(key)
    return F.when(lowered.isin("email", "phone", "ssn"), F.upper(lowered)).otherwise(F.lit("FIELD"))


def _label(key: str) -> str:
    lowered = key.lower()
    return lowered.upper() if lowered in ("email", "phone", "ssn") else "FIELD"


def _mark(label: str, salt: str, value: str) -> str:
    return f"[{label}_REDACTED:{hashlib.sha256((salt + value).encode()).hexdigest()}]"


def json_redactor(denied: Sequence[str] = DENIED_KEYS, detectors: Sequence[str] = tuple(DETECTORS)):
    """Arrow UDF (body, salt) -> struct(body, hits): denied keys at any depth and matches in any string.

    NULL body and hits -1 mean the text is no JSON; the caller must then drop it or treat it as text.
    """
    names = frozenset(n.lower() for n in denied)
    patterns = [(n.upper(), re.compile(DETECTORS[n])) for n in detectors]

    def clean(node, salt: str, hits: list[int]):
        if isinstance(node, dict):
            out = {}
            for key, value in node.items():
                if key.lower() in names:
                    hits[0] += 1
                    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
                    out[key] = _mark(_label(key), salt, text)
                else:
                    out[key] = clean(value, salt, hits)
            return out
        if isinstance(node, list):
            return [clean(v, salt, hits) for v in node]
        if isinstance(node, str):
            for label, pattern in patterns:
                node, count = pattern.subn(lambda m, label=label: _mark(label, salt, m.group(0)), node)
                hits[0] += count
        return node

    @F.pandas_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("hits", T.LongType())]))
    def redact(bodies: pd.Series, salts: pd.Series) -> pd.DataFrame:
        rows = []
        for body, salt in zip(bodies, salts):
            hits = [0]
            try:
                cleaned = json.dumps(clean(json.loads(body), salt or "", hits), ensure_ascii=False, separators=(",", ":"))
                rows.append((cleaned, hits[0]))
            except (TypeError, ValueError, RecursionError):  # no JSON, or nested deeper than it can be walked
                rows.append((None, -1))
        return pd.DataFrame(rows, columns=["body", "hits"])

    return redact


def redact_flat_fields(fields: Column, salt: Column) -> Column:
    """Denied keys of a flat map of texts, without leaving the JVM."""
    return F.transform_values(
        fields, lambda k, v: F.when(F.lower(k).isin(*DENIED_KEYS), placeholder(field_label(k), salt, v)).otherwise(v)
    )


def redaction_metadata(mode: Column, policy_id: Column, counts: dict[str, Column], cut: Column, failed: Column) -> Column:
    """What is recorded about a redaction; never the values themselves."""
    total = sum(counts.values(), F.lit(0))
    return F.struct(
        mode.alias("mode"),
        (~failed & (total > 0)).alias("redaction_applied"),
        F.struct(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in counts.items()]).alias("redaction_counts"),
        policy_id.alias("redaction_policy_id"),
        cut.alias("redaction_truncated"),
        failed.alias("redaction_storage_drop"),
    )


def stored_body(redacted: Column, failed: Column) -> Column:
    """A body that could not be redacted is never stored."""
    return F.when(~failed, redacted)


GUARDED_MODES = ("redact_upstream", "block")


def inspectable_type(content_type: Column) -> Column:
    """JSON and text bodies can be inspected; a missing type counts as text."""
    media = F.lower(squeeze(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    good = (media == "application/json") | (media.endswith("+json") & media.contains("/")) | media.startswith("text/")
    return (squeeze(F.coalesce(content_type, F.lit(""))) == "") | good


def guardrail_decision(mode: Column, inspects: Column, websocket: Column, size: Column, limit: int, content_type: Column, hits: Column) -> Column:
    """struct(action, status, reason) for a request under a policy mode."""

    def answer(action: str, status: int, reason: str = "") -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    allow = answer("allow", 200)
    unsure = answer("deny", 503, "policy_evaluation_failed")
    return (
        F.when(~mode.isin(*GUARDED_MODES), allow)
        .when(~inspects, allow)
        .when(websocket, answer("deny", 503, "websocket_body_guardrail_unsupported"))
        .when(size == 0, allow)
        .when(size > limit, unsure)
        .when(~inspectable_type(content_type), unsure)
        .when((hits > 0) & (mode == "block"), answer("deny", 403, "pii_detected"))
        .when(hits > 0, answer("redact", 200))
        .otherwise(allow)
    )
