"""Personal data, credentials and guardrails."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.catalog.joins import FALLBACK, POLICIES, POLICY_SQL
from tracelake.catalog.sql import on_traces
from tracelake.functions import privacy as ops
from tracelake.operators.joins import policy_columns
from tracelake.registry import query
from tracelake.sources import derived

SALT = "ws-salt:"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(pattern: str, col: str = "text") -> str:
    return f"len(regexp_extract_all({col}, {_lit(pattern)}))"


_COUNTS = ", ".join(f"{_count(p)} AS {n}" for n, p in ops.DETECTORS.items())


@query("p1_detect_pii", f"SELECT doc_id, {_COUNTS} FROM documents")
def detect_pii(spark, sf):
    return derived.table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in ops.detector_counts(F.col("text")).items()])


def _redact_sql(col: str) -> str:
    """The same stitching in SQL: pieces between matches and hashed matches take turns."""
    out = col
    for name, pattern in ops.DETECTORS.items():
        mark = f"'[{name.upper()}_REDACTED:' || sha256('{SALT}' || m) || ']'"
        pieces = f"regexp_split_to_array(t, {_lit(pattern)})"
        marks = f"list_transform(regexp_extract_all(t, {_lit(pattern)}), lambda m: {mark})"
        out = f"""(SELECT array_to_string(list_transform(list_zip({pieces}, {marks}), lambda z: z[1] || coalesce(z[2], '')), '') FROM (SELECT {out} AS t))"""
    return out


@query("p2_redact_text", f"SELECT doc_id, sha256({_redact_sql('text')}) AS redacted_sha FROM documents")
def redact_text(spark, sf):
    cleaned = ops.redact_text(F.col("text"), F.lit(SALT))
    return derived.table(spark, sf, "documents").select("doc_id", F.sha2(cleaned, 256).alias("redacted_sha"))


@query(
    "p2_redaction_hashes",
    f"""SELECT DISTINCT doc_id, kind, sha256('{SALT}' || m) AS value_hash FROM (
      SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, {_lit(ops.EMAIL)})) AS m FROM documents
      UNION ALL SELECT doc_id, 'token_like', unnest(regexp_extract_all(text, {_lit(ops.TOKEN_LIKE)})) FROM documents)""",
)
def redaction_hashes(spark, sf):
    docs = derived.table(spark, sf, "documents")
    found = [
        docs.select("doc_id", F.lit(k).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(ops.DETECTORS[k]), F.lit(0))).alias("m"))
        for k in ("email", "token_like")
    ]
    return found[0].unionByName(found[1]).select("doc_id", "kind", ops.value_hash(F.lit(SALT), F.col("m")).alias("value_hash")).distinct()


@query(
    "p3_redact_json_flat",
    f"""SELECT doc_id, '[EMAIL_REDACTED:' || sha256('{SALT}' || source) || ']' AS email, '[FIELD_REDACTED:' || sha256('{SALT}' || lang) || ']' AS api_key, lang AS note FROM documents""",
)
def redact_json_flat(spark, sf):
    fields = F.create_map(F.lit("Email"), F.col("source"), F.lit("api_key"), F.col("lang"), F.lit("note"), F.col("lang"))
    cleaned = ops.redact_flat_fields(fields, F.lit(SALT))
    d = derived.table(spark, sf, "documents").select("doc_id", cleaned.alias("m"))
    return d.select("doc_id", F.col("m")["Email"].alias("email"), F.col("m")["api_key"].alias("api_key"), F.col("m")["note"].alias("note"))


@query(
    "p3_redact_json_deep",
    f"""SELECT doc_id, '[FIELD_REDACTED:' || sha256('{SALT}' || source) || ']' AS secret, '[PHONE_REDACTED:' || sha256('{SALT}' || CAST(n_chars AS VARCHAR)) || ']' AS phone,
        sha256({_redact_sql('text')}) AS text_sha, 2 + {' + '.join(_count(p) for p in ops.DETECTORS.values())} AS hits FROM documents""",
)
def redact_json_deep(spark, sf):
    inner = F.struct(F.col("source").alias("Secret"), F.array(F.struct(F.col("n_chars").alias("phone"))).alias("list"), F.col("text").alias("text"))
    docs = derived.table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(inner.alias("outer"))).alias("body"))
    cleaned = docs.withColumn("r", ops.json_redactor()(F.col("body"), F.lit(SALT)))
    return cleaned.select(
        "doc_id",
        F.get_json_object("r.body", "$.outer.Secret").alias("secret"),
        F.get_json_object("r.body", "$.outer.list[0].phone").alias("phone"),
        F.sha2(F.get_json_object("r.body", "$.outer.text"), 256).alias("text_sha"),
        F.col("r.hits").alias("hits"),
    )


@query(
    "p4_redaction_metadata",
    f"""SELECT doc_id, 'redact_storage' AS mode, doc_id % 10 <> 9 AND ({' + '.join(_count(p) for p in ops.DETECTORS.values())}) > 0 AS redaction_applied, {_count(ops.EMAIL)} AS email,
        'default/v1' AS redaction_policy_id, octet_length(encode(text)) > 4096 AS redaction_truncated, doc_id % 10 = 9 AS redaction_storage_drop, doc_id % 10 <> 9 AS body_stored FROM documents""",
)
def redaction_metadata(spark, sf):
    failed = F.col("doc_id") % 10 == 9
    meta = ops.redaction_metadata(
        F.lit("redact_storage"), F.lit("default/v1"), ops.detector_counts(F.col("text")), F.octet_length("text") > 4096, failed
    )
    d = derived.table(spark, sf, "documents").select("doc_id", meta.alias("m"), ops.stored_body(F.col("text"), failed).isNotNull().alias("body_stored"))
    return d.select(
        "doc_id", "m.mode", "m.redaction_applied", F.col("m.redaction_counts.email").alias("email"), "m.redaction_policy_id", "m.redaction_truncated", "m.redaction_storage_drop", "body_stored"
    )


@query(
    "p5_guardrail_decision",
    on_traces(
        f"""WITH d AS (SELECT id, split_part({POLICY_SQL}, '|', 1) AS mode, total_tokens AS size, latency_ms % 3 = 0 AS hit, CASE response_status WHEN 429 THEN 'image/png' WHEN 500 THEN ' Application/JSON; x=1' WHEN 400 THEN 'application/ld+json' ELSE '' END AS ct, input_tokens % 17 = 0 AS ws FROM traces)
        SELECT id, CASE WHEN mode IN ('off', 'redact_storage') THEN 'allow' WHEN ws THEN 'deny' WHEN size = 0 THEN 'allow' WHEN size > 600 OR ct = 'image/png' THEN 'deny' WHEN hit AND mode = 'block' THEN 'deny' WHEN hit THEN 'redact' ELSE 'allow' END AS action,
          CASE WHEN mode IN ('off', 'redact_storage') THEN 200 WHEN ws THEN 503 WHEN size = 0 THEN 200 WHEN size > 600 OR ct = 'image/png' THEN 503 WHEN hit AND mode = 'block' THEN 403 ELSE 200 END AS status FROM d"""
    ),
)
def guardrail_decision(spark, sf):
    t = derived.traces(spark, sf)
    mode = policy_columns(POLICIES, FALLBACK, F.col("org_id"), F.col("workspace_id"), F.col("access_key_id"), F.col("provider"), F.col("request_path"))["pii_mode"]
    status = F.col("response_status")
    media = (
        F.when(status == 429, F.lit("image/png")).when(status == 500, F.lit(" Application/JSON; x=1")).when(status == 400, F.lit("application/ld+json")).otherwise(F.lit(""))
    )
    hits = F.when(F.col("latency_ms") % 3 == 0, F.lit(1)).otherwise(F.lit(0))
    d = ops.guardrail_decision(mode, F.lit(True), F.col("input_tokens") % 17 == 0, F.col("total_tokens"), 600, media, hits)
    return t.select("id", d.alias("d")).select("id", "d.action", "d.status")


_SCRUB = "text"
for _p in ops.CREDENTIALS:
    _SCRUB = f"regexp_replace({_SCRUB}, {_lit(_p)}, '[CREDENTIAL_REDACTED]', 'g')"


@query(
    "p6_scrub_credentials",
    f"""SELECT doc_id, sha256(CASE WHEN octet_length(encode(text)) < 8 OR s = text THEN text ELSE regexp_replace(s, '^\\s+|\\s+$', '', 'g') END) AS scrubbed_sha FROM (SELECT doc_id, text, {_SCRUB} AS s FROM documents)""",
)
def scrub_credentials(spark, sf):
    return derived.table(spark, sf, "documents").select("doc_id", F.sha2(ops.scrub_credentials(F.col("text")), 256).alias("scrubbed_sha"))


_HIT = "octet_length(encode(text)) >= 8 AND (" + " OR ".join(f"regexp_matches(text, {_lit(p)})" for p in ops.CREDENTIALS) + ")"


@query(
    "p7_credential_leaks",
    f"""SELECT source, count(*) AS checked, count(*) FILTER (WHERE {_HIT}) AS leaks FROM documents GROUP BY source""",
)
def credential_leaks(spark, sf):
    d = derived.table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("checked"), F.count_if(ops.contains_credential(F.col("text"))).alias("leaks"))


@query(
    "a21_redaction_counts",
    "SELECT lang AS workspace_id, kind AS detector, CAST(sum(n) AS BIGINT) AS redactions, count(*) FILTER (WHERE n > 0) AS documents, count(*) FILTER (WHERE doc_id % 10 = 9) AS failures FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, lang, '{n}' AS kind, {_count(p)} AS n FROM documents" for n, p in ops.DETECTORS.items())
    + ") GROUP BY ALL",
)
def redaction_counts(spark, sf):
    counted = ops.detector_counts(F.col("text"))
    entries = F.array(*[F.struct(F.lit(n).alias("detector"), c.alias("n")) for n, c in counted.items()])
    rows = derived.table(spark, sf, "documents").select(F.col("lang").alias("workspace_id"), (F.col("doc_id") % 10 == 9).alias("failed"), F.inline(entries))
    return rows.groupBy("workspace_id", "detector").agg(
        F.sum("n").cast("bigint").alias("redactions"), F.count_if(F.col("n") > 0).alias("documents"), F.count_if("failed").alias("failures")
    )
