"""Access rules, decisions and key audits over logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import blank_to_null, clean_prefix, squeeze, tenant_or_default, under_prefix
from tracelake.operators.joins import key_identity

# Permissions and the roles that imply them.
PROXY_WRITE, ANALYTICS_READ, KEYS_MANAGE = "proxy:write", "analytics:read", "keys:manage"
ROLE_PERMISSIONS = {
    "owner": (PROXY_WRITE, ANALYTICS_READ, KEYS_MANAGE),
    "admin": (PROXY_WRITE, ANALYTICS_READ, KEYS_MANAGE),
    "developer": (PROXY_WRITE, ANALYTICS_READ),
    "member": (PROXY_WRITE, ANALYTICS_READ),
    "": (PROXY_WRITE, ANALYTICS_READ),
    "viewer": (ANALYTICS_READ,),
}
DEFAULT_ROLE = "developer"

# API paths below the prefix with their resource, action, permission and methods.
READ = ("GET", "HEAD")
API_RULES = (
    (r"/traces|/traces/+[^/]*[^/\s][^/]*/*|/traces/+[^/]*[^/\s][^/]*/\s*replay\s*/*", READ, "traces", "read", ANALYTICS_READ),
    (r"/traces/+[^/]*[^/\s][^/]*/\s*fork\s*/*", ("POST",), "traces", "read", ANALYTICS_READ),
    (r"/analytics/(?:usage|cost|models|keys|summary)", READ, "analytics", "read", ANALYTICS_READ),
    (r"/diagnostics/trace-pipeline", READ, "diagnostics", "read", ANALYTICS_READ),
    (r"/access-keys", ("GET", "POST"), "access_keys", "manage", KEYS_MANAGE),
    (r"/access-keys/+[^/]+/*", ("DELETE",), "access_keys", "manage", KEYS_MANAGE),
    (r"/access-keys/+[^/]+/rotate/*", ("POST",), "access_keys", "manage", KEYS_MANAGE),
)


def access_requirement(
    method: Column, path: Column, routes: Sequence[tuple[str, str]], api_prefix: str = "/api", dashboard: bool = True
) -> Column:
    """What a request needs: struct(mode, resource, action, scope, permission, provider, deny_reason).

    ``mode`` is bypass, require or deny. Provider routes are tried in the given order and come
    before the API.
    """
    api = clean_prefix(api_prefix)
    api = "/api" if api == "/" else api
    verb = F.upper(squeeze(method))
    usable = [(n.strip(), clean_prefix(p)) for n, p in routes if n.strip() and clean_prefix(p) != "/"]
    provider = F.lit("")
    for name, prefix in reversed(usable):
        provider = F.when(under_prefix(path, prefix), F.lit(name)).otherwise(provider)

    def answer(mode: str, resource: str = "", action: str = "", scope: str = "", permission: str = "", by: Column | None = None, reason: str = "") -> Column:
        values = {"mode": mode, "resource": resource, "action": action, "scope": scope, "permission": permission}
        named = [F.lit(v).alias(n) for n, v in values.items()]
        return F.struct(*named, (F.lit("") if by is None else by).alias("provider"), F.lit(reason).alias("deny_reason"))

    in_api = under_prefix(path, api)
    on_dashboard = under_prefix(path, "/dashboard") if dashboard else F.lit(False)
    bypass = answer("bypass")
    rule = F.when((verb == "OPTIONS") & (in_api | on_dashboard | (provider != "")), bypass)
    rule = rule.when(provider != "", answer("require", "proxy", "forward", "workspace", PROXY_WRITE, provider))
    if dashboard:
        rule = rule.when((path == "/dashboard") & verb.isin(*READ), answer("require", "dashboard", "read", "workspace", ANALYTICS_READ))
    rule = rule.when(~in_api, bypass).when((path == f"{api}/health") & verb.isin(*READ), bypass)
    for pattern, methods, resource, action, permission in API_RULES:
        hit = path.rlike(f"^{api}(?:{pattern})$") & verb.isin(*methods)
        rule = rule.when(hit, answer("require", resource, action, "workspace", permission))
    return rule.otherwise(answer("deny", "api", "", "workspace", reason="action_unmapped"))


def effective_permissions(role: Column, extra: Column) -> Column:
    """Role defaults and explicit permissions; an unknown role implies none."""
    lowered = F.lower(squeeze(F.coalesce(role, F.lit(""))))
    implied = F.array().cast("array<string>")
    for name, granted in ROLE_PERMISSIONS.items():
        implied = F.when(lowered == name, F.array(*[F.lit(p) for p in granted])).otherwise(implied)
    return F.array_union(implied, normalized_permissions(extra))


def normalized_permissions(permissions: Column) -> Column:
    """Trimmed, lower case, blanks and repeats dropped, order kept."""
    given = F.coalesce(permissions, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(given, lambda p: F.lower(squeeze(p))), lambda p: p != ""))


def access_decisions(log: DataFrame, keys: DataFrame, routes: Sequence[tuple[str, str]], **rules) -> DataFrame:
    """Outcome, reason and status of every logged request; the first failing check decides.

    ``log``: request_id, method, path, token_hash ('' if no key was sent), has_credential,
    limit_code. ``keys``: id, token_hash, org_id, workspace_id, role, permissions, revoked_at.
    """
    needed = log.withColumn("need", access_requirement(F.col("method"), F.col("path"), routes, **rules))
    known = keys.withColumn("permissions", effective_permissions(F.col("role"), F.col("permissions")))
    joined = key_identity(needed, known)
    need = F.col("need")
    guarded = need["mode"] == "require"
    through = need["provider"] != ""
    checks = (
        (need["mode"] == "deny", F.coalesce(F.nullif(need["deny_reason"], F.lit("")), F.lit("action_not_allowed")), 403),
        (guarded & (F.coalesce(blank_to_null(F.col("token_hash")), F.lit("")) == ""), F.lit("missing_access_key"), 401),
        (guarded & F.col("key_id").isNull(), F.lit("invalid_access_key"), 401),
        (guarded & ~F.array_contains("key_permissions", need["permission"]), F.lit("permission_denied"), 403),
        (guarded & through & ~F.col("has_credential"), F.lit("missing_provider_credential"), 403),
        (guarded & through & (F.col("limit_code") != ""), F.lit("usage_limit_exceeded"), 429),
    )
    reason = reduce(lambda acc, c: F.when(c[0], c[1]).otherwise(acc), reversed(checks), F.lit(""))
    status = reduce(lambda acc, c: F.when(c[0], F.lit(c[2])).otherwise(acc), reversed(checks), F.lit(200))
    # Failures before the key is known carry no tenant.
    named = guarded & F.col("key_id").isNotNull()
    return joined.select(
        "request_id",
        "path",
        F.when(status == 200, F.lit("allow")).otherwise(F.lit("deny")).alias("outcome"),
        reason.alias("reason"),
        status.alias("status_code"),
        need["resource"].alias("resource"),
        need["action"].alias("resource_action"),
        need["scope"].alias("scope"),
        need["permission"].alias("required_permission"),
        need["provider"].alias("provider"),
        F.when(named, F.col("key_id")).otherwise(F.lit("")).alias("key_id"),
        F.when(named, tenant_or_default(F.col("key_org_id"))).otherwise(F.lit("")).alias("org_id"),
        F.when(named, tenant_or_default(F.col("key_workspace_id"))).otherwise(F.lit("")).alias("workspace_id"),
        F.when(status == 429, F.col("limit_code")).otherwise(F.lit("")).alias("limit_code"),
    )


def deny_rollup(decisions: DataFrame) -> DataFrame:
    return (
        decisions.filter(F.col("outcome") == "deny")
        .groupBy("reason", "status_code", "org_id", "workspace_id", "path")
        .agg(F.count(F.lit(1)).alias("denies"))
    )


def active_inventory(keys: DataFrame) -> DataFrame:
    """Keys in force per tenant, oldest first."""
    return keys.filter(F.col("revoked_at").isNull()).orderBy("org_id", "workspace_id", "created_at", "id")


def workspaces_of(orgs: DataFrame, workspaces: DataFrame) -> DataFrame:
    return workspaces.join(orgs.select("org_id"), "org_id").orderBy("org_id", "created_at", "workspace_id")


def lifecycle_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("action", "outcome", "reason", "org_id", "workspace_id").agg(F.count(F.lit(1)).alias("events"))


def key_states(events: DataFrame) -> DataFrame:
    """State of each key after its last successful event."""
    done = events.filter(F.col("outcome") == "success")
    state = F.when(F.col("action") == "revoke", F.lit("revoked")).otherwise(F.lit("active"))
    newest = F.max(F.struct("ts", "event_id", state.alias("state"), "action"))
    return done.groupBy("target_key_id").agg(newest.alias("n"), F.count_if(F.col("action") == "rotate").alias("rotations")).select(
        "target_key_id", F.col("n.state").alias("state"), F.col("n.action").alias("last_action"), F.col("n.ts").alias("changed_at"), "rotations"
    )


def normalize_keys(keys: DataFrame) -> DataFrame:
    """Stored form of key rows: trimmed, hashed, tenant and role defaults, clean permissions."""
    given = F.lower(squeeze(F.coalesce("token_hash", F.lit(""))))
    token = squeeze(F.coalesce("token", F.lit("")))
    hashed = F.when(given != "", given).when(token != "", F.sha2(token, 256)).otherwise(F.lit(""))
    changes = {
        "id": squeeze(F.col("id")),
        "token_hash": hashed,
        "org_id": tenant_or_default(F.col("org_id")),
        "workspace_id": tenant_or_default(F.col("workspace_id")),
        "role": F.coalesce(blank_to_null(F.lower("role")), F.lit(DEFAULT_ROLE)),
        "permissions": normalized_permissions(F.col("permissions")),
    }
    return keys.withColumns(changes).drop("token")


def touch_last_used(keys: DataFrame, traces: DataFrame) -> DataFrame:
    """Active keys with the time of their last use; one row per key and task leaves the traces."""
    used = traces.groupBy(F.col("access_key_id").alias("id")).agg(F.max("timestamp").alias("last_used_at"))
    return keys.filter(F.col("revoked_at").isNull()).join(used, "id", "left")
