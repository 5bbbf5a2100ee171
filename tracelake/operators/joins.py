"""Joins of traces with routes, keys, policies, bodies and logs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.metadata import meta_string
from tracelake.functions.text import blank_to_null, clean_prefix, normalize_prefix, under_prefix


def export_with_bodies(page: DataFrame, bodies: DataFrame) -> DataFrame:
    """Bodies for one page: the page's ids first cut the body table, which AQE leaves unshuffled for a small page."""
    wanted = bodies.join(page.select(F.col("id").alias("trace_id")), "trace_id", "left_semi")
    return page.join(wanted.withColumnRenamed("trace_id", "id"), "id", "left")


def route_join(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """Provider of each request path from a route table (name, prefix), smallest name first.

    A path lies under those prefixes that are its own ancestors, so each distinct path is shown once for
    every segment it has and meets the routes by equality; no path is compared with all routes.
    """
    distinct = paths.select("request_path").distinct()
    parts = F.split("request_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ancestors = F.array_distinct(F.transform(above, lambda p: F.when(p == "", F.lit("/")).otherwise(p)))
    shown = distinct.withColumn("_prefix", F.explode(F.array_union(ancestors, F.array(F.lit("/")))))
    named = routes.groupBy(normalize_prefix(F.col("prefix")).alias("_prefix")).agg(F.min("name").alias("name"))
    found = shown.join(named, "_prefix").groupBy("request_path").agg(F.min("name").alias("route_provider"))
    return paths.join(found, "request_path", "left").withColumn("route_provider", F.coalesce("route_provider", F.lit("unknown")))


def parent_links(rows: DataFrame, chain: Sequence[str]) -> DataFrame:
    """Edges child -> parent within a chain, over all its rows.

    ``rows`` has the chain columns, id, created_at, checkpoint_id and parent_checkpoint_id. Of several
    rows with one checkpoint id the newest is the parent; a row is never its own.
    """
    chain = list(chain)
    owners = (
        rows.filter(F.col("checkpoint_id") != "")
        .groupBy(*chain, "checkpoint_id")
        .agg(F.max(F.struct("created_at", "id")).alias("o"))
        .select(*chain, F.col("checkpoint_id").alias("parent_checkpoint_id"), F.col("o.id").alias("parent_id"))
    )
    children = rows.filter(F.col("parent_checkpoint_id") != "")
    return children.join(owners, [*chain, "parent_checkpoint_id"]).filter(F.col("parent_id") != F.col("id")).select(*chain, "id", "parent_id")


def key_identity(requests: DataFrame, keys: DataFrame, token_hash: str = "token_hash") -> DataFrame:
    """Key, tenant, role and permissions behind a request's token; NULL for revoked or unknown keys.

    An equi join: AQE broadcasts a small key table and otherwise splits a hot token.
    """
    active = keys.filter(F.col("revoked_at").isNull()).select(
        F.col("token_hash").alias(token_hash),
        F.col("id").alias("key_id"),
        F.col("org_id").alias("key_org_id"),
        F.col("workspace_id").alias("key_workspace_id"),
        F.col("role").alias("key_role"),
        *[F.col(c).alias("key_permissions") for c in keys.columns if c == "permissions"],
    )
    return requests.join(active, token_hash, "left")


@dataclass(frozen=True)
class PolicyRule:
    policy_id: str
    mode: str
    org_id: str = ""
    workspace_id: str = ""
    key_id: str = ""
    provider: str = ""
    route_prefix: str = ""

    def selectors(self) -> int:
        return sum(bool(v.strip()) for v in (self.org_id, self.workspace_id, self.key_id, self.provider, self.route_prefix))


def policy_columns(rules: Sequence[PolicyRule], fallback: PolicyRule, org: Column, workspace: Column, key: Column, provider: Column, path: Column) -> dict[str, Column]:
    """Mode and id of the policy that applies.

    All given selectors of a rule must match. How specific a rule is does not depend on the row:
    more selectors first, then the longer prefix, then list order. So the sorted rules are one CASE.
    """
    for rule in rules:
        if not rule.selectors():
            raise ValueError(f"policy {rule.policy_id} selects nothing")
    ranked = sorted(rules, key=lambda r: (-r.selectors(), -len(clean_prefix(r.route_prefix) if r.route_prefix.strip() else "")))
    mode, policy = F.lit(fallback.mode), F.lit(fallback.policy_id)
    for rule in reversed(ranked):
        fits = F.lit(True)
        for value, col in ((rule.org_id, org), (rule.workspace_id, workspace), (rule.key_id, key), (rule.provider, provider)):
            if value.strip():
                fits = fits & (col == value.strip())
        if rule.route_prefix.strip():
            fits = fits & under_prefix(path, rule.route_prefix)
        mode = F.when(fits, F.lit(rule.mode)).otherwise(mode)
        policy = F.when(fits, F.lit(rule.policy_id)).otherwise(policy)
    return {"pii_mode": mode, "pii_policy_id": policy}


SELECTORS = ("org_id", "workspace_id", "key_id", "provider")


def _ancestors(path: Column) -> Column:
    """The prefixes of a path that end at a slash or at its end; none of a missing path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _each(prefixes: Column, chosen: list[Column]) -> Column:
    return F.transform(prefixes, lambda p: F.to_json(F.struct(*chosen, p.alias("prefix"))))


def policy_join(requests: DataFrame, rules: DataFrame, fallback: PolicyRule, key_column: str = "access_key_id", path_column: str = "request_path") -> DataFrame:
    """Table form of :func:`policy_columns`, for rule lists of any length: adds pii_mode and pii_policy_id.

    ``rules``: pos, policy_id, mode, org_id, workspace_id, key_id, provider, route_prefix (blank or NULL: not named); ``requests`` has org_id,
    workspace_id, provider and the two columns named here. Rules fall into at most 32 classes by the selectors they name. A distinct request is
    shown once for each class that occurs (once for each ancestor of its path where the class names a prefix) and meets the rules by
    equality; no request is compared with a rule of other values. Of several fitting rules the more specific one wins, then the smallest pos.
    A prefix of "/" counts as named and fits every path.
    """
    named = [blank_to_null(F.col(c)).alias(c) for c in SELECTORS]
    prefix = F.when(blank_to_null(F.col("route_prefix")).isNotNull(), normalize_prefix(F.col("route_prefix")))
    clean = rules.select("pos", "policy_id", "mode", *named, prefix.alias("_given")).withColumn("prefix", F.nullif("_given", F.lit("/")))
    fields = [*SELECTORS, "prefix"]
    given = [F.col(c).isNotNull().cast("int") for c in (*SELECTORS, "_given")]
    rank = F.struct((-sum(given[1:], given[0])).alias("named"), (-F.coalesce(F.length("_given"), F.lit(0))).alias("length"), "pos")
    # The names of the selectors a rule has are part of its key: absent ones leave no field.
    keyed = clean.select(F.to_json(F.struct(*fields)).alias("_rule"), rank.alias("_rank"), "policy_id", "mode", F.array([F.col(c).isNotNull() for c in fields]).alias("_class"))
    classes = [(tuple(r["_class"]), r["most"]) for r in keyed.groupBy("_class").agg(F.max("_rank.named").alias("most")).collect()]
    if any(most == 0 for _, most in classes):
        raise ValueError("a policy selects nothing")
    best = keyed.groupBy("_rule").agg(F.min_by(F.struct("mode", "policy_id", "_rank"), "_rank").alias("_best"))

    columns = {"org_id": "org_id", "workspace_id": "workspace_id", "key_id": key_column, "provider": "provider", "prefix": path_column}
    asked = requests.select(*[F.col(c).alias(n) for n, c in columns.items()]).distinct()
    shown = []
    for wanted, _ in classes:
        chosen = [F.col(n) for n, w in zip(fields, wanted) if w and n != "prefix"]
        complete = F.lit(True)
        for c in chosen:
            complete = complete & c.isNotNull()
        if wanted[-1]:
            probes = _each(_ancestors(F.col("prefix")), chosen)
        else:
            probes = F.array(F.to_json(F.struct(*chosen)) if chosen else F.lit("{}"))
        shown.append(F.coalesce(F.when(complete, probes), F.array().cast("array<string>")))
    if not shown:
        return requests.withColumns({"pii_mode": F.lit(fallback.mode), "pii_policy_id": F.lit(fallback.policy_id)})
    found = asked.withColumn("_rule", F.explode(F.concat(*shown))).join(best, "_rule").groupBy(*fields).agg(F.min_by("_best", "_best._rank").alias("_best"))
    on = None
    for name, column in columns.items():
        same = F.col(f"r.{column}").eqNullSafe(F.col(f"f.{name}"))
        on = same if on is None else on & same
    mode, policy = F.coalesce("f._best.mode", F.lit(fallback.mode)), F.coalesce("f._best.policy_id", F.lit(fallback.policy_id))
    return requests.alias("r").join(found.alias("f"), on, "left").select("r.*", mode.alias("pii_mode"), policy.alias("pii_policy_id"))


def correlate(traces: DataFrame, logs: DataFrame) -> DataFrame:
    """Log lines beside the trace with the same correlation id."""
    marked = traces.withColumn("correlation_id", blank_to_null(meta_string(F.col("metadata"), "correlation_id")))
    return marked.filter(F.col("correlation_id").isNotNull()).join(logs, "correlation_id")
