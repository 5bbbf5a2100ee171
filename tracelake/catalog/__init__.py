"""Registered queries, one per operator, each with the SQL that checks it where SQL can."""

from tracelake.catalog import (  # noqa: F401
    analytics,
    audit,
    enrich,
    filters,
    joins,
    limits,
    lineage,
    listing,
    privacy,
    store,
    streams,
    versions,
)
