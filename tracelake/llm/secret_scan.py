"""Secrets in whole texts, judged by how many repositories and owners share them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.session import persist_table

#: Kinds in the order in which they are listed. The last is the method's own: tokens only one owner has.
KINDS = ("assign", "access", "hex", "owned")
_SPAN = "struct<start:bigint,end:bigint,kind:int,key:binary,lively:boolean>"
_FOUND = f"doc_id bigint, repo string, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base string, spans array<{_SPAN}>, row bigint"

#: The patterns of the base spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs that may be keys without a name in front, at least 20 characters long, with letters and digits.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"


def lively(value: str) -> bool:
    """Whether a value looks made by a machine: letters and digits, 3 bits of entropy for each character at least."""
    from math import log2

    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * log2(k / n) for k in (value.count(c) for c in set(value))) >= 3.0


def find(docs: DataFrame, repo: Column, owner: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Candidates of each whole text, columns as in ``_FOUND``; positions count code points. A missing text is empty."""

    def scan(batches):
        import re
        from hashlib import sha256

        import pyarrow as pa
        import pyarrow.compute as pc

        assign, access, hexes, token = (re.compile(p, re.ASCII) for p in (ASSIGN, ACCESS, r"[0-9a-f]{24,}", TOKEN))
        # Texts without a trace of a kind are left out by a linear scan over the whole column. It may keep too many, never too few.
        traces = (r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]""", "AKIA", "[0-9a-f]{24}", r"[A-Za-z0-9+/_-]{20}")
        digest = lambda value: sha256(value.encode()).digest()[:16]
        schema = pa.schema(
            [("doc_id", pa.int64()), ("repo", pa.string()), ("owner", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.string())]
            + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("key", pa.binary()), ("lively", pa.bool_())]))), ("row", pa.int64())]
        )
        nothing = sha256(b"").hexdigest()
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            kept = [pc.match_substring_regex(column, p).to_pylist() for p in traces]
            ids, repos, owners, places = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            rows = []
            for i, (has_assign, has_access, has_hex, has_token) in enumerate(zip(*kept)):
                if not (has_assign or has_access or has_hex or has_token):
                    rows.append((ids[i], repos[i], owners[i], 0, 0, 0, nothing, "", [], places[i]))
                    continue
                whole, spans = column[i].as_py(), []
                if has_assign:
                    spans += [(m.start(), m.end(), 0, m[2]) for m in assign.finditer(whole) if len(m[2]) >= 6]
                if has_access:
                    spans += [(m.start(), m.end(), 1, m[0]) for m in access.finditer(whole) if len(m[0]) >= 20]
                if has_hex:
                    spans += [(m.start(), m.end(), 2, m[0]) for m in hexes.finditer(whole)]
                spans.sort()
                counts = [sum(s[2] == k for s in spans) for k in range(3)]
                base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in spans)
                own = []
                if has_token:
                    covered, at, upto = spans, 0, 0
                    for m in token.finditer(whole):
                        while at < len(covered) and covered[at][0] < m.end():
                            upto, at = max(upto, covered[at][1]), at + 1
                        if upto <= m.start() and lively(m[0]):
                            own.append((m.start(), m.end(), 3, m[0]))
                found = [{"start": a, "end": b, "kind": k, "key": digest(v), "lively": k == 1 or lively(v)} for a, b, k, v in spans + own]
                rows.append((ids[i], repos[i], owners[i], *counts, sha256(base.encode()).hexdigest(), base, found, places[i]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 10, schema)], schema=schema)

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), F.monotonically_increasing_id().alias("row"))
    return slim.mapInArrow(scan, _FOUND)


def ownership(candidates: DataFrame) -> DataFrame:
    """``key, n_docs, n_repos, n_owners``: in how many documents, repositories and owners' hands a candidate is found.

    Counted in two steps, by key, repository and owner first, so that a key on a third of all rows is one row per task and repository.
    A missing repository or owner is one of its own.
    """
    named = candidates.groupBy("key", "repo", "owner").agg(F.count(F.lit(1)).alias("_n"))
    repos = F.count_distinct(F.coalesce(F.concat(F.lit("+"), "repo"), F.lit("-")))
    owners = F.count_distinct(F.coalesce(F.concat(F.lit("+"), "owner"), F.lit("-")))
    return named.groupBy("key").agg(F.sum("_n").alias("n_docs"), repos.alias("n_repos"), owners.alias("n_owners"))


def scan_secrets(docs: DataFrame, repo: Column, owner: Column, shared_by: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: counts and spans, and how its candidates are judged.

    ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_examples, n_live``. A candidate whose value (by hash) at least
    ``shared_by`` owners have is a widely copied example (``n_examples``); one that fewer have and that looks made by a machine is
    a live credential (``n_live``). Base spans stay in either case; the method adds as ``owned`` those unnamed tokens that look
    live and that one owner alone has. Missing texts are empty and have no spans; repeated rows are judged alike; an empty
    table gives no row.
    """
    found = persist_table(find(docs, repo, owner, text, doc_id), "secrets")
    each = found.filter(F.size("spans") > 0).select("row", "repo", "owner", F.explode("spans").alias("s")).select("row", "repo", "owner", "s.*")
    judged = each.join(ownership(each), "key").withColumn("_example", F.col("n_owners") >= shared_by)
    live = ~F.col("_example") & F.col("lively")
    owned = (F.col("kind") == 3) & (F.col("n_owners") == 1) & F.col("lively")
    named = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.when((F.col("kind") < 3) | owned, F.struct("start", "kind", F.concat_ws(":", named, "start", "end").alias("said")))
    verdicts = judged.groupBy("row").agg(
        F.count_if(F.col("_example") & (F.col("kind") < 3)).alias("n_examples"),
        F.count_if(live & ((F.col("kind") < 3) | owned)).alias("n_live"),
        F.array_sort(F.collect_list(span)).alias("_spans"),
    )
    said = F.array_join(F.transform("_spans", lambda s: s["said"]), ",")
    zero = F.lit(0).cast("long")
    return found.join(verdicts, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(said, F.lit("")).alias("spans"), F.coalesce("n_examples", zero).alias("n_examples"), F.coalesce("n_live", zero).alias("n_live")
    )
