"""SQL that gives the queries' rows where SQL can."""

MIXING = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source
), o AS (  -- sources by the share at which they reach three times their size
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / k, source) AS place FROM s
), c AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
    sum(k) OVER () - coalesce(sum(k) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS share_left FROM o
), f AS (SELECT arg_min(words_left, place) AS words_left, arg_min(share_left, place) AS share_left FROM c WHERE NOT 3 * source_size * share_left < k * words_left
), t AS (
  SELECT source, source_size, CASE WHEN 3 * source_size * f.share_left < k * f.words_left THEN (3 * source_size)::DOUBLE ELSE (k * f.words_left)::DOUBLE / f.share_left::DOUBLE END AS target FROM s, f
), g AS (SELECT source, length(bin(size)) AS class, sum(size)::BIGINT AS words FROM d GROUP BY ALL
), h AS (
  SELECT g.*, target, coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
    (sum(class * words) OVER (PARTITION BY g.source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source
), i AS (SELECT *, CASE WHEN rest > 0 THEN (target - 3 * above) / rest END AS f FROM h
), j AS (SELECT source, coalesce(arg_max(f, class) FILTER (WHERE f * class <= 3), 3.0) AS f FROM i GROUP BY source
), e AS (
  SELECT i.source, class, words, target, floor(least(3.0, greatest(0.0, j.f * class))) AS whole, least(3.0, greatest(0.0, j.f * class)) - floor(least(3.0, greatest(0.0, j.f * class))) AS p
  FROM i JOIN j ON i.source IS NOT DISTINCT FROM j.source
), l AS (SELECT *, target - (sum(whole::BIGINT * words) OVER (PARTITION BY source))::BIGINT AS words_left FROM e
), u AS (
  SELECT d.*, whole::BIGINT AS whole, words_left, p, ((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source AND length(bin(d.size)) = l.class
), r AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pareto, n ROWS UNBOUNDED PRECEDING) <= words_left AS chosen
  FROM (SELECT *, (u / (1 - u)) * ((1 - p) / p) AS pareto FROM u WHERE p > 0 AND size > 0)
), x0 AS (SELECT source, any_value(words_left) - coalesce(sum(size) FILTER (WHERE chosen), 0)::BIGINT AS gap FROM r GROUP BY source
), y AS (SELECT r.source, n, size, pareto FROM r JOIN x0 ON r.source IS NOT DISTINCT FROM x0.source WHERE NOT chosen AND size < 2 * gap
), f1 AS (SELECT y.source, min({'off': abs(gap - size), 'pareto': pareto, 'n': n}) AS f FROM y JOIN x0 ON y.source IS NOT DISTINCT FROM x0.source WHERE size <= gap GROUP BY y.source
), f2 AS (
  SELECT y.source, min({'off': abs(f1.f.off - size), 'pareto': pareto, 'n': n}) AS f FROM y JOIN f1 ON y.source IS NOT DISTINCT FROM f1.source
  WHERE size <= f1.f.off AND n <> f1.f.n GROUP BY y.source
), f3 AS (
  SELECT y.source, min({'off': abs(f2.f.off - size), 'pareto': pareto, 'n': y.n}) AS f FROM y JOIN f1 ON y.source IS NOT DISTINCT FROM f1.source JOIN f2 ON y.source IS NOT DISTINCT FROM f2.source
  WHERE size <= f2.f.off AND y.n NOT IN (f1.f.n, f2.f.n) GROUP BY y.source
), f4 AS (
  SELECT y.source, min({'off': abs(f3.f.off - size), 'pareto': pareto, 'n': y.n}) AS f
  FROM y JOIN f1 ON y.source IS NOT DISTINCT FROM f1.source JOIN f2 ON y.source IS NOT DISTINCT FROM f2.source JOIN f3 ON y.source IS NOT DISTINCT FROM f3.source
  WHERE abs(f3.f.off - size) < f3.f.off AND y.n NOT IN (f1.f.n, f2.f.n, f3.f.n) GROUP BY y.source
), z AS (SELECT n FROM r WHERE chosen UNION SELECT f.n FROM f1 UNION SELECT f.n FROM f2 UNION SELECT f.n FROM f3 UNION SELECT f.n FROM f4)
SELECT u.doc_id, u.size, t.source_size, t.target, u.size * (u.whole + (z.n IS NOT NULL)::BIGINT) AS taken, u.whole + (z.n IS NOT NULL)::BIGINT AS copies
FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source LEFT JOIN z ON u.n = z.n
"""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w
), e AS (SELECT doc_id, len(g) AS size, unnest(g) AS x FROM g
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.size) AS m, any_value(b.size) AS n, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (m + n - common)
), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reached AS (SELECT doc_id, doc_id AS other FROM g UNION SELECT reached.doc_id, both_ways.b FROM reached JOIN both_ways ON reached.other = both_ways.a
), named AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT g.doc_id, len(g)::BIGINT AS n_shingles, component_id, g.doc_id = component_id AS kept FROM g JOIN named ON g.doc_id = named.doc_id
"""

NEAREST = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""

HARD_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _manifest(levels: int = 7, top: int = 3) -> str:
    """Level by level, for trees of at most ``8 ** levels`` leaves and ``8 ** top`` languages; a tree that ends earlier has no rows on later levels."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf, changed = (f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', 'n_chars', t))})" for t in ("text", lower))
    crc = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: [ascii((doc_id::VARCHAR)[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"""
    parts = [
        f"d AS MATERIALIZED (SELECT doc_id, coalesce('+' || lang, '') AS tree, {leaf} AS h, CASE WHEN {crc} % 3 = 0 THEN {changed} END AS changed FROM documents)",
        "a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d)",
    ]

    def up(name: str, count: int) -> None:
        run = "PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN"
        for i in range(count):
            parts.append(f"{name}{i + 1} AS MATERIALIZED (SELECT tree, pos // 8 AS pos, any_value((n + 7) // 8) AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{i} WHERE n > 1 GROUP BY tree, pos // 8)")
            parts.append(
                f"s{name}{i} AS MATERIALIZED (SELECT tree, pos, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
                f" coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i} WHERE n > 1)"
            )
        parts.append(f"r{name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT tree, h FROM {name}{i} WHERE n = 1" for i in range(count + 1)) + ")")

    def fold(start: str, name: str, count: int) -> str:
        for i in range(count):
            now = f"f{name}{i}"
            parts.append(
                f"{now} AS MATERIALIZED (SELECT f.* EXCLUDE (pos, node, proof), f.pos // 8 AS pos, CASE WHEN s.l IS NULL THEN node ELSE sha256(s.l || node || s.r) END AS node,"
                f" proof || coalesce(s.l || s.r, '') AS proof FROM {start} f LEFT JOIN s{name}{i} s ON f.{'tree' if name == 'a' else 'all_trees'} = s.tree AND f.pos = s.pos)"
            )
            start = now
        return start

    up("a", levels)
    parts.append("b0 AS MATERIALIZED (SELECT '' AS tree, tree AS own, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h FROM ra)")
    up("b", top)
    parts.append("g AS MATERIALIZED (SELECT doc_id, tree, h AS leaf, pos, coalesce(changed, h) AS node, '' AS proof FROM a0)")
    last = fold("g", "a", levels)
    parts.append(f"g2 AS MATERIALIZED (SELECT f.doc_id, f.leaf, b0.h AS subroot, '' AS all_trees, b0.pos, node, proof FROM {last} f JOIN b0 ON f.tree = b0.own)")
    last = fold("g2", "b", top)
    out = f"SELECT f.doc_id, leaf, subroot, rb.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = rb.h AS verified FROM {last} f, rb"
    return "WITH " + ",\n".join(parts) + "\n" + out


MANIFEST = _manifest()
