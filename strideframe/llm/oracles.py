"""SQL twins of the training-data queries, for DuckDB."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({fold('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS key FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 2))) AS k) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
c AS (SELECT DISTINCT doc_id, doc_id AS r FROM d UNION SELECT e.y, c.r FROM c JOIN e ON e.x = c.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id) m USING (doc_id)
"""

_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OP8_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({fold('text')}, '{_WORDS}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({fold('text')}, '{_WORDS}') AS w FROM benchmark),
i AS MATERIALIZED (
  SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS key FROM (SELECT item, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS k)
), z AS (SELECT DISTINCT size FROM i),
h AS MATERIALIZED (
  SELECT r, k, size, item FROM (SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS key FROM d, z, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - size + 2))) AS k) WHERE len(w) >= size) JOIN i USING (size, key)
), q AS (SELECT r, count(DISTINCT p) AS n_hit FROM h, LATERAL (SELECT unnest(range(k, k + size)) AS p) GROUP BY r),
f AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN q USING (r) LEFT JOIN f USING (r)
"""


def op1_sql(rules: list[tuple[str, str, str]], depth: int = 6, least: int = 20, z: float = 2.6, prior: float = 4.0, reject: float = 0.5) -> str:
    """The template tree level by level."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h + p}'" for f, (h, p, _) in zip(fits, ordered, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (*_, v) in zip(fits, ordered, strict=True)) + " END"
    hexes = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\\b[0-9a-f]{16,}\\b"
    out = f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), v AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), b AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
w AS (
  SELECT page_id, host, path, bad AS label, string_split(regexp_replace(regexp_replace(regexp_replace(path, '{hexes}', '%', 'g'), '^/', ''), '[0-9]+', '#', 'g'), '/') AS parts
  FROM v LEFT JOIN b ON b.doc_id = try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})(?:[/.]|$)', 1), '') AS BIGINT)
), r AS MATERIALIZED (SELECT * EXCLUDE parts, CASE WHEN len(parts) > {depth} THEN parts[1:{depth}] || ['**'] ELSE parts END AS form FROM w),
forms AS MATERIALIZED (SELECT host, form, count(*) AS n, count(label) AS labelled, coalesce(sum(label), 0)::BIGINT AS bad FROM r GROUP BY ALL),
t0 AS MATERIALIZED (SELECT *, CAST([] AS VARCHAR[]) AS template FROM forms)"""
    for k in range(depth + 1):
        out += f""",
h{k} AS MATERIALIZED (SELECT *, array_to_string(template, '/') AS branch, form[{k + 1}] AS segment FROM t{k}),
b{k} AS MATERIALIZED (SELECT host, branch, segment, sum(n) AS n, sum(labelled)::DOUBLE AS labelled, sum(bad)::DOUBLE AS bad FROM h{k} WHERE segment IS NOT NULL GROUP BY ALL),
o{k} AS (
  SELECT a.host, a.branch, a.segment, a.n, a.labelled, a.bad, coalesce(sum(b.labelled), 0)::DOUBLE AS others, coalesce(sum(b.bad), 0)::DOUBLE AS others_bad
  FROM b{k} a LEFT JOIN b{k} b ON a.host = b.host AND a.branch = b.branch AND a.segment <> b.segment GROUP BY ALL
), g{k} AS (SELECT *, (bad + others_bad + 1) / (labelled + others + 2) AS share FROM o{k}),
j{k} AS MATERIALIZED (
  SELECT host, branch, segment, n, CASE WHEN labelled > 0 AND others > 0 AND abs(bad / labelled - others_bad / others) > {z}::DOUBLE * sqrt(share * (1 - share) * (1 / labelled + 1 / others))
    THEN sign(bad / labelled - others_bad / others)::INT ELSE 0 END AS side FROM g{k}
), n{k} AS (
  SELECT host, branch, segment, CASE WHEN (n >= {least} AND side <> 0) OR count(*) FILTER (n < {least} OR side = 0) OVER (PARTITION BY host, branch, side) = 1
    THEN regexp_replace(segment, '^[*]', '%2A') ELSE CASE side WHEN 0 THEN '*' WHEN 1 THEN '*+' ELSE '*-' END END AS name FROM j{k}
),
t{k + 1} AS MATERIALIZED (SELECT h.host, form, n, labelled, bad, CASE WHEN h.segment IS NULL THEN template ELSE template || [name] END AS template FROM h{k} h LEFT JOIN n{k} x ON h.host = x.host AND h.branch = x.branch AND h.segment = x.segment)"""
    return (
        out
        + f""",
tree AS (SELECT host, form, labelled, bad, '/' || array_to_string(template, '/') AS template FROM t{depth + 1}),
total AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0.0)::DOUBLE AS share FROM forms),
hosts AS (SELECT host, (sum(bad) + {prior}::DOUBLE * any_value(share)) / (sum(labelled) + {prior}::DOUBLE) AS host_share FROM forms, total GROUP BY host),
shares AS (SELECT host, template, (sum(bad) + {prior}::DOUBLE * any_value(host_share)) / (sum(labelled) + {prior}::DOUBLE) AS bad_share FROM tree JOIN hosts USING (host) GROUP BY host, template)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN bad_share >= {reject} THEN 'block' ELSE 'allow' END) AS verdict, template, round(bad_share, 9) AS bad_share
FROM r JOIN (SELECT host, form, template FROM tree) USING (host, form) JOIN shares USING (host, template)
"""
    )
