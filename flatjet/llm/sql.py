"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS t(p)),
first AS (SELECT k, min(row(doc_id, p)) AS f FROM win GROUP BY k),
dup AS (SELECT doc_id, p FROM win JOIN first USING (k) WHERE row(doc_id, p) > f),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM dup, unnest(range(p, p + 20)) AS t(q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(qs, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
"""

OP6 = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(m.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(m.m, e.vec_id)) AS kept
FROM embeddings e
LEFT JOIN (SELECT u, count(*) AS n FROM link GROUP BY u) n ON n.u = e.vec_id
LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) m ON m.u = e.vec_id
"""

OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT u, v FROM common JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 75 * (nu.n + nv.n - c)),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) m ON m.u = d.doc_id
"""

_HOST = r"translate(regexp_extract({url}, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract({url}, '(?s)\A.*?://[^/?#]*([^?#]*)', 1)"


def op9(rules: list[tuple[str, str, str]]) -> str:
    """Rules as rows; aliases over the declared links of the pages."""
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    host, path = _HOST.format(url="url"), _PATH.format(url="url")
    node = lambda url: _HOST.format(url=url) + r" || regexp_extract({0}, '(?s)\A.*?://[^/?#]*([^#]*)', 1)".format(url)
    return rf"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {rows}) AS t(verdict, host, path)),
page AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
tag AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM page),
target AS (
  SELECT url, regexp_extract(tag, '(?i)\b(?:href\s*=\s*["'']?|url\s*=\s*["'']?)([^"''\s>;]+)', 1) AS target FROM tag
  WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') OR regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')),
whole AS (
  SELECT url, CASE WHEN contains(target, '://') THEN target
    WHEN starts_with(target, '//') THEN split_part(url, '://', 1) || ':' || target
    WHEN starts_with(target, '/') THEN split_part(url, '://', 1) || '://' || {host} || target END AS target
  FROM target WHERE target <> ''),
edge AS (SELECT {node("url")} AS u, {node("target")} AS v FROM whole WHERE target IS NOT NULL),
link AS (SELECT u, v FROM edge WHERE u <> '' AND v <> '' AND u <> v UNION SELECT v, u FROM edge WHERE u <> '' AND v <> '' AND u <> v),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
url AS (SELECT url FROM page UNION SELECT 'x://' || u FROM link),
ruled AS (
  SELECT url, arg_max(r.host || r.path, len(r.host || r.path)) AS rule, arg_max(r.verdict, len(r.host || r.path)) AS verdict
  FROM url JOIN rules r ON ({host} = r.host OR ends_with({host}, '.' || r.host)) AND starts_with({path}, r.path) GROUP BY url),
part AS (
  SELECT x.u, min(x.v) AS alias, bool_or(r.verdict = 'block') AS blocked, bool_or(r.verdict = 'allow') AS allowed
  FROM reach x LEFT JOIN ruled r ON r.url = 'x://' || x.v GROUP BY x.u)
SELECT page_id, {_HOST.format(url="page.url")} AS host, {_PATH.format(url="page.url")} AS path, ruled.rule AS rule,
  coalesce(ruled.verdict, CASE WHEN coalesce(blocked, false) AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict, alias
FROM page LEFT JOIN ruled ON ruled.url = page.url
LEFT JOIN part ON part.u = ({node("page.url")})
"""
