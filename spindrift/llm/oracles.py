"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from spindrift.llm import secrets

_COMPONENTS = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(b) m FROM reach GROUP BY a)"""

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), {_COMPONENTS}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.a = w.doc_id"""

OP4 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98), {_COMPONENTS},
deg AS (SELECT a, count(*) k FROM links GROUP BY 1)
SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN deg ON deg.a = vec_id LEFT JOIN comp ON comp.a = vec_id"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(kind: int, pattern: str, value: str = "hit", where: str = "TRUE") -> str:
    p = _quoted(pattern)
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    return f"""SELECT doc_id, source, {kind} AS k, a, CAST(a + length(hit) AS BIGINT) AS b, {value.replace('PATTERN', p)} AS v FROM (SELECT doc_id, source, h[i] AS hit,
 CAST({size.format('p[1:i]')} + {size.format('h[1:i-1]')} AS BIGINT) AS a FROM (SELECT doc_id, source, p, h, unnest(range(1, len(h) + 1)) i
 FROM (SELECT doc_id, source, string_split_regex(text, {p}) p, regexp_extract_all(text, {p}) h FROM documents))) WHERE {where.replace('PATTERN', p)}"""


_LOOKS = f"len(list_distinct(string_split(hit, ''))) >= {secrets.DISTINCT_CHARS} AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')"
_NAME = "CASE k " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(secrets.KINDS)) + " END || ':' || a || ':' || b"

OP9 = f"""
WITH s AS ({_spans(0, secrets.ASSIGN, "regexp_extract(hit, PATTERN, 2)", "length(regexp_extract(hit, PATTERN, 2)) >= 6")} UNION ALL {_spans(1, secrets.ACCESS)} UNION ALL {_spans(2, secrets.HEX)} UNION ALL {_spans(3, secrets.WIDE, where=_LOOKS)}),
own AS (SELECT v, count(DISTINCT coalesce(source, '')) owners, count(DISTINCT doc_id) repositories FROM s GROUP BY 1),
j AS (SELECT s.*, owners <= {secrets.EXAMPLE_OWNERS} AND repositories <= {secrets.EXAMPLE_REPOSITORIES} AS live FROM s JOIN own USING (v)),
u AS (SELECT * FROM j WHERE k < 3 OR live AND NOT EXISTS (SELECT 1 FROM j x WHERE x.doc_id = j.doc_id AND x.k < 3 AND x.a < j.b AND j.a < x.b)),
d AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) n_assign, count(*) FILTER (WHERE k = 1) n_access, count(*) FILTER (WHERE k = 2) n_hex,
 string_agg({_NAME}, ',' ORDER BY a, k) FILTER (WHERE k < 3) base, string_agg({_NAME}, ',' ORDER BY a, k) spans FROM u GROUP BY doc_id),
l AS (SELECT doc_id, count(*) FILTER (WHERE live) n_live FROM u GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id LEFT JOIN l ON l.doc_id = documents.doc_id"""
