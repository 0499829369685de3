"""SQL of the queries that SQL can express."""

from __future__ import annotations

_BLANK = "[\\s\\p{Z}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]"

_P1 = f"""
WITH m AS (SELECT DISTINCT id, conversation_id, ordinal, role, raw_text FROM messages WHERE conversation_id IS NOT NULL),
r AS (SELECT conversation_id, ordinal,
  CASE WHEN lower(regexp_replace(role, '^{_BLANK}+|{_BLANK}+$', '', 'g')) IN ('user', 'human') THEN 'user'
       WHEN lower(regexp_replace(role, '^{_BLANK}+|{_BLANK}+$', '', 'g')) IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant'
       WHEN lower(regexp_replace(role, '^{_BLANK}+|{_BLANK}+$', '', 'g')) IN ('system', 'tool') THEN 'other' END AS role,
  NOT (raw_text IS NULL OR regexp_full_match(raw_text, '{_BLANK}*')) AS filled FROM m),
s AS (SELECT *, lead(role) OVER (PARTITION BY conversation_id ORDER BY ordinal) AS nxt FROM r WHERE filled AND role IN ('user', 'assistant')),
a AS (SELECT conversation_id, bool_or(role = 'user') AS has_user, bool_or(role = 'user' AND coalesce(nxt, 'user') = 'user') AS open FROM s GROUP BY 1),
c AS (SELECT conversation_id, count(*) AS n, count(DISTINCT ordinal) AS k, min(ordinal) AS lo, max(ordinal) AS hi, bool_or(role IS NULL) AS odd, bool_or(ordinal IS NULL) AS gap FROM r GROUP BY 1),
good AS (SELECT c.conversation_id FROM c JOIN a USING (conversation_id) WHERE NOT odd AND NOT gap AND lo = 1 AND hi = n AND k = n AND has_user AND NOT open)
"""
P1 = _P1 + "SELECT DISTINCT id AS conversation_id FROM conversations WHERE id IS NOT NULL AND id NOT IN (SELECT conversation_id FROM good)"
P1_TURNS = _P1.replace(" AS filled FROM m)", " AS filled, raw_text FROM m)") + "SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal) AS turn, ordinal, role, raw_text AS text FROM r JOIN good USING (conversation_id) WHERE filled AND role IN ('user', 'assistant')"

_USABLE = "CASE WHEN isfinite({0}) THEN {0} END"
_SCORES = f"""
WITH s AS (SELECT probe_id, chunk_id, max({_USABLE.format("dense_score")}) AS d, max({_USABLE.format("sparse_score")}) AS p FROM snapshot_rows GROUP BY ALL),
h AS (SELECT probe_id, chunk_id, max({_USABLE.format("final_score")}) AS f FROM native_retrieval_hits GROUP BY ALL),
j AS (SELECT s.*, h.f, count(*) OVER (PARTITION BY probe_id) AS n FROM s LEFT JOIN h USING (probe_id, chunk_id) WHERE probe_id IS NOT NULL AND chunk_id IS NOT NULL),
r AS (SELECT probe_id, chunk_id, n,
"""


def _rank(c: str, none: str) -> str:
    place = f"(rank() OVER (PARTITION BY probe_id ORDER BY {c} DESC NULLS LAST) + (count(*) OVER (PARTITION BY probe_id, {c}) - 1) / 2.0)"
    return f"CASE WHEN {c} IS NULL THEN {none} ELSE n - {place} END"


P2_FOUND = _SCORES + " + ".join(_rank(c, "0") for c in "dpf") + """ AS points FROM j WHERE n >= 30)
SELECT probe_id, chunk_id FROM r QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY points DESC, chunk_id) = 1"""
P2_POINTS = _SCORES + " + ".join(_rank(c, "n - (n + 1) / 2.0") for c in "dpf") + """ AS points FROM j)
SELECT probe_id, chunk_id, CAST(points AS DOUBLE) AS points, CAST(n AS BIGINT) AS n FROM r"""


def _pairs(tab: str, col: str, p: str) -> str:
    return f"""{p}w AS (SELECT id, regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT DISTINCT id, {col} FROM {tab} WHERE {col} IS NOT NULL AND id IS NOT NULL)),
{p}s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM {p}w, range(1, len(w) - 1) t(i) WHERE len(w) >= 40),
{p}n AS (SELECT id, count(*) AS n FROM {p}s GROUP BY 1),
{p}p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM {p}s a JOIN {p}s b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
{p} AS (SELECT id_a, id_b, k = x.n AND k = y.n AS same FROM {p}p JOIN {p}n x ON x.id = id_a JOIN {p}n y ON y.id = id_b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9)"""


P3 = f"WITH {_pairs('messages', 'raw_text', 'm')},\n{_pairs('retrieval_chunks', 'text', 'c')}\nSELECT id_a, id_b FROM m UNION SELECT id_a, id_b FROM c"
P3_CLASSES = f"""WITH RECURSIVE {_pairs('messages', 'raw_text', 'm')},\n{_pairs('retrieval_chunks', 'text', 'c')},
n AS (SELECT 'messages' AS kind, id FROM mn UNION ALL SELECT 'retrieval_chunks', id FROM cn),
p AS (SELECT 'messages' AS kind, * FROM m UNION ALL SELECT 'retrieval_chunks', * FROM c), e AS (SELECT kind, id_a AS a, id_b AS b, same FROM p UNION ALL SELECT kind, id_b, id_a, same FROM p),
t AS (SELECT kind, id, id AS root FROM n UNION SELECT e.kind, e.b, t.root FROM t JOIN e ON e.kind = t.kind AND e.a = t.id),
g AS (SELECT kind, id, min(root) AS class FROM t GROUP BY 1, 2), r AS (SELECT n.kind, n.id, least(n.id, min(e.b)) AS rep FROM n LEFT JOIN e ON e.kind = n.kind AND e.a = n.id AND e.same GROUP BY 1, 2),
l AS (SELECT e.kind, e.a AS id, count(DISTINCT r.rep) AS links FROM e JOIN r ON r.kind = e.kind AND r.id = e.b WHERE NOT e.same GROUP BY 1, 2)
SELECT g.kind, g.id, g.class, coalesce(l.links, 0) AS links FROM g LEFT JOIN l ON l.kind = g.kind AND l.id = g.id"""

P4 = """
WITH v AS (SELECT embedding_space_id AS s, chunk_id, CAST(arg_min(vector, rowid) AS DOUBLE[]) AS x FROM dense_native_metadata
  WHERE vector IS NOT NULL AND len(vector) = dim AND dim > 0 AND list_bool_and(list_transform(vector, lambda e: coalesce(isfinite(e), false))) AND list_bool_or(list_transform(vector, lambda e: e <> 0)) GROUP BY ALL),
p AS (SELECT a.s, a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.s = b.s AND a.chunk_id <> b.chunk_id),
k AS (SELECT a, b, c FROM p QUALIFY row_number() OVER (PARTITION BY s, a ORDER BY round(c, 6) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM k WHERE c >= 0.9
"""

P7 = """
WITH h AS (SELECT probe_id, chunk_id, max(final_score) AS s FROM native_retrieval_hits WHERE isfinite(final_score) AND probe_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL)
SELECT probe_id, chunk_id FROM h QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY s DESC, chunk_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p1_conversations": P1_TURNS, "p2_found": P2_FOUND, "p2_points": P2_POINTS, "p3_found": P3, "p3_classes": P3_CLASSES, "p4_found": P4, "p7_found": P7}
