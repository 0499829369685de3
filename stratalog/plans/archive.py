"""Queries of audits, joins, groups and the graph over the archive's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, graph, retrieve
from ..sources.tables import table
from .registry import query
from .retrieval import _TERMS, _VECS, chunk_term_lists, chunk_terms, usable_vectors
from .texts import messages

_CH = "(SELECT DISTINCT id, block_id, ordinal, source_char_start, source_char_end, token_count, text FROM retrieval_chunks)"
_MS = "(SELECT DISTINCT id, conversation_id, ordinal, role, message_id, time_utc, raw_text FROM messages)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieval_chunks").select("id", "block_id", "ordinal", "source_char_start", "source_char_end", "token_count", "text").distinct()


@query(f"""SELECT conversation_id, count_if(lower(trim(role)) = 'assistant') AS assistant_messages, count_if(lower(trim(role)) = 'user') AS user_messages, count(*) AS total_messages, CAST(coalesce(sum(length(raw_text)), 0) AS BIGINT) AS text_chars,
 CAST(coalesce(sum(len(regexp_extract_all(raw_text, '```')) // 2), 0) AS BIGINT) AS code_blocks, CAST(coalesce(sum(len(regexp_extract_all(raw_text, 'https?://[^\\s)>"'']+'))), 0) AS BIGINT) AS urls FROM {_MS} WHERE conversation_id IS NOT NULL GROUP BY 1""")
def conversation_metrics(spark: SparkSession, d: str) -> DataFrame:
    t, role = F.col("raw_text"), F.lower(F.trim("role"))
    zero = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n)
    return messages(spark, d).where("conversation_id is not null").groupBy("conversation_id").agg(
        F.count_if(role == "assistant").alias("assistant_messages"), F.count_if(role == "user").alias("user_messages"), F.count("*").alias("total_messages"),
        zero(F.length(t), "text_chars"), zero(T.code_blocks(t), "code_blocks"), zero(T.urls(t), "urls"),
    )


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, count(DISTINCT {k}) AS ids FROM {t}" for t, k in (("conversations", "id"), ("messages", "id"), ("blocks", "id"), ("retrieval_chunks", "id"), ("dense_native_metadata", "rowid"), ("documents", "doc_id"), ("real_probes", "probe_id"))))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, k in (("conversations", "id"), ("messages", "id"), ("blocks", "id"), ("retrieval_chunks", "id"), ("dense_native_metadata", "rowid"), ("documents", "doc_id"), ("real_probes", "probe_id")):
        one = table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("rows"), F.countDistinct(k).alias("ids")).select("table_name", "rows", "ids")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""SELECT 'block without message' AS finding, count(*) AS rows FROM blocks WHERE message_id IS NOT NULL AND message_id NOT IN (SELECT id FROM messages WHERE id IS NOT NULL)
UNION ALL SELECT 'chunk without block', count(*) FROM {_CH} WHERE block_id IS NOT NULL AND block_id NOT IN (SELECT id FROM blocks WHERE id IS NOT NULL)
UNION ALL SELECT 'message without conversation', count(*) FROM {_MS} WHERE conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT id FROM conversations WHERE id IS NOT NULL)
UNION ALL SELECT 'vector without chunk', count(*) FROM (SELECT DISTINCT chunk_id FROM dense_native_metadata WHERE chunk_id IS NOT NULL) WHERE chunk_id NOT IN (SELECT id FROM retrieval_chunks WHERE id IS NOT NULL)""")
def integrity_orphans(spark: SparkSession, d: str) -> DataFrame:
    b, c, m, v = table(spark, d, "blocks"), chunks(spark, d), messages(spark, d), table(spark, d, "dense_native_metadata").select("chunk_id").distinct()
    conv = table(spark, d, "conversations")
    found = [("block without message", audit.orphans(b, m, "message_id", "id")), ("chunk without block", audit.orphans(c, b, "block_id", "id")), ("message without conversation", audit.orphans(m, conv, "conversation_id", "id")), ("vector without chunk", audit.orphans(v, c, "chunk_id", "id"))]
    out = None
    for name, df in found:
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("finding"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT id, count(*) AS rows FROM messages GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicates(table(spark, d, "messages"), ["id"])


@query("""WITH a AS (SELECT DISTINCT chunk_id FROM dense_native_metadata WHERE vector IS NOT NULL), b AS (SELECT DISTINCT id AS chunk_id FROM retrieval_chunks WHERE len(regexp_extract_all(lower(text), '[a-z0-9а-яё_]{2,}')) > 0)
SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN b.chunk_id IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.chunk_id = b.chunk_id WHERE a.chunk_id IS NULL OR b.chunk_id IS NULL""")
def xor_pairs(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.vectors import terms

    dense = table(spark, d, "dense_native_metadata").where("vector is not null")
    sparse = table(spark, d, "retrieval_chunks").where(F.size(terms(F.col("text"))) > 0).withColumnRenamed("id", "chunk_id")
    return audit.one_sided(dense, sparse, "chunk_id")


@query(f"WITH {_VECS}, {_TERMS} SELECT count(*) AS pending, CAST(sum(token_count) AS BIGINT) AS tokens FROM (SELECT id, max(token_count) AS token_count FROM retrieval_chunks GROUP BY 1) WHERE id NOT IN (SELECT chunk_id FROM v WHERE chunk_id IS NOT NULL INTERSECT SELECT chunk_id FROM w)")
def pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).groupBy("id").agg(F.max("token_count").alias("token_count")).withColumnRenamed("id", "chunk_id")
    p = audit.pending(c, usable_vectors(spark, d), chunk_term_lists(spark, d).where(F.size("terms") > 0), "chunk_id")
    return p.agg(F.count("*").alias("pending"), F.sum("token_count").cast("long").alias("tokens"))


@query(f"""WITH c AS (SELECT block_id, source_char_start AS s, source_char_end AS e FROM {_CH}), w AS (SELECT block_id, s, e, max(e) OVER (PARTITION BY block_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c),
k AS (SELECT block_id, CAST(sum(greatest(0, e - greatest(s, coalesce(b, s)))) AS BIGINT) AS covered FROM w GROUP BY 1)
SELECT b.id AS block_id, b.source_char_end - b.source_char_start AS chars, coalesce(k.covered, 0) AS covered, coalesce(k.covered, 0) <> b.source_char_end - b.source_char_start AS gap FROM (SELECT DISTINCT id, source_char_start, source_char_end FROM blocks) b LEFT JOIN k ON k.block_id = b.id""")
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    k = audit.covered(chunks(spark, d), ["block_id"], "source_char_start", "source_char_end")
    b = table(spark, d, "blocks").select(F.col("id").alias("block_id"), (F.col("source_char_end") - F.col("source_char_start")).alias("chars")).distinct()
    out = b.join(k, "block_id", "left").withColumn("covered", F.coalesce(F.col("covered"), F.lit(0)).cast("long"))
    return out.select("block_id", "chars", "covered", (F.col("covered") != F.col("chars")).alias("gap"))


@query(f"""WITH n AS (SELECT b.id, b.block_type, count(c.id) AS n FROM (SELECT DISTINCT id, block_type FROM blocks) b LEFT JOIN {_CH} c ON c.block_id = b.id GROUP BY 1, 2)
SELECT block_type, CASE WHEN n <= 5 THEN CAST(n AS VARCHAR) WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' ELSE '>50' END AS bucket, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS chunks FROM n GROUP BY 1, 2""")
def chunk_distribution(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").select(F.col("id").alias("block_id"), "block_type").distinct()
    n = b.join(chunks(spark, d).groupBy("block_id").agg(F.count("*").alias("n")), "block_id", "left").na.fill(0, ["n"])
    return n.groupBy("block_type", audit.bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("blocks"), F.sum("n").cast("long").alias("chunks"))


@query("SELECT " + ", ".join(f"quantile_cont(token_count, {p / 100}) AS token_count_p{p}" for p in (50, 95, 99)) + ", " + ", ".join(f"quantile_disc(token_count, {p / 100}) AS token_count_near{p}" for p in (50, 95, 99)) + f", count_if(token_count > 64) AS over_limit, max(token_count) AS longest FROM {_CH}")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return c.agg(*audit.spread(F.col("token_count"), "token_count"), F.count_if(F.col("token_count") > 64).alias("over_limit"), F.max("token_count").alias("longest"))


_FP = "sha256(concat_ws(chr(31), coalesce(CAST(id AS VARCHAR), chr(0)), coalesce(title, chr(0)), coalesce(CAST(message_count AS VARCHAR), chr(0))))"


@query("SELECT folder_kind, count(*) AS rows, " + " || '-' || ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {a}, 12) AS UBIGINT) AS HUGEINT)) AS VARCHAR)" for a in (1, 13, 25)) + f" AS fingerprint FROM (SELECT folder_kind, {_FP} AS h FROM conversations) GROUP BY 1")
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return audit.fingerprint(table(spark, d, "conversations"), ["id", "title", "message_count"], ["folder_kind"])


@query(f"""WITH o AS (SELECT id, sha256(coalesce(raw_text, '')) AS h FROM {_MS} WHERE ordinal % 3 <> 0), n AS (SELECT id, sha256(CASE WHEN ordinal % 5 = 0 THEN upper(coalesce(raw_text, '')) ELSE coalesce(raw_text, '') END) AS h FROM {_MS} WHERE ordinal % 3 <> 1)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'absent' WHEN o.id IS NULL THEN 'new' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.id = n.id""")
def revision_diff(spark: SparkSession, d: str) -> DataFrame:
    """Diff of two made-up snapshots of the messages: by ordinal, some rows are missing or rewritten."""
    from ..operators.lineage import compare_revisions

    m, t = messages(spark, d), F.coalesce("raw_text", F.lit(""))
    old = m.where("ordinal % 3 <> 0").select("id", F.sha2(t, 256).alias("revision"))
    new = m.where("ordinal % 3 <> 1").select("id", F.sha2(F.when(F.col("ordinal") % 5 == 0, F.upper(t)).otherwise(t), 256).alias("revision"))
    return compare_revisions(old, new, "id", "revision").select("id", "state")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").select(F.col("id").alias("block_id"), "message_id", F.col("ordinal").alias("block_ordinal"), "block_type").distinct()
    m = messages(spark, d).select(F.col("id").alias("message_id"), "conversation_id", F.col("ordinal").alias("message_ordinal"), "role")
    return b.join(m, "message_id")


_PLACED = f"(SELECT b.id AS block_id, b.ordinal AS block_ordinal, b.block_type, m.id AS message_id, m.conversation_id, m.ordinal AS message_ordinal, m.role FROM (SELECT DISTINCT id, message_id, ordinal, block_type FROM blocks) b JOIN {_MS} m ON m.id = b.message_id)"


@query(f"""WITH e AS (SELECT conversation_id, block_id AS a, lead(block_id) OVER (PARTITION BY conversation_id ORDER BY message_ordinal, block_ordinal, block_id) AS b FROM {_PLACED} WHERE conversation_id IS NOT NULL AND message_ordinal IS NOT NULL)
SELECT least(a, b) AS src, greatest(a, b) AS dst, 'temporal_neighbor' AS edge_kind, CAST(1.0 AS DOUBLE) AS score FROM e WHERE b IS NOT NULL""")
def temporal_edges(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(spark, d).where("conversation_id is not null and message_ordinal is not null")
    return graph.temporal_edges(p, "conversation_id", "block_id", ["message_ordinal", "block_ordinal", "block_id"])


def _members(spark: SparkSession, d: str) -> DataFrame:
    """(group_type, group_id, chunk_id): every chunk in its conversation and in its project, with or without a vector."""
    c = table(spark, d, "retrieval_chunks").select(F.col("id").alias("chunk_id"), "block_id").distinct()
    v = table(spark, d, "conversations").select(F.col("id").alias("conversation_id"), "project_id").distinct()
    b, m = table(spark, d, "blocks").select(F.col("id").alias("block_id"), "message_id").distinct(), table(spark, d, "messages").select(F.col("id").alias("message_id"), "conversation_id").distinct()
    rows = c.join(b.join(m, "message_id").select("block_id", "conversation_id").distinct(), "block_id").join(v, "conversation_id", "left")
    return graph.memberships(rows, "chunk_id", {"conversation": "conversation_id", "project": "project_id"})


_MEMBERS = f"""pl AS (SELECT DISTINCT c.id AS chunk_id, p.conversation_id, v.project_id FROM (SELECT DISTINCT id, block_id FROM retrieval_chunks) c JOIN {_PLACED} p ON p.block_id = c.block_id LEFT JOIN (SELECT DISTINCT id, project_id FROM conversations) v ON v.id = p.conversation_id),
mb AS (SELECT 'conversation' AS group_type, conversation_id AS group_id, chunk_id FROM pl WHERE conversation_id IS NOT NULL UNION SELECT 'project', project_id, chunk_id FROM pl WHERE project_id IS NOT NULL)"""


@query(f"""SELECT * EXCLUDE (kept) FROM (WITH {_VECS}, {_TERMS}, {_MEMBERS}, g AS (SELECT *, count(*) OVER (PARTITION BY group_type, group_id) AS k FROM mb WHERE chunk_id IN (SELECT chunk_id FROM v UNION SELECT chunk_id FROM t)),
c2 AS (SELECT chunk_id, sqrt(sum(weight * weight)) AS n FROM w GROUP BY 1), y AS (SELECT g.group_type, g.group_id, chunk_id, term, weight / n AS weight FROM g JOIN w USING (chunk_id) JOIN c2 USING (chunk_id) WHERE k BETWEEN 2 AND 1000),
z AS (SELECT g.group_type, g.group_id, g.chunk_id, v.space, v.x FROM g JOIN v USING (chunk_id) WHERE k BETWEEN 2 AND 1000),
dn AS (SELECT a.group_type, a.group_id, a.chunk_id AS a, b.chunk_id AS b, max(list_cosine_similarity(a.x, b.x)) AS dense FROM z a JOIN z b ON a.group_type = b.group_type AND a.group_id = b.group_id AND a.space = b.space AND len(a.x) = len(b.x) AND a.chunk_id < b.chunk_id GROUP BY ALL),
sp AS (SELECT a.group_type, a.group_id, a.chunk_id AS a, b.chunk_id AS b, sum(a.weight * b.weight) AS sparse FROM y a JOIN y b ON a.group_type = b.group_type AND a.group_id = b.group_id AND a.term = b.term AND a.chunk_id < b.chunk_id GROUP BY ALL),
h AS (SELECT group_type, group_id, a, b, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse, round(0.65 * coalesce(dense, 0) + 0.35 * coalesce(sparse, 0), 9) AS hybrid FROM dn FULL JOIN sp USING (group_type, group_id, a, b)),
tt AS (SELECT * FROM h WHERE hybrid > 0 QUALIFY row_number() OVER (PARTITION BY group_type, group_id ORDER BY hybrid DESC, a, b) <= 10)
SELECT group_type, group_id, a AS src, b AS dst, unnest(['dense_sim', 'sparse_overlap', 'hybrid_sim']) AS edge_kind, round(unnest([dense, sparse, hybrid]), 6) AS score, round(unnest([dense, sparse, hybrid]), 9) > 0 AS kept FROM tt) WHERE kept""")
def similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    """Similarity edges of conversations and of projects, over all chunks with a vector of any space or with terms."""
    e = graph.member_edges(_members(spark, d), usable_vectors(spark, d), chunk_term_lists(spark, d), ["group_type", "group_id"], "chunk_id", 10)
    return e.select("group_type", "group_id", "src", "dst", "edge_kind", F.round("score", 6).alias("score"))


@query(f"""WITH {_VECS}, {_MEMBERS}, l AS (SELECT v.space, mb.group_type, mb.group_id, v.x FROM mb JOIN v USING (chunk_id)), s AS (SELECT space, group_type, group_id, any_value(len(x)) AS k FROM l GROUP BY ALL HAVING min(len(x)) = max(len(x))),
e AS (SELECT space, group_type, group_id, i, avg(x[i]) AS m FROM (SELECT l.*, unnest(range(1, k + 1)) AS i FROM l JOIN s USING (space, group_type, group_id)) GROUP BY ALL), n AS (SELECT space, group_type, group_id, sqrt(sum(m * m)) AS l2 FROM e GROUP BY ALL)
SELECT space, group_type, group_id, i - 1 AS position, round(CASE WHEN l2 > 0 THEN m / l2 ELSE m END, 6) AS value FROM e JOIN n USING (space, group_type, group_id)""")
def mean_pool_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Mean vectors of conversations and of projects, one for each space that has vectors of their chunks."""
    m = graph.mean_vectors(_members(spark, d).join(usable_vectors(spark, d).select("chunk_id", "space", "vector"), "chunk_id"), ["space", "group_type", "group_id"], "vector")
    return m.select("space", "group_type", "group_id", F.posexplode("mean").alias("position", "value")).select("space", "group_type", "group_id", F.col("position").cast("long").alias("position"), F.round("value", 6).alias("value"))


@query(f"""WITH {_TERMS}, p AS (SELECT DISTINCT c.id AS chunk_id, q.conversation_id FROM (SELECT DISTINCT id, block_id FROM retrieval_chunks) c JOIN {_PLACED} q ON q.block_id = c.block_id WHERE q.conversation_id IS NOT NULL),
m AS (SELECT conversation_id, term, max(weight) AS weight FROM w JOIN p USING (chunk_id) GROUP BY 1, 2)
SELECT conversation_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY conversation_id ORDER BY weight DESC, term) AS place FROM m QUALIFY place <= 50""")
def max_pool_topterms(spark: SparkSession, d: str) -> DataFrame:
    p = chunks(spark, d).select(F.col("id").alias("chunk_id"), "block_id").distinct().join(_placed(spark, d).select("block_id", "conversation_id"), "block_id").where("conversation_id is not null").select("chunk_id", "conversation_id").distinct()
    t = graph.top_terms(chunk_terms(spark, d).join(p, "chunk_id"), ["conversation_id"], 50)
    return t.select("conversation_id", "term", F.round("weight", 6).alias("weight"), F.col("place").cast("long").alias("place"))


@query(f"""WITH m AS (SELECT DISTINCT b.block_id, b.conversation_id, c.project_id FROM {_PLACED} b LEFT JOIN (SELECT DISTINCT id, project_id FROM conversations) c ON c.id = b.conversation_id),
g AS (SELECT 'conversation' AS node_type, conversation_id AS group_id, block_id FROM m WHERE conversation_id IS NOT NULL UNION SELECT 'project', project_id, block_id FROM m WHERE project_id IS NOT NULL)
SELECT 'node_' || substr(sha256(concat_ws(chr(31), 'semantic_node', node_type, group_id)), 1, 32) AS node_id, node_type, group_id, count(*) AS members FROM g GROUP BY 1, 2, 3""")
def group_nodes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("id").alias("conversation_id"), "project_id").distinct()
    rows = _placed(spark, d).join(c, "conversation_id", "left")
    return graph.nodes(graph.memberships(rows, "block_id", {"conversation": "conversation_id", "project": "project_id"}))


_TEMP = f"(WITH e AS (SELECT conversation_id, block_id AS a, lead(block_id) OVER (PARTITION BY conversation_id ORDER BY message_ordinal, block_ordinal, block_id) AS b FROM {_PLACED} WHERE conversation_id IS NOT NULL AND message_ordinal IS NOT NULL) SELECT least(a, b) AS src, greatest(a, b) AS dst FROM e WHERE b IS NOT NULL)"


@query(f"""WITH s AS (SELECT DISTINCT id AS seed FROM blocks WHERE block_type = 'code'), e AS (SELECT DISTINCT * FROM {_TEMP}), n AS (SELECT seed, dst AS neighbour FROM e JOIN s ON s.seed = src UNION SELECT seed, src FROM e JOIN s ON s.seed = dst)
SELECT seed, neighbour, CAST(1.0 AS DOUBLE) AS score, row_number() OVER (PARTITION BY seed ORDER BY neighbour) AS place FROM n QUALIFY place <= 20""")
def neighbour_expand(spark: SparkSession, d: str) -> DataFrame:
    n = graph.neighbours(temporal_edges(spark, d), table(spark, d, "blocks").where("block_type = 'code'"), "id", 20)
    return n.select("seed", "neighbour", "score", F.col("place").cast("long").alias("place"))


@query(f"""WITH a AS (SELECT DISTINCT expected_message_id AS id FROM real_probes), w AS (SELECT m.conversation_id, min(m.ordinal - 2) AS lo, max(m.ordinal + 2) AS hi FROM {_MS} m JOIN a ON a.id = m.id WHERE m.conversation_id IS NOT NULL GROUP BY 1)
SELECT m.conversation_id, m.id AS message_id, m.ordinal FROM {_MS} m JOIN w ON w.conversation_id = m.conversation_id AND m.ordinal BETWEEN w.lo AND w.hi""")
def message_windows(spark: SparkSession, d: str) -> DataFrame:
    """Messages within two of an expected message, one merged window a conversation."""
    m = messages(spark, d)
    a = m.join(table(spark, d, "real_probes").select(F.col("expected_message_id").alias("id")).distinct(), "id", "left_semi")
    w = a.where("conversation_id is not null").groupBy("conversation_id").agg(F.min(F.col("ordinal") - 2).alias("lo"), F.max(F.col("ordinal") + 2).alias("hi"))
    return m.join(w, "conversation_id").where(F.col("ordinal").between(F.col("lo"), F.col("hi"))).select("conversation_id", F.col("id").alias("message_id"), "ordinal")


_HITS = """h AS (SELECT probe_id, chunk_id, max(final_score) AS score FROM native_retrieval_hits WHERE isfinite(final_score) GROUP BY 1, 2), k AS (SELECT h.*, s.m, s.c FROM h JOIN (SELECT probe_id, chunk_id, max(source_message_id) AS m, max(source_conversation_id) AS c FROM snapshot_rows GROUP BY 1, 2) s ON s.probe_id = h.probe_id AND s.chunk_id = h.chunk_id WHERE m IS NOT NULL AND c IS NOT NULL)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.vectors import finite_score

    h = table(spark, d, "native_retrieval_hits").select("probe_id", "chunk_id", finite_score(F.col("final_score")).alias("score")).where("score is not null").groupBy("probe_id", "chunk_id").agg(F.max("score").alias("score"))
    s = table(spark, d, "snapshot_rows").groupBy("probe_id", "chunk_id").agg(F.max("source_message_id").alias("message_id"), F.max("source_conversation_id").alias("conversation_id"))
    return h.join(s, ["probe_id", "chunk_id"]).where("message_id is not null and conversation_id is not null")


@query(f"""WITH {_HITS}, b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY probe_id, m ORDER BY score DESC, chunk_id) = 1),
v AS (SELECT *, row_number() OVER (PARTITION BY probe_id, c ORDER BY score DESC, chunk_id) AS r, max(score) OVER (PARTITION BY probe_id, c) AS top FROM b), o AS (SELECT *, dense_rank() OVER (PARTITION BY probe_id ORDER BY top DESC, c) AS cr FROM v)
SELECT probe_id, m AS message_id, c AS conversation_id, chunk_id, round(score, 6) AS score FROM o WHERE r <= 3 AND cr <= 6""")
def best_per_message_diverse(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.assemble import diverse_messages

    return diverse_messages(_hits(spark, d), "probe_id").select("probe_id", "message_id", "conversation_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_HITS}, o AS (SELECT k.probe_id, k.chunk_id, c.token_count AS t, row_number() OVER (PARTITION BY k.probe_id ORDER BY score DESC, k.chunk_id) AS rn FROM k JOIN (SELECT id, max(token_count) AS token_count FROM retrieval_chunks GROUP BY 1) c ON c.id = k.chunk_id),
f AS (SELECT probe_id, chunk_id, rn, t AS used, true AS taken FROM o WHERE rn = 1 UNION ALL SELECT o.probe_id, o.chunk_id, o.rn, CASE WHEN f.used < 400 AND f.used + o.t <= 400 THEN f.used + o.t ELSE f.used END, f.used < 400 AND f.used + o.t <= 400 FROM f JOIN o ON o.probe_id = f.probe_id AND o.rn = f.rn + 1)
SELECT probe_id, chunk_id FROM f WHERE taken""")
def token_budget_select(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).groupBy(F.col("id").alias("chunk_id")).agg(F.max("token_count").alias("tokens"))
    return graph.within_budget(_hits(spark, d).join(c, "chunk_id"), "probe_id", "chunk_id", "score", "tokens", 400)


@query("""SELECT template, 'Project_' || lpad(CAST(row_number() OVER (ORDER BY template) AS VARCHAR), 2, '0') AS label FROM (SELECT DISTINCT conversation_template_id AS template FROM conversations WHERE coalesce(conversation_template_id, '') <> '')""")
def project_labels(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.distill import project_labels as labels

    return labels(table(spark, d, "conversations"), "conversation_template_id")


@query("""WITH c AS (SELECT id, coalesce(update_time_utc, create_time_utc) AS t, coalesce(folder_kind, 'common') AS f, coalesce(assistant_messages, 0) AS a FROM conversations)
SELECT id, f = 'common' AND t IS NOT NULL AND epoch(TRY_CAST(t AS TIMESTAMPTZ)) < 1735689600 - 60 * 86400 AND a <= 9 AS trash, CASE WHEN f = 'pinned' THEN 'Pinned' WHEN f = 'common' THEN 'Common' ELSE 'Projects' END AS bucket FROM c""")
def trash_routing(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.distill import potential_trash, route

    c = table(spark, d, "conversations").select("id", F.coalesce("update_time_utc", "create_time_utc").alias("t"), F.coalesce("folder_kind", F.lit("common")).alias("f"), F.coalesce("assistant_messages", F.lit(0)).alias("a"))
    seconds = F.unix_micros(F.col("t").try_cast("timestamp")) / 1_000_000
    return c.select("id", potential_trash(F.col("f") == "common", seconds, F.col("a"), 1735689600).alias("trash"), route(F.col("f")).alias("bucket"))


@query("""WITH s AS (SELECT id, coalesce(folder_kind, 'common') AS grp, regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9а-яё]+', '_', 'g'), '^_+|_+$', '', 'g') AS base FROM conversations WHERE title IS NOT NULL)
SELECT id, base || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.md' AS file_name FROM (SELECT id, CASE WHEN base = '' THEN left(id, 12) ELSE left(base, 120) END AS base, row_number() OVER (PARTITION BY grp, CASE WHEN base = '' THEN left(id, 12) ELSE left(base, 120) END ORDER BY id) AS n FROM s)""")
def filename_dedupe(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.distill import unique_names

    c = table(spark, d, "conversations").where("title is not null").select("id", F.coalesce("folder_kind", F.lit("common")).alias("grp"), T.slug(F.col("title"), F.col("id")).alias("base"))
    return unique_names(c, "grp", "base", "id").select("id", "file_name")


@query("""SELECT coalesce(source, 'none') AS source, count(*) AS files, count(DISTINCT project_id) AS projects, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars, array_to_string(list_sort(array_agg(file_name ORDER BY file_name))[1:5], ', ') || CASE WHEN count(file_name) > 5 THEN ' +' || (count(file_name) - 5) || ' more' ELSE '' END AS samples
FROM (SELECT * FROM documents) GROUP BY 1""")
def library_summary(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.distill import sample_list

    g = table(spark, d, "documents").withColumn("source", F.coalesce("source", F.lit("none")))
    names = sample_list(g, "source", "file_name", 5)
    agg = g.groupBy("source").agg(F.count("*").alias("files"), F.countDistinct("project_id").alias("projects"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("chars"))
    return agg.join(names, "source").select("source", "files", "projects", "chars", "samples")


@query(f"""WITH p AS (SELECT *, (row_number() OVER (ORDER BY token_count, id) - 1) // 32 AS b FROM (SELECT id, max(token_count) AS token_count FROM retrieval_chunks GROUP BY 1)), g AS (SELECT b, sum(token_count) AS real, max(token_count) * count(*) AS padded FROM p GROUP BY 1)
SELECT count(*) AS batches, CAST(sum(real) AS BIGINT) AS real_tokens, CAST(sum(padded) AS BIGINT) AS padded_tokens, round(sum(real) / sum(padded), 6) AS efficiency FROM g""")
def padding_efficiency(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.embed import length_batches

    c = chunks(spark, d).groupBy("id").agg(F.max("token_count").alias("token_count"))
    g = length_batches(c, "id", "token_count", 32).groupBy("batch").agg(F.sum("token_count").alias("real"), (F.max("token_count") * F.count("*")).alias("padded"))
    return g.agg(F.count("*").alias("batches"), F.sum("real").cast("long").alias("real_tokens"), F.sum("padded").cast("long").alias("padded_tokens"), F.round(F.sum("real") / F.sum("padded"), 6).alias("efficiency"))


@query(f"WITH {_TERMS} SELECT term, row_number() OVER (ORDER BY term) - 1 AS token_index FROM (SELECT DISTINCT term FROM w)")
def vocab_assignment(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.embed import vocabulary

    return vocabulary(chunk_terms(spark, d)).select("term", "token_index")


@query("""SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1""")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("k_sum"))


@query("""SELECT id FROM (SELECT DISTINCT id FROM messages) ORDER BY sha256(id) LIMIT 50""")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic sample of 50 messages: the limit is the operator's feature."""
    return table(spark, d, "messages").select("id").distinct().orderBy(F.sha2("id", 256)).limit(50)


@query("""SELECT doc_id, abs(length(text) - 2000) AS distance FROM documents WHERE text IS NOT NULL ORDER BY distance, doc_id LIMIT 20""")
def nearest_length_sample(spark: SparkSession, d: str) -> DataFrame:
    """The 20 documents nearest to a target length: the limit is the operator's feature."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.abs(F.length("text") - 2000).cast("long").alias("distance"))
    return t.orderBy("distance", "doc_id").limit(20)


@query(f"""SELECT c.id AS chunk_id, substr(m.raw_text, c.source_char_start + 1, c.source_char_end - c.source_char_start) = c.text AS exact FROM {_CH} c JOIN (SELECT DISTINCT id, message_id FROM blocks) b ON b.id = c.block_id JOIN (SELECT id, min(raw_text) AS raw_text FROM messages GROUP BY 1) m ON m.id = b.message_id""")
def offset_validation(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").groupBy(F.col("id").alias("message_id")).agg(F.min("raw_text").alias("raw_text"))
    b = table(spark, d, "blocks").select(F.col("id").alias("block_id"), "message_id").distinct()
    x = chunks(spark, d).join(b, "block_id").join(m, "message_id")
    return x.select(F.col("id").alias("chunk_id"), (F.substring("raw_text", F.col("source_char_start") + 1, F.col("source_char_end") - F.col("source_char_start")) == F.col("text")).alias("exact"))


@query("""SELECT m.role, count(*) AS messages, count(DISTINCT m.conversation_id) AS conversations FROM (SELECT DISTINCT id, lower(trim(role)) AS role, conversation_id, coalesce(time_utc, '') AS t FROM messages) m
WHERE m.role IN ('user', 'assistant', 'system', 'tool') AND (m.t = '' OR (m.t >= '2024-01-01' AND m.t <= '2024-12-31T23:59:59')) GROUP BY 1""")
def archive_filter(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.assemble import archive_filter as keep

    m = messages(spark, d).withColumn("role", F.lower(F.trim("role")))
    f = keep(m, roles=["user", "assistant", "system", "tool"], date_from="2024-01-01", date_to="2024-12-31T23:59:59")
    return f.groupBy("role").agg(F.countDistinct("id").alias("messages"), F.countDistinct("conversation_id").alias("conversations"))


@query("""WITH v AS (SELECT embedding_space_id AS space, CASE WHEN vector IS NULL THEN 'null' WHEN len(vector) = 0 THEN 'empty' WHEN len(vector) <> dim THEN 'length' WHEN NOT list_bool_and(list_transform(vector, lambda e: coalesce(isfinite(e), false))) THEN 'not finite' WHEN NOT list_bool_or(list_transform(vector, lambda e: e <> 0)) THEN 'zero' ELSE 'usable' END AS state FROM dense_native_metadata)
SELECT space, state, count(*) AS rows FROM v GROUP BY 1, 2""")
def vector_validity(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.embed import vector_state

    return table(spark, d, "dense_native_metadata").groupBy(F.col("embedding_space_id").alias("space"), vector_state(F.col("vector"), F.col("dim")).alias("state")).agg(F.count("*").alias("rows"))
