"""Queries of dense, sparse and hybrid retrieval and of fusion evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluate, retrieve
from ..session import settle
from ..sources.tables import table
from .registry import query


def usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(rowid, chunk_id, space, vector): usable vectors, each chunk once a space (its smallest rowid)."""
    v = table(spark, d, "dense_native_metadata").select("rowid", "chunk_id", F.col("embedding_space_id").alias("space"), "dim", "vector")
    v = v.where(V.finite(F.col("vector")) & (F.size("vector") == F.col("dim")) & F.exists("vector", lambda x: x != 0))
    return v.withColumn("_r", F.row_number().over(Window.partitionBy("space", "chunk_id").orderBy("rowid"))).where("_r = 1").drop("_r", "dim")


_VECS = """v AS (SELECT rowid AS rid, chunk_id, embedding_space_id AS space, CAST(vector AS DOUBLE[]) AS x FROM dense_native_metadata WHERE vector IS NOT NULL AND len(vector) = dim AND len(vector) > 0
 AND list_bool_and(list_transform(vector, lambda e: coalesce(isfinite(e), false))) AND list_bool_or(list_transform(vector, lambda e: e <> 0)) QUALIFY row_number() OVER (PARTITION BY embedding_space_id, chunk_id ORDER BY rowid) = 1)"""
_TERMS = """t AS (SELECT id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9а-яё_]{2,}')) AS term FROM (SELECT DISTINCT id, text FROM retrieval_chunks)),
n AS (SELECT chunk_id, count(*) AS total FROM t GROUP BY 1), w AS (SELECT t.chunk_id, term, count(*) / CAST(any_value(total) AS DOUBLE) AS weight FROM t JOIN n USING (chunk_id) GROUP BY 1, 2)"""


@query(f"""WITH {_VECS}, p AS (SELECT q.chunk_id AS query, r.chunk_id AS id, round(list_cosine_similarity(q.x, r.x), 9) AS c FROM v q JOIN v r ON q.space = r.space AND q.chunk_id <> r.chunk_id WHERE q.rid % 100 = 0)
SELECT query, id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS place FROM p QUALIFY place <= 10""")
def dense_knn_topk(spark: SparkSession, d: str) -> DataFrame:
    v = usable_vectors(spark, d)
    out = retrieve.exact_neighbours(v.where("rowid % 100 = 0"), v, "chunk_id", "vector", "space", 10)
    return out.select("query", "id", F.round("cosine", 6).alias("cosine"), F.col("place").cast("long").alias("place"))


def chunk_terms(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.term_weights(table(spark, d, "retrieval_chunks").select("id", "text").distinct().withColumnRenamed("id", "chunk_id"), "chunk_id", "text")


@query(f"WITH {_TERMS} SELECT chunk_id, term, round(weight, 6) AS weight FROM w")
def term_frequency_terms(spark: SparkSession, d: str) -> DataFrame:
    return chunk_terms(spark, d).select("chunk_id", "term", F.round("weight", 6).alias("weight"))


_SPARSE = f"""{_TERMS}, qt AS (SELECT probe_id, unnest(regexp_extract_all(lower(query), '[a-z0-9а-яё_]{{2,}}')) AS term FROM real_probes), qn AS (SELECT probe_id, count(*) AS total FROM qt GROUP BY 1),
qw AS (SELECT qt.probe_id, term, count(*) / CAST(any_value(total) AS DOUBLE) AS weight FROM qt JOIN qn USING (probe_id) GROUP BY 1, 2),
q2 AS (SELECT probe_id, sqrt(sum(weight * weight)) AS l FROM qw GROUP BY 1), c2 AS (SELECT chunk_id, sqrt(sum(weight * weight)) AS l FROM w GROUP BY 1),
s AS (SELECT probe_id, chunk_id, round(sum(qw.weight * w.weight) / (any_value(q2.l) * any_value(c2.l)), 9) AS score, count(*) AS shared FROM qw JOIN w USING (term) JOIN q2 USING (probe_id) JOIN c2 USING (chunk_id) GROUP BY 1, 2)"""


def chunk_term_lists(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, terms): each chunk once, its terms as often as they occur."""
    texts = table(spark, d, "retrieval_chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.collect_set("text").alias("texts"))
    return texts.select("chunk_id", F.flatten(F.transform("texts", V.terms)).alias("terms"))


@query(f"WITH {_SPARSE} SELECT probe_id, chunk_id, round(score, 6) AS score, shared, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, chunk_id) AS place FROM s QUALIFY place <= 10")
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "real_probes").select("probe_id", V.terms(F.col("query")).alias("terms"))
    top = retrieve.sparse_neighbours(asked, chunk_term_lists(spark, d), "probe_id", "chunk_id", "terms", 10)
    return top.select("probe_id", "chunk_id", F.round("score", 6).alias("score"), "shared", F.col("place").cast("long").alias("place"))


_HYBRID = f"""WITH {_VECS}, {_TERMS}, c2 AS (SELECT chunk_id, sqrt(sum(weight * weight)) AS l FROM w GROUP BY 1),
q AS (SELECT chunk_id AS query, space, x FROM v WHERE rid % 100 = 0),
dn AS (SELECT query, r.chunk_id, round(list_cosine_similarity(q.x, r.x), 9) AS s FROM q JOIN v r ON q.space = r.space AND q.query <> r.chunk_id),
sp AS (SELECT q.query, w.chunk_id, round(sum(a.weight * w.weight) / (any_value(x.l) * any_value(y.l)), 9) AS s FROM (SELECT DISTINCT query FROM q) q JOIN w a ON a.chunk_id = q.query JOIN w ON w.term = a.term AND w.chunk_id <> q.query JOIN c2 x ON x.chunk_id = q.query JOIN c2 y ON y.chunk_id = w.chunk_id GROUP BY 1, 2),
dp AS (SELECT * FROM dn QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, chunk_id) <= {retrieve.POOL}), pp AS (SELECT * FROM sp WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, chunk_id) <= {retrieve.POOL}),
u AS (SELECT coalesce(dp.query, pp.query) AS query, coalesce(dp.chunk_id, pp.chunk_id) AS chunk_id, coalesce(pp.s, 0) AS sparse FROM dp FULL JOIN pp ON dp.query = pp.query AND dp.chunk_id = pp.chunk_id),
f AS (SELECT u.*, coalesce(dn.s, 0) AS dense, 0.65 * coalesce(dn.s, 0) + 0.35 * sparse AS fused FROM u LEFT JOIN dn ON dn.query = u.query AND dn.chunk_id = u.chunk_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(fused, 9) DESC, chunk_id) AS place FROM f QUALIFY place <= 10)"""


_PROV = """SELECT k.query, k.chunk_id, round(dense, 6) AS dense, round(sparse, 6) AS sparse, round(fused, 6) AS fused, place, m.id AS message_id, m.conversation_id, c.title FROM k
JOIN (SELECT DISTINCT id, block_id FROM retrieval_chunks) r ON r.id = k.chunk_id JOIN (SELECT DISTINCT id, message_id FROM blocks) b ON b.id = r.block_id
JOIN (SELECT DISTINCT id, conversation_id FROM messages) m ON m.id = b.message_id JOIN (SELECT DISTINCT id, title FROM conversations) c ON c.id = m.conversation_id"""


@query(f"{_HYBRID} {_PROV}")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search of every chunk whose rowid is divisible by 100 over all chunks, with the archive's candidate pools and provenance."""
    v, terms, pool = usable_vectors(spark, d), chunk_term_lists(spark, d), retrieve.POOL
    q = v.where("rowid % 100 = 0")
    dense = retrieve.exact_neighbours(q, v, "chunk_id", "vector", "space", pool).select("query", F.col("id").alias("chunk_id"), F.col("cosine").alias("score"))
    asked = terms.join(q.select("chunk_id").distinct(), "chunk_id", "left_semi").withColumnRenamed("chunk_id", "query")
    sparse = retrieve.sparse_neighbours(asked, terms, "query", "chunk_id", "terms", pool)
    both = settle(retrieve.candidate_union(dense.select("query", "chunk_id"), sparse.select("query", "chunk_id", F.col("score").alias("sparse")), ["query", "chunk_id"]))
    # every candidate is scored exactly by both branches' rule; those found by one alone are scored here
    qv, rv = q.select(F.col("chunk_id").alias("query"), "space", F.col("vector").alias("qv")), v.select("chunk_id", "space", F.col("vector").alias("rv"))
    exact = both.select("query", "chunk_id").join(qv, "query").join(rv, ["chunk_id", "space"]).groupBy("query", "chunk_id").agg(F.max(F.round(V.cosine(F.col("qv"), F.col("rv")), 9)).alias("dense"))
    fused = both.join(exact, ["query", "chunk_id"], "left").na.fill(0.0, ["dense", "sparse"]).withColumn("fused", V.weighted(F.col("dense"), F.col("sparse")))
    hits = retrieve.top_rows(fused, ["query"], [F.desc(F.round("fused", 9)), F.asc("chunk_id")], 10)
    full = retrieve.with_provenance(hits, table(spark, d, "retrieval_chunks"), table(spark, d, "blocks"), table(spark, d, "messages"), table(spark, d, "conversations"))
    r = lambda c: F.round(c, 6).alias(c)
    return full.select("query", "chunk_id", r("dense"), r("sparse"), r("fused"), F.col("place").cast("long").alias("place"), "message_id", "conversation_id", "title")


# --------------------------------------------------------------------------- fusion over the raw-score snapshot


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Clean raw scores: rows with both scores usable, each chunk of a probe once, ranks taken anew."""
    s = table(spark, d, "snapshot_rows").select("probe_id", "chunk_id", "source_message_id", "source_conversation_id", V.finite_score(F.col("dense_score")).alias("dense_score"), V.finite_score(F.col("sparse_score")).alias("sparse_score"))
    s = s.where("dense_score is not null and sparse_score is not null").groupBy("probe_id", "chunk_id").agg(*[F.max(c).alias(c) for c in ("source_message_id", "source_conversation_id", "dense_score", "sparse_score")])
    return retrieve.ranked(retrieve.ranked(s, "probe_id", "dense_score", "chunk_id", "dense_rank"), "probe_id", "sparse_score", "chunk_id", "sparse_rank")


_SNAP = """s AS (SELECT probe_id, chunk_id, max(source_message_id) AS source_message_id, max(source_conversation_id) AS source_conversation_id, max(dense_score) AS d, max(sparse_score) AS p FROM snapshot_rows WHERE isfinite(dense_score) AND isfinite(sparse_score) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d DESC, chunk_id) AS dr, row_number() OVER (PARTITION BY probe_id ORDER BY p DESC, chunk_id) AS pr,
 CASE WHEN max(d) OVER (PARTITION BY probe_id) = 0 THEN 1 ELSE max(d) OVER (PARTITION BY probe_id) END AS dm, CASE WHEN max(p) OVER (PARTITION BY probe_id) = 0 THEN 1 ELSE max(p) OVER (PARTITION BY probe_id) END AS pm FROM s)"""


def _variant_sql() -> str:
    out = []
    for name, kind, a, b, pool in retrieve.variants():
        ind, ins = (f"dr <= {pool}", f"pr <= {pool}") if pool else ("true", "true")
        if kind == "raw":
            e, w = f"d * {a} + p * {b}", "true"
        elif kind == "rrf":
            e, w = f"CASE WHEN {ind} THEN 1.0::DOUBLE / (60 + dr) ELSE 0 END + CASE WHEN {ins} THEN 1.0::DOUBLE / (60 + pr) ELSE 0 END", f"{ind} OR {ins}"
        elif kind == "sparse_first":
            e, w = "p / pm + 0.10 * d / dm", ins
        else:
            e, w = f"{a} * d / dm + {b} * p / pm", f"{ind} OR {ins}"
        out.append(f"SELECT probe_id, chunk_id, source_message_id, source_conversation_id, '{name}' AS variant, CAST({e} AS DOUBLE) AS score FROM r WHERE {w}")
    return " UNION ALL ".join(out)


_FUSED = f"{_SNAP}, f AS ({_variant_sql()})"


def variants_scored(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.fused(snapshot(spark, d), "probe_id").withColumn("score", F.round("score", 9))


@query(f"WITH {_FUSED} SELECT variant, probe_id, chunk_id, round(score, 8) AS score, row_number() OVER (PARTITION BY variant, probe_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM f QUALIFY place <= 20")
def fusion_variants_top20(spark: SparkSession, d: str) -> DataFrame:
    """All fusion variants (raw, normalized, reciprocal-rank and sparse-first, by pool) with their first 20 chunks."""
    top = retrieve.top_rows(variants_scored(spark, d), ["variant", "probe_id"], [F.desc("score"), F.asc("chunk_id")], 20)
    return top.select("variant", "probe_id", "chunk_id", F.round("score", 8).alias("score"), F.col("place").cast("long").alias("place"))


_RANKS = f"""WITH {_FUSED}, g AS (SELECT variant, probe_id, chunk_id, source_message_id AS m, source_conversation_id AS c, round(score, 9) AS score FROM f),
cr AS (SELECT *, row_number() OVER (PARTITION BY variant, probe_id ORDER BY score DESC, chunk_id) AS rk FROM g),
mb AS (SELECT variant, probe_id, m, min(rk) AS best FROM cr WHERE m IS NOT NULL GROUP BY ALL), mr AS (SELECT *, row_number() OVER (PARTITION BY variant, probe_id ORDER BY best) AS rk FROM mb),
vb AS (SELECT variant, probe_id, c, min(rk) AS best FROM cr WHERE c IS NOT NULL GROUP BY ALL), vr AS (SELECT *, row_number() OVER (PARTITION BY variant, probe_id ORDER BY best) AS rk FROM vb),
pb AS (SELECT probe_id, any_value(expected_message_id) AS em, any_value(expected_conversation_id) AS ec, any_value(category) AS category, any_value(transformation_type) AS transformation_type, any_value(source_dataset) AS source_dataset, any_value(coalesce(expected_role, 'unknown')) AS expected_role FROM real_probes WHERE probe_id IN (SELECT probe_id FROM s) GROUP BY 1),
e AS (SELECT v.variant, pb.*, (SELECT min(rk) FROM cr WHERE cr.variant = v.variant AND cr.probe_id = pb.probe_id AND cr.m = pb.em) AS chunk_rank, mr.rk AS message_rank, vr.rk AS conversation_rank
 FROM (SELECT DISTINCT variant FROM f) v CROSS JOIN pb LEFT JOIN mr ON mr.variant = v.variant AND mr.probe_id = pb.probe_id AND mr.m = pb.em LEFT JOIN vr ON vr.variant = v.variant AND vr.probe_id = pb.probe_id AND vr.c = pb.ec)"""


def probe_ranks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "real_probes").groupBy("probe_id").agg(*[F.first(c).alias(c) for c in ("expected_message_id", "expected_conversation_id", "category", "transformation_type", "source_dataset")], F.first(F.coalesce("expected_role", F.lit("unknown"))).alias("expected_role"))
    return evaluate.probe_ranks(variants_scored(spark, d), p)


@query(f"{_RANKS} SELECT variant, probe_id, coalesce(chunk_rank, 0) AS chunk_rank, coalesce(message_rank, 0) AS message_rank, coalesce(conversation_rank, 0) AS conversation_rank FROM e")
def probe_rank_table(spark: SparkSession, d: str) -> DataFrame:
    return probe_ranks(spark, d).select("variant", "probe_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("chunk_rank", "message_rank", "conversation_rank")])  # 0: not found


_RECALL = ", ".join(f"round(avg(CASE WHEN {c} <= {k} THEN 1.0 ELSE 0.0 END), 6) AS {n}_recall_{k}" for n, c, ks in (("chunk", "chunk_rank", (1, 5, 10, 20)), ("message", "message_rank", (1, 5, 10, 20)), ("conversation", "conversation_rank", (10, 20))) for k in ks)


@query(f"{_RANKS} SELECT variant, count(*) AS probes, {_RECALL}, round(avg(coalesce(1.0 / message_rank, 0)), 6) AS message_mrr, median(message_rank) AS median_message_rank, count_if(coalesce(message_rank, 99) > 20) AS misses_20 FROM e GROUP BY 1")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.retrieval_metrics(probe_ranks(spark, d), ["variant"])


_DIMS = ("category", "transformation_type", "source_dataset", "expected_role")


@query(f"{_RANKS}, x AS (" + " UNION ALL ".join(f"SELECT variant, '{c}' AS dimension, {c} AS value, message_rank FROM e" for c in _DIMS) + """)
SELECT variant, dimension, value, count(*) AS probes, round(avg(CASE WHEN message_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / message_rank, 0)), 6) AS mrr, count(*) < 10 AS small_sample FROM x GROUP BY ALL""")
def breakdowns_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.breakdown(probe_ranks(spark, d), list(_DIMS))


_HY = ", ".join(f"'normalized_weighted_{round(a * 100):03d}_{round(b * 100):03d}'" for a, b in retrieve.NORMALIZED)


@query(f"""{_RANKS}, rr AS (SELECT variant, probe_id, coalesce(1.0::DOUBLE / message_rank, 0) AS rr, coalesce(message_rank, 99) AS mk FROM e),
z AS (SELECT probe_id, max(CASE WHEN variant = 'dense_only' THEN rr END) AS dense_rr, max(CASE WHEN variant = 'sparse_only' THEN rr END) AS sparse_rr, max(CASE WHEN variant IN ({_HY}) THEN rr END) AS hybrid_rr, arg_min(variant, CASE WHEN variant IN ({_HY}) THEN (-rr, variant) END) AS best_hybrid FROM rr GROUP BY 1)
SELECT probe_id, round(dense_rr, 6) AS dense_rr, round(sparse_rr, 6) AS sparse_rr, round(hybrid_rr, 6) AS hybrid_rr, best_hybrid,
 CASE WHEN dense_rr = 0 AND sparse_rr = 0 THEN 'both_miss' WHEN dense_rr > sparse_rr THEN 'dense_win' WHEN sparse_rr > dense_rr THEN 'sparse_win' ELSE 'tie' END AS dense_vs_sparse,
 CASE WHEN hybrid_rr > dense_rr AND hybrid_rr > sparse_rr THEN 'hybrid_beats_both' WHEN hybrid_rr > dense_rr THEN 'hybrid_beats_dense_only' WHEN hybrid_rr > sparse_rr THEN 'hybrid_beats_sparse_only' WHEN hybrid_rr = greatest(dense_rr, sparse_rr) THEN 'hybrid_equals_best_endpoint' ELSE 'hybrid_worse_than_best_endpoint' END AS hybrid_class FROM z""")
def pairwise_pivot(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pairwise(probe_ranks(spark, d), "dense_only", "sparse_only", [f"normalized_weighted_{round(a * 100):03d}_{round(b * 100):03d}" for a, b in retrieve.NORMALIZED])


@query(f"""{_RANKS}, z AS (SELECT probe_id, max(CASE WHEN variant = 'dense_only' THEN message_rank END) AS d, max(CASE WHEN variant = 'sparse_only' THEN message_rank END) AS p, max(CASE WHEN variant = 'rrf_k60_union_100' THEN message_rank END) AS r, max(CASE WHEN variant = 'current_weighted_065_035' THEN message_rank END) AS c FROM e GROUP BY 1)
SELECT count_if(coalesce(d, 99) <= 20 AND coalesce(p, 99) > 20) AS dense_rescues, count_if(coalesce(p, 99) <= 20 AND coalesce(d, 99) > 20) AS sparse_rescues, count_if(coalesce(d, 99) > 10 AND coalesce(p, 99) > 10 AND coalesce(r, 99) <= 10) AS rrf_rescues,
 count_if(c > 20 AND (coalesce(d, 99) <= 20 OR coalesce(p, 99) <= 20)) AS hybrid_regressions, count_if(coalesce(d, 99) <= 10 AND coalesce(p, 99) > 20) AS dense_only_wins, count_if(coalesce(p, 99) <= 10 AND coalesce(d, 99) > 20) AS sparse_only_wins,
 count_if(coalesce(d, 99) <= 10 AND coalesce(p, 99) <= 10) AS both_hit_10, count_if(coalesce(d, 99) > 20 AND coalesce(p, 99) > 20) AS both_miss_20 FROM z""")
def rescue_analysis(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rescues(probe_ranks(spark, d), "dense_only", "sparse_only", "rrf_k60_union_100", "current_weighted_065_035")


@query(f"""WITH {_SNAP} SELECT p.probe_id, coalesce(min(dr), 0) AS earliest_dense, coalesce(min(pr), 0) AS earliest_sparse, coalesce(min(dr) <= 20, false) AS in_dense_20, coalesce(min(pr) <= 20, false) AS in_sparse_20, coalesce(min(dr) <= 100, false) AS in_dense_100, coalesce(min(pr) <= 100, false) AS in_sparse_100
FROM (SELECT DISTINCT probe_id, expected_message_id FROM real_probes WHERE probe_id IN (SELECT probe_id FROM s)) p LEFT JOIN r ON r.probe_id = p.probe_id AND r.source_message_id = p.expected_message_id GROUP BY 1""")
def candidate_pools(spark: SparkSession, d: str) -> DataFrame:
    s = snapshot(spark, d)
    p = table(spark, d, "real_probes").select("probe_id", F.col("expected_message_id").alias("source_message_id")).distinct().join(s.select("probe_id").distinct(), "probe_id", "left_semi")
    g = p.join(s, ["probe_id", "source_message_id"], "left").groupBy("probe_id").agg(F.min("dense_rank").cast("long").alias("earliest_dense"), F.min("sparse_rank").cast("long").alias("earliest_sparse"))
    g = g.na.fill(0, ["earliest_dense", "earliest_sparse"])  # 0: not found
    inside = [F.col(f"earliest_{b}").between(1, k).alias(f"in_{b}_{k}") for k in (20, 100) for b in ("dense", "sparse")]
    return g.select("*", *inside)


@query(f"""WITH {_SNAP}, x AS (SELECT p.probe_id, r.chunk_id, CASE WHEN r.source_message_id = p.expected_message_id THEN 3 ELSE 1 END AS rel, r.dr FROM (SELECT DISTINCT probe_id, expected_message_id, expected_conversation_id FROM real_probes) p
 JOIN r ON r.probe_id = p.probe_id AND (r.source_message_id = p.expected_message_id OR r.source_conversation_id = p.expected_conversation_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY rel DESC, chunk_id) AS ir FROM x)
SELECT probe_id, round(sum(CASE WHEN dr <= 10 THEN (pow(2, rel) - 1) / log2(dr + 1) ELSE 0 END) / sum(CASE WHEN ir <= 10 THEN (pow(2, rel) - 1) / log2(ir + 1) ELSE 0 END), 6) AS ndcg_10 FROM i GROUP BY 1""")
def ndcg(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "real_probes").select("probe_id", "expected_message_id", "expected_conversation_id").distinct()
    same = F.coalesce(F.col("source_message_id") == F.col("expected_message_id"), F.lit(False))
    x = snapshot(spark, d).join(p, "probe_id").where(same | (F.col("source_conversation_id") == F.col("expected_conversation_id"))).withColumn("relevance", F.when(same, 3).otherwise(1))
    return evaluate.ndcg(x, "probe_id", "relevance", "dense_rank", "chunk_id", 10).select("probe_id", F.round("ndcg", 6).alias("ndcg_10"))
