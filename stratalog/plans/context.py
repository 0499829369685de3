"""Queries of context packs and of context for a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import assemble, context, graph, retrieve
from ..sources.tables import table
from .archive import _MEMBERS, _TEMP, _members, temporal_edges
from .registry import query
from .retrieval import _SPARSE, chunk_term_lists

BUDGET = 600  # tokens of a pack


def _node_key():
    return F.concat_ws(":", "group_type", "group_id")


_PACK = f"""WITH RECURSIVE {_SPARSE}, bl AS (SELECT id AS block_id, greatest(1, (source_char_end - source_char_start + 3) // 4) AS tokens FROM (SELECT DISTINCT id, source_char_start, source_char_end FROM blocks)),
cb AS (SELECT DISTINCT id AS chunk_id, block_id FROM retrieval_chunks), dh AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, chunk_id) <= 10),
d AS (SELECT probe_id, block_id, max(0.35 * score) AS score FROM dh JOIN cb USING (chunk_id) GROUP BY ALL), {_MEMBERS},
pt AS (SELECT group_type || ':' || group_id AS node, term, max(weight) AS weight FROM mb JOIN w USING (chunk_id) GROUP BY ALL), tt AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, term) <= 50),
tn AS (SELECT node, sqrt(sum(weight * weight)) AS l FROM tt GROUP BY 1), ns AS (SELECT probe_id, node, 0.35 * round(sum(qw.weight * tt.weight) / (any_value(q2.l) * any_value(tn.l)), 9) AS score FROM qw JOIN tt USING (term) JOIN q2 USING (probe_id) JOIN tn USING (node) GROUP BY 1, 2),
nh AS (SELECT * FROM ns QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, node) <= 5),
nm AS (SELECT DISTINCT group_type || ':' || group_id AS node, block_id, tokens FROM mb JOIN cb USING (chunk_id) JOIN bl USING (block_id)), mt AS (SELECT * FROM nm QUALIFY row_number() OVER (PARTITION BY node ORDER BY tokens DESC, block_id) <= 5),
m AS (SELECT probe_id, block_id, score FROM nh JOIN mt USING (node)), sd AS (SELECT probe_id, block_id FROM d UNION SELECT probe_id, block_id FROM m), e AS (SELECT DISTINCT * FROM {_TEMP}),
nb AS (SELECT probe_id, dst AS block_id FROM e JOIN sd ON sd.block_id = e.src UNION SELECT sd.probe_id, src FROM e JOIN sd ON sd.block_id = e.dst WHERE NOT EXISTS (SELECT 1 FROM sd z WHERE z.probe_id = sd.probe_id AND z.block_id = e.src)),
nt AS (SELECT probe_id, block_id, 0.5 AS score FROM nb QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY block_id) <= 5),
al AS (SELECT probe_id, block_id, CAST(score AS DOUBLE) AS score, 0 AS path FROM d UNION ALL SELECT probe_id, block_id, score, 1 FROM m UNION ALL SELECT probe_id, block_id, score, 2 FROM nt),
g AS (SELECT probe_id, block_id, round(max(score), 9) AS score, arg_min(path, (-score, path)) AS path FROM al GROUP BY ALL),
o AS (SELECT g.*, tokens, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, block_id) AS rn FROM g JOIN bl USING (block_id)),
f AS (SELECT probe_id, block_id, score, path, tokens, rn, tokens AS used, true AS taken FROM o WHERE rn = 1 UNION ALL SELECT o.probe_id, o.block_id, o.score, o.path, o.tokens, o.rn, CASE WHEN f.used < {BUDGET} AND f.used + o.tokens <= {BUDGET} THEN f.used + o.tokens ELSE f.used END, f.used < {BUDGET} AND f.used + o.tokens <= {BUDGET} FROM f JOIN o ON o.probe_id = f.probe_id AND o.rn = f.rn + 1)
SELECT probe_id, block_id, round(score, 6) AS score, ['{context.DIRECT}', '{context.MEMBER}', '{context.NEIGHBOUR}'][path + 1] AS path, CAST(tokens AS BIGINT) AS tokens FROM f WHERE taken"""


def _node_terms(spark: SparkSession, d: str, members: DataFrame) -> DataFrame:
    """(node_id, terms, weights): the 50 heaviest terms of each node of members (node_id, chunk_id), by their largest share of a chunk's terms.

    A chunk's terms are counted where its text was gathered and then go to all its nodes, so that no postings are shuffled by chunk.
    """
    of = members.groupBy("chunk_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))  # a conversation and a project
    lists = chunk_term_lists(spark, d).join(of, "chunk_id").select("chunk_id", "nodes", F.size("terms").alias("all"), F.explode("terms").alias("term"))
    shares = lists.groupBy("chunk_id", "nodes", "all", "term").agg(F.count("*").alias("n"))
    top = graph.top_terms(shares.select(F.explode("nodes").alias("node_id"), "term", (F.col("n") / F.col("all")).alias("weight")), ["node_id"], 50)
    packed = top.groupBy("node_id").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    return packed.select("node_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))


@query(_PACK)
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """The context pack of every probe, scored by terms: direct hits, members of conversations and projects, neighbours."""
    asked = table(spark, d, "real_probes").select(F.col("probe_id").alias("query"), V.terms(F.col("query")).alias("terms"))
    chunk_block = table(spark, d, "retrieval_chunks").select(F.col("id").alias("chunk_id"), "block_id").distinct()
    members = _members(spark, d).withColumn("node_id", _node_key())
    nodes = retrieve.sparse_neighbours(asked, _node_terms(spark, d, members), "query", "node_id", "terms", 5, weights="weights").select("query", "node_id", (F.col("score") * 0.35).alias("score"))
    hits = retrieve.sparse_neighbours(asked, chunk_term_lists(spark, d), "query", "chunk_id", "terms", 10)
    direct = hits.join(chunk_block, "chunk_id").groupBy("query", "block_id").agg(F.max(F.col("score") * 0.35).alias("score"))
    sizes = table(spark, d, "blocks").select(F.col("id").alias("block_id"), F.greatest(F.lit(1), F.floor((F.col("source_char_end") - F.col("source_char_start") + 3) / 4)).cast("long").alias("tokens")).distinct()
    own = members.join(chunk_block, "chunk_id").select("node_id", "block_id").distinct().join(sizes, "block_id").withColumn("weight", F.lit(1.0))
    edges = temporal_edges(spark, d).select("src", "dst", F.col("score").alias("weight"))
    pack = context.context_pack(direct, nodes, own, edges, sizes, BUDGET)
    return pack.select(F.col("query").alias("probe_id"), "block_id", F.round("score", 6).alias("score"), "path", "tokens")


def _found(spark: SparkSession, d: str) -> DataFrame:
    """(probe_id, chunk_id, score, message_id, conversation_id): the chunks among the first 30 of any expanded query of a probe, each with its best score.

    Texts take no part, and a probe's rows stay in one partition for the windows that follow.
    """
    asked = context.expanded(table(spark, d, "real_probes").groupBy("probe_id").agg(F.min("query").alias("query")), "probe_id", "query")
    asked = asked.select(F.concat_ws("#", "probe_id", "n").alias("q"), V.terms(F.col("asked")).alias("terms"))
    hits = retrieve.sparse_neighbours(asked, chunk_term_lists(spark, d), "q", "chunk_id", "terms", 30)
    hits = hits.select(F.expr("left(q, length(q) - 2)").alias("probe_id"), "chunk_id", "score")  # n is 0 to 3
    c = table(spark, d, "retrieval_chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.min("block_id").alias("block_id"))
    b = table(spark, d, "blocks").select(F.col("id").alias("block_id"), "message_id").distinct()
    m = table(spark, d, "messages").groupBy(F.col("id").alias("message_id")).agg(F.min("conversation_id").alias("conversation_id")).where("conversation_id is not null")
    placed = c.join(b, "block_id").join(m, "message_id")
    return hits.join(placed, "chunk_id").repartition("probe_id").groupBy("probe_id", "chunk_id", "message_id", "conversation_id").agg(F.max("score").alias("score"))


_MT = "list_distinct(list_filter(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_.-]{3,}'), lambda t: NOT regexp_full_match(t, '\\p{N}+')))"


@query()
def construct_archive_context(spark: SparkSession, d: str) -> DataFrame:
    """Context for every probe: expanded queries, the best messages of the best conversations, cut to the budget."""
    best = assemble.diverse_messages(_found(spark, d), "probe_id", 6, 3)
    rows = retrieve.top_rows(best, ["probe_id"], [F.desc("score"), F.asc("chunk_id")], 18)
    texts = table(spark, d, "retrieval_chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.min("text").alias("text"))
    rows = rows.select("probe_id", "place", "message_id", "chunk_id").join(texts, "chunk_id")  # only what was chosen
    out = assemble.broad(rows.select("probe_id", "place", "message_id", "text"), "probe_id", 300)
    return out.select("probe_id", "message_id", F.col("place").cast("long").alias("place"), "text", F.col("tokens").cast("long").alias("tokens"))


@query(f"""WITH p AS (SELECT probe_id, min(query) AS query FROM real_probes GROUP BY 1), x AS (SELECT probe_id, query, {_MT.replace("list_distinct(", "(")} AS a FROM p),
y AS (SELECT probe_id, query, array_to_string(list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda z: list_position(a, z[1]) = z[2])[1:8], lambda z: z[1]), ' ') AS t FROM x WHERE trim(query) <> ''),
u AS (SELECT probe_id, query AS asked FROM y UNION SELECT probe_id, t FROM y WHERE t <> '' UNION SELECT probe_id, t || ' {context.DECISIONS}' FROM y UNION SELECT probe_id, t || ' {context.PREFERENCES}' FROM y) SELECT probe_id, asked FROM u""")
def expanded_queries(spark: SparkSession, d: str) -> DataFrame:
    """The queries that each probe is expanded to."""
    return context.expanded(table(spark, d, "real_probes").groupBy("probe_id").agg(F.min("query").alias("query")), "probe_id", "query").select("probe_id", "asked")
