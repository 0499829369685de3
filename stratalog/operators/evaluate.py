"""Evaluation of rankings: ranks of what was expected, recall, reciprocal rank, nDCG, breakdowns and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

FAR = 99


def probe_ranks(scored: DataFrame, probes: DataFrame) -> DataFrame:
    """One row for each variant and probe: the ranks of the expected message's best chunk, of the message and of the conversation.

    scored is (variant, probe_id, chunk_id, source_message_id, source_conversation_id, score).  A
    message or conversation counts with its best chunk; a rank is null where nothing was found.
    """
    at = F.struct((-F.col("score")).alias("o"), F.col("chunk_id").alias("c"))
    rows = scored.select("variant", "probe_id", "source_message_id", "source_conversation_id", at.alias("at"))
    by = ["variant", "probe_id"]

    def place(best: DataFrame, mine: DataFrame, name: str) -> DataFrame:
        """One more than the rows of best that come before a probe's own; counted before the shuffle, so no probe is sorted in one task."""
        return best.join(mine, by).groupBy(*by).agg((F.count_if(F.col("at") < F.col("mine")) + 1).alias(name))

    def groups(c: str, expected: str) -> tuple[DataFrame, DataFrame]:
        best = rows.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.min("at").alias("at"))
        own = probes.select("probe_id", F.col(expected).alias(c)).distinct()
        return best, best.join(own, ["probe_id", c]).select(*by, F.col("at").alias("mine"))

    messages, message = groups("source_message_id", "expected_message_id")
    conversations, conversation = groups("source_conversation_id", "expected_conversation_id")
    known = scored.select("probe_id").distinct()
    out = probes.join(known, "probe_id", "left_semi").crossJoin(F.broadcast(scored.select("variant").distinct()))  # a few variants
    for best, mine, name in ((rows, message, "chunk_rank"), (messages, message, "message_rank"), (conversations, conversation, "conversation_rank")):
        out = out.join(place(best, mine, name), by, "left")
    return out


def _at(rank: str, k: int):
    return F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0))


def retrieval_metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    r = [F.round(_at(f"{n}_rank", k), 6).alias(f"{n}_recall_{k}") for n, ks in (("chunk", (1, 5, 10, 20)), ("message", (1, 5, 10, 20)), ("conversation", (10, 20))) for k in ks]
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("message_rank"), F.lit(0.0))), 6)
    return ranks.groupBy(*by).agg(F.count("*").alias("probes"), *r, mrr.alias("message_mrr"), F.median("message_rank").alias("median_message_rank"), F.count_if(F.coalesce("message_rank", F.lit(FAR)) > 20).alias("misses_20"))


def breakdown(ranks: DataFrame, dimensions: list[str]) -> DataFrame:
    """Metrics for each value of each dimension, in one pass over grouping sets."""
    sets = [[F.col("variant"), F.col(c)] for c in dimensions]
    g = ranks.groupingSets(sets, F.col("variant"), *[F.col(c) for c in dimensions])
    out = g.agg(F.count("*").alias("probes"), F.round(_at("message_rank", 10), 6).alias("recall_10"), F.round(F.avg(F.coalesce(1.0 / F.col("message_rank"), F.lit(0.0))), 6).alias("mrr"), *[F.grouping(c).alias(f"_{c}") for c in dimensions])
    name = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in dimensions])
    value = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.col(c)) for c in dimensions])
    return out.select("variant", name.alias("dimension"), value.alias("value"), "probes", "recall_10", "mrr", (F.col("probes") < 10).alias("small_sample"))


def pairwise(ranks: DataFrame, dense: str, sparse: str, hybrids: list[str]) -> DataFrame:
    """For each probe: reciprocal ranks of both branches and of the best hybrid, and which wins."""
    r = ranks.select("probe_id", "variant", F.coalesce(1.0 / F.col("message_rank"), F.lit(0.0)).alias("rr"))
    of = lambda v: F.max(F.when(F.col("variant") == v, F.col("rr")))
    hy = F.col("variant").isin(*hybrids)
    g = r.groupBy("probe_id").agg(of(dense).alias("d"), of(sparse).alias("s"), F.max(F.when(hy, F.col("rr"))).alias("h"), F.min(F.when(hy, F.struct(-F.col("rr"), F.col("variant")))).alias("b"))
    d, s, h = F.col("d"), F.col("s"), F.col("h")
    versus = F.when((d == 0) & (s == 0), "both_miss").when(d > s, "dense_win").when(s > d, "sparse_win").otherwise("tie")
    mixed = F.when((h > d) & (h > s), "hybrid_beats_both").when(h > d, "hybrid_beats_dense_only").when(h > s, "hybrid_beats_sparse_only").when(h == F.greatest(d, s), "hybrid_equals_best_endpoint").otherwise("hybrid_worse_than_best_endpoint")
    return g.select("probe_id", F.round("d", 6).alias("dense_rr"), F.round("s", 6).alias("sparse_rr"), F.round("h", 6).alias("hybrid_rr"), F.col("b.variant").alias("best_hybrid"), versus.alias("dense_vs_sparse"), mixed.alias("hybrid_class"))


def rescues(ranks: DataFrame, dense: str, sparse: str, rrf: str, current: str) -> DataFrame:
    """How often one branch or the fusion finds what another misses."""
    of = lambda v, n: F.max(F.when(F.col("variant") == v, F.col("message_rank"))).alias(n)
    z = ranks.groupBy("probe_id").agg(of(dense, "d"), of(sparse, "p"), of(rrf, "r"), of(current, "c")).na.fill(FAR, ["d", "p", "r"])
    d, p, r, c = (F.col(x) for x in "dprc")
    n = lambda cond, name: F.count_if(cond).alias(name)
    return z.agg(
        n((d <= 20) & (p > 20), "dense_rescues"), n((p <= 20) & (d > 20), "sparse_rescues"), n((d > 10) & (p > 10) & (r <= 10), "rrf_rescues"),
        n((c > 20) & ((d <= 20) | (p <= 20)), "hybrid_regressions"), n((d <= 10) & (p > 20), "dense_only_wins"), n((p <= 10) & (d > 20), "sparse_only_wins"),
        n((d <= 10) & (p <= 10), "both_hit_10"), n((d > 20) & (p > 20), "both_miss_20"),
    )


def ndcg(rows: DataFrame, query: str, relevance: str, rank: str, key: str, k: int) -> DataFrame:
    """(query, ndcg): gain of the expected rows at their ranks over the best possible gain."""
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(relevance), F.asc(key)))
    g = lambda r: F.sum(F.when(F.col(r) <= k, V.gain(F.col(relevance), F.col(r))).otherwise(0.0))
    return rows.withColumn("_i", ideal).groupBy(query).agg((g(rank) / g("_i")).alias("ndcg"))
