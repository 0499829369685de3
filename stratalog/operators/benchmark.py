"""Evaluation runs: validation of a probe set, rankings under weight configurations, guards, snapshots and parity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import retrieve

# The weight configurations of a run, and how much worse than sparse alone a guarded variant's reciprocal rank may be.
CONFIGS = (
    ("dense_100_sparse_000", 1.0, 0.0), ("dense_080_sparse_020", 0.8, 0.2), ("dense_065_sparse_035", 0.65, 0.35), ("dense_050_sparse_050", 0.5, 0.5),
    ("dense_035_sparse_065", 0.35, 0.65), ("dense_020_sparse_080", 0.2, 0.8), ("dense_000_sparse_100", 0.0, 1.0),
)
GUARD = 0.01


def errors(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, error): a row for each rule that a row breaks; a rule is a condition that is true where it is broken."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return df.select(F.col(key), F.explode(found).alias("error"))


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(attribute, value, rows): how often each value of each column occurs, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.attribute", "p.value").agg(F.count("*").alias("rows"))


def run(scored: DataFrame, query: str, key: str, k: int, configs=CONFIGS) -> DataFrame:
    """(config, query, key, score, place): the first k rows of each query under every weighting of its raw scores.

    Scores are read once; a row's scores under all configurations are an array that is exploded.
    """
    each = F.array(*[F.struct(F.lit(name).alias("config"), F.round(F.col("dense_score") * a + F.col("sparse_score") * b, 9).alias("score")) for name, a, b in configs])
    rows = scored.select(query, key, F.explode(each).alias("c")).select("c.config", query, key, "c.score")
    return retrieve.top_rows(rows, ["config", query], [F.desc("score"), F.asc(key)], k)


def guarded_best(metrics: DataFrame, baseline: str = "sparse_only") -> DataFrame:
    """The variant with the best recall at 20, then at 10, then reciprocal rank, among those that aren't worse than the baseline.

    metrics holds one row a variant: message_recall_10, message_recall_20, message_mrr.
    """
    base = metrics.where(F.col("variant") == baseline).select(*[F.col(f"message_{c}").alias(f"_{c}") for c in ("recall_10", "recall_20", "mrr")])
    fine = (F.col("message_recall_10") >= F.col("_recall_10")) & (F.col("message_recall_20") >= F.col("_recall_20")) & (F.col("message_mrr") >= F.col("_mrr") - GUARD)
    ok = metrics.crossJoin(F.broadcast(base)).where(fine).select(*metrics.columns)  # one row with a few variants
    verdict = F.when(F.col("variant") == baseline, "PASS WITH WARNINGS").otherwise("PASS")
    return ok.orderBy(F.desc("message_recall_20"), F.desc("message_recall_10"), F.desc("message_mrr"), F.desc("variant")).limit(1).withColumn("verdict", verdict)


def raw_snapshot(scored: DataFrame, query: str, key: str, k: int | None = None) -> DataFrame:
    """scored with both ranks taken anew; with k, only rows among the first k of either branch."""
    out = retrieve.ranked(retrieve.ranked(scored, query, "dense_score", key, "dense_rank"), query, "sparse_score", key, "sparse_rank")
    return out if k is None else out.where((F.col("dense_rank") <= k) | (F.col("sparse_rank") <= k))


def parity(a: DataFrame, b: DataFrame, query: str, key: str, score: str) -> DataFrame:
    """(query, same_order, overlap, largest_difference) of two rankings (query, key, score, place) of one query set."""
    side = lambda df, s: df.select(query, key, F.col(score).alias(f"_{s}"), F.col("place").alias(f"_p{s}"))
    both = side(a, "a").join(side(b, "b"), [query, key], "full_outer")
    differ = F.max(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.abs(F.col("_a") - F.col("_b"))).otherwise(F.lit(0.0)))
    return both.groupBy(query).agg(F.min(F.coalesce(F.col("_pa") == F.col("_pb"), F.lit(False))).alias("same_order"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("overlap"), differ.alias("largest_difference"))


def vector_parity(df: DataFrame, a: str, b: str) -> Column:
    """A struct of the largest and the mean difference of two vectors, and of one less their cosine."""
    away = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    mean = F.aggregate(away, F.lit(0.0), lambda s, x: s + x) / F.size(away)
    return F.struct(F.array_max(away).alias("largest"), mean.alias("mean"), (1 - V.cosine(F.col(a), F.col(b))).alias("cosine_difference"))


def missing_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only one of two tables has; a run is valid if there are none."""
    only = lambda x, y, s: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").select(key, F.lit(s).alias("side"))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def tail_probes(rows: DataFrame, message: str, text: Column, k: int = 20) -> DataFrame:
    """rows with probe_id and place: the k longest texts, the sampling that gives a small set of probes."""
    w = Window.orderBy(F.desc("_n"), F.asc(message))
    top = rows.withColumn("_n", F.length(text)).orderBy(F.desc("_n"), F.asc(message)).limit(k)
    return top.withColumn("place", F.row_number().over(w)).withColumn("probe_id", F.format_string("auto-%02d", "place")).drop("_n")
