"""The queries of the training-data operators over whole tables; each takes (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from ..sources.tables import table
from . import borda, conversations, encoding, langid, mixing, neardup, pii, postings, residue, topn


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    closed = conversations.replay(spark, f"{d}/messages.parquet", with_text=False)
    return conversations.unreadable(table(spark, d, "conversations"), closed)


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = conversations.rebuilt(conversations.replay(spark, f"{d}/messages.parquet"))
    return turns.withColumn("turn", F.col("turn").cast("long"))


SCORES = ["dense_score", "sparse_score", "final_score"]


def _three_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rows of snapshot_rows and of native_retrieval_hits with the three scores; a chunk of the hits alone is no item (here)."""
    none = lambda c: F.lit(None).cast("double").alias(c)
    snap = table(spark, d, "snapshot_rows").select("probe_id", "chunk_id", "dense_score", "sparse_score", none("final_score"), F.lit(True).alias("here"))
    hits = table(spark, d, "native_retrieval_hits").select("probe_id", "chunk_id", none("dense_score"), none("sparse_score"), "final_score", F.lit(False).alias("here"))
    return snap.unionByName(hits)


def p2_points(spark: SparkSession, d: str) -> DataFrame:
    return borda.combine(_three_scores(spark, d), "probe_id", "chunk_id", SCORES, member="here")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    points = borda.combine(_three_scores(spark, d), "probe_id", "chunk_id", SCORES, missing="none", member="here")
    # the first of a group is a minimum, combined before any shuffle
    return points.where("n >= 30").groupBy("probe_id").agg(F.min(F.struct((-F.col("points")).alias("o"), "chunk_id")).alias("m")).select("probe_id", "m.chunk_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").select("id", F.col("raw_text").alias("text"), F.lit("messages").alias("of"))
    return m.unionByName(table(spark, d, "retrieval_chunks").select("id", "text", F.lit("retrieval_chunks").alias("of")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(_texts(spark, d), "id", "text", 0.6, 3, 40, "of").select("id_a", "id_b").distinct()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = settle(neardup.classes(_texts(spark, d), "id", "text", 0.6, 3, 40, "of"))
    # a class is named by its smallest id; names are combined before they are joined back
    return rows.join(rows.groupBy("kind", "class").agg(F.min("id").alias("name")), ["kind", "class"]).select("kind", "id", F.col("name").alias("class"), "links")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return postings.neighbours(table(spark, d, "dense_native_metadata"), "chunk_id", "embedding_space_id", "vector", "dim", "rowid", 5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = p4_neighbours(spark, d).where("cosine >= 0.9")
    return near.select(F.least("chunk_id", "other").alias("chunk_a"), F.greatest("chunk_id", "other").alias("chunk_b")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    dicts = langid.dictionaries(table(spark, d, "documents"))
    probes = langid.wrong_labels(table(spark, d, "real_probes"), "probe_id", "query", "query_language", dicts)
    runs = langid.runs(table(spark, d, "messages"), "id", "raw_text", dicts).where("lang is not null and words >= 8 and all_words >= 12")
    return probes.select(F.col("probe_id").alias("record_id"), "lang").unionByName(runs.select(F.col("id").alias("record_id"), "lang")).distinct()


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    dicts = langid.dictionaries(table(spark, d, "documents"))
    runs = langid.runs(table(spark, d, "messages"), "id", "raw_text", dicts)
    return runs.select("id", "nth", "lang", F.round("confidence", 6).alias("confidence"), "words", "start", "end").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "messages"), "id", "raw_text").select("id", "pii_type", "nth").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "messages"), "id", "raw_text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "native_retrieval_hits"), "probe_id", "chunk_id", "final_score", 10).select("probe_id", "chunk_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    sizes = encoding.encode(table(spark, d, "documents"), "doc_id", "text", only_count=True, keep=("source",))
    return mixing.mix(sizes, table(spark, d, "source_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(settle(_mixture(spark, d)), table(spark, d, "source_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.score(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "text", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = "p1_found p1_conversations p2_found p2_points p3_found p3_classes p4_found p4_neighbours p5_found p5_languages p6_found p6_redacted p7_found p8_ids p9_mixture p9_shares p10_found p10_clean"
    return {n: globals()[n] for n in names.split()}
