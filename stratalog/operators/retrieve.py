"""Retrieval: exact dense and sparse neighbours in blocks, sparse postings, fusion, ranks and provenance.

Every operator takes a table of queries, so one query is a table of one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import settle, ship
from . import sparse

BLOCK = 4_096  # rows of one matrix
SPARSE_BLOCK, QUERIES_BLOCK = 65_536, 131_072  # rows of terms that are searched at a time, and queries that one task holds
POOL = 500  # candidates of each branch of the hybrid search


def top_rows(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in the given order, with their place; Spark limits each task before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def _packed(df: DataFrame, space: Column, key: str, value: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(_s, _b, ids, sizes, flat), (_s, _n): rows of one space packed into blocks of about block rows, numbered from 0, and the number of blocks."""
    rows = df.select(space.alias("_s"), F.col(key).cast("string").alias("_k"), F.col(value).alias("_v"))
    n = rows.groupBy("_s").agg(F.ceil(F.count("*") / block).cast("long").alias("_n"))
    rows = rows.join(F.broadcast(n), "_s").withColumn("_b", F.pmod(F.xxhash64("_k"), F.col("_n")))
    packed = rows.groupBy("_s", "_b").agg(F.collect_list(F.struct("_k", "_v")).alias("rows"))  # about block rows each
    part = lambda f: F.transform("rows", f)
    return packed.select("_s", "_b", part(lambda r: r["_k"]).alias("ids"), part(lambda r: F.size(r["_v"])).alias("sizes"), F.flatten(part(lambda r: r["_v"])).alias("flat")), n


def _meet(queries: DataFrame, rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block of queries with every block of rows of its space, each such pair by itself.

    Blocks of queries are copied to the blocks of rows, which are joined by space and number: there
    are as many keys as blocks of rows, so no task gets a whole space.
    """
    q = queries.join(F.broadcast(blocks), "_s").select("_s", F.col("ids").alias("qi"), F.col("sizes").alias("qn"), F.col("flat").alias("qf"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b"))
    r = rows.select("_s", "_b", F.col("ids").alias("ri"), F.col("sizes").alias("rn"), F.col("flat").alias("rf"))
    return r.join(q, ["_s", "_b"]).select("qi", "qn", "qf", "ri", "rn", "rf")


def _best(s: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest entries above least, and of all that equal the last of them, so that ties are settled later."""
    m = min(k, s.shape[1])
    edge = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
    return np.nonzero((s >= edge) & (s > least))


def exact_neighbours(queries: DataFrame, rows: DataFrame, key: str, vector: str, space: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query, id, cosine, place): the k rows of a query's space with the highest cosine, ties by id; never the query itself.

    Queries and rows are packed into matrices, and each matrix of queries meets each matrix of
    rows of its space in one product; only k rows a query leave it.  Vectors that are null, empty
    or not finite take no part; a zero vector has cosine 0.
    """
    ship(rows.sparkSession)
    q, _ = _packed(queries.where(V.finite(F.col(vector))), F.col(space), key, vector, block)
    r, n = _packed(rows.where(V.finite(F.col(vector))), F.col(space), key, vector, block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unit(flat, n):
            x = np.asarray(flat, np.float64).reshape(n, -1)
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

        for b in batches:
            for qi, qf, ri, rf in zip(b["qi"], b["qf"], b["ri"], b["rf"]):
                qi, ri = np.asarray(qi, object), np.asarray(ri, object)
                s = np.round(unit(qf, len(qi)) @ unit(rf, len(ri)).T, 9)
                s[qi[:, None] == ri[None]] = -9
                a, c = _best(s, k, -9)
                yield pd.DataFrame({"query": qi[a], "id": ri[c], "cosine": s[a, c]})

    met = _meet(q, r, n).mapInPandas(run, "query string, id string, cosine double")
    return top_rows(met, ["query"], [F.desc("cosine"), F.asc("id")], k)


def sparse_neighbours(queries: DataFrame, rows: DataFrame, query: str, key: str, terms: str, k: int = 10, block: int = SPARSE_BLOCK, queries_block: int = QUERIES_BLOCK, weights: str | None = None) -> DataFrame:
    """(query, key, score, shared, place): the k rows whose terms have the highest cosine with a query's, ties by key; never the query itself.

    terms is an array with each term as often as it occurs (null or empty: no part); with weights,
    an array beside the rows' terms, a row has each term once.  Terms are compared by 64-bit hashes.
    Rows are dealt to as many lanes as tasks run at once; a lane's rows stream past about
    queries_block queries, block rows at a time, and only k rows a query leave a lane, so neither a
    frequent term nor a popular query is gathered in one task.
    """
    found = _sparse_found(queries, rows, query, key, terms, k, block, queries_block, weights, ("columns",)).drop("form")
    return top_rows(found, [query], [F.desc("score"), F.asc(key)], k)


def sparse_forms(queries: DataFrame, rows: DataFrame, query: str, key: str, terms: str, k: int = 10, block: int = SPARSE_BLOCK, queries_block: int = QUERIES_BLOCK) -> DataFrame:
    """(form, query, key, score, shared, place): what sparse_neighbours gives, once by columns of counts and once by single postings in doubles."""
    found = _sparse_found(queries, rows, query, key, terms, k, block, queries_block, None, ("columns", "postings"))
    return top_rows(found, ["form", query], [F.desc("score"), F.asc(key)], k)


def _sparse_found(queries: DataFrame, rows: DataFrame, query: str, key: str, terms: str, k: int, block: int, queries_block: int, weights: str | None, forms: tuple[str, ...]) -> DataFrame:
    """(form, query, key, score, shared): each lane's first k rows of each query."""
    spark = rows.sparkSession
    ship(spark)
    hashed = lambda df, c, w: df.where(F.size(terms) > 0).select(F.col(c).cast("string").alias("_k"), F.transform(terms, lambda t: F.xxhash64(t)).alias("_h"), w.cast("array<double>").alias("_w"))
    asked = settle(hashed(queries, query, F.lit(None)))  # counted, then searched
    groups, lanes = max(1, -(-asked.count() // queries_block)), spark.sparkContext.defaultParallelism
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n: F.pmod(F.xxhash64("_k"), F.lit(n)).cast("int")
    q = asked.select(every(lanes).alias("_l"), at(groups).alias("_g"), F.lit(0).alias("_kind"), "_k", "_h", "_w")
    r = hashed(rows, key, F.col(weights) if weights else F.lit(None)).select(at(lanes).alias("_l"), every(groups).alias("_g"), F.lit(1).alias("_kind"), "_k", "_h", "_w")
    both = q.unionByName(r).select((F.col("_g") * lanes + F.col("_l")).cast("int").alias("_p"), "_kind", "_k", "_h", "_w")
    dealt = both.repartitionById(lanes * groups, "_p").sortWithinPartitions("_p", "_kind", "_k")
    run = sparse.searched(["form", query, key, "score", "shared"], k, block, forms)
    return dealt.mapInArrow(run, f"form string, `{query}` string, `{key}` string, score double, shared long")


def term_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): the share of each term among a text's terms: the sparse vector as postings."""
    t = df.select(F.col(key), F.explode(V.terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    total = df.select(F.col(key), F.size(V.terms(F.col(text))).alias("all"))
    return t.join(total, key).select(key, "term", (F.col("n") / F.col("all")).alias("weight"))


def sparse_scores(queries: DataFrame, postings: DataFrame, query: str, key: str) -> DataFrame:
    """(query, key, score, shared): cosine of sparse vectors (query|key, term, weight) that share a term.

    A query's norm counts all its terms, also those that no row holds.
    """
    qn = queries.groupBy(query).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("qn"))
    pn = postings.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("pn"))
    q = queries.select(query, "term", F.col("weight").alias("qw"))
    both = q.join(postings, "term").groupBy(query, key).agg(F.sum(F.col("qw") * F.col("weight")).alias("dot"), F.count("*").alias("shared"))
    return both.join(qn, query).join(pn, key).select(query, key, (F.col("dot") / (F.col("qn") * F.col("pn"))).alias("score"), "shared")


def ranked(df: DataFrame, group: str, score: str, key: str, name: str = "rank") -> DataFrame:
    """df with the place of each row in its group by falling score, ties by key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))))


def candidate_union(dense: DataFrame, sparse: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either branch, once, with the scores of both; null where a branch lacks the row."""
    return dense.join(sparse, keys, "full_outer")


# --------------------------------------------------------------------------- fusion variants

POOLS = (20, 50, 100)
NORMALIZED = ((0.8, 0.2), (0.65, 0.35), (0.5, 0.5), (0.35, 0.65), (0.2, 0.8))
RRF_K = 60


def variants() -> list[tuple[str, str, float, float, int]]:
    """(id, kind, dense weight, sparse weight, pool) of every fusion variant; pool 0 is all rows."""
    out = [("dense_only", "raw", 1.0, 0.0, 0), ("sparse_only", "raw", 0.0, 1.0, 0), ("current_weighted_065_035", "raw", 0.65, 0.35, 0)]
    out += [(f"normalized_weighted_{round(d * 100):03d}_{round(s * 100):03d}", "normalized", d, s, 0) for d, s in NORMALIZED]
    for p in POOLS:
        out += [(f"rrf_k{RRF_K}_union_{p}", "rrf", 0.0, 0.0, p), (f"sparse_first_bonus_union_{p}", "sparse_first", 0.0, 0.0, p), (f"normalized_union_{p}", "normalized", 0.2, 0.8, p)]
    return out


def fused(rows: DataFrame, query: str, dense: str = "dense_score", sparse: str = "sparse_score", dense_rank: str = "dense_rank", sparse_rank: str = "sparse_rank") -> DataFrame:
    """rows once for each fusion variant that ranks them, with columns variant and score.

    One pass: maxima come from one window over the query, and a row's scores of all variants are
    an array that is exploded.
    """
    w = Window.partitionBy(query)
    top = lambda c: F.when(F.max(c).over(w) == 0, F.lit(1.0)).otherwise(F.max(c).over(w))
    d, s = F.col(dense), F.col(sparse)
    rows = rows.withColumn("_dm", top(dense)).withColumn("_sm", top(sparse))
    scores = []
    for name, kind, a, b, pool in variants():
        ind = (F.col(dense_rank) <= pool) if pool else F.lit(True)
        ins = (F.col(sparse_rank) <= pool) if pool else F.lit(True)
        if kind == "raw":
            v = d * a + s * b
        elif kind == "rrf":
            v = F.when(ind | ins, F.when(ind, 1.0 / (F.col(dense_rank) + RRF_K)).otherwise(0.0) + F.when(ins, 1.0 / (F.col(sparse_rank) + RRF_K)).otherwise(0.0))
        elif kind == "sparse_first":
            v = F.when(ins, s / F.col("_sm") + 0.10 * d / F.col("_dm"))
        else:
            v = F.when(ind | ins, a * d / F.col("_dm") + b * s / F.col("_sm"))
        scores.append(F.struct(F.lit(name).alias("variant"), v.alias("score")))
    out = rows.withColumn("_v", F.explode(F.array(*scores))).where(F.col("_v.score").isNotNull())
    return out.select(*[c for c in rows.columns if c not in ("_dm", "_sm")], F.col("_v.variant").alias("variant"), F.col("_v.score").alias("score"))


def hybrid(dense: DataFrame, sparse: DataFrame, query: str, key: str, alpha: float = 0.65, beta: float = 0.35, pool: int = POOL, limit: int = 10) -> DataFrame:
    """(query, key, dense, sparse, fused, reason, place): weighted fusion of the pools of both branches.

    dense and sparse are (query, key, score); the first pool rows of each branch by score and key
    are candidates, sparse ones only above 0; a branch without the row counts 0.
    """
    by = [F.desc("score"), F.asc(key)]
    d = top_rows(dense, [query], by, pool).select(query, key, F.col("score").alias("dense"))
    s = top_rows(sparse.where("score > 0"), [query], by, pool).select(query, key, F.col("score").alias("sparse"))
    both = candidate_union(d, s, [query, key]).select(query, key, F.coalesce("dense", F.lit(0.0)).alias("dense"), F.coalesce("sparse", F.lit(0.0)).alias("sparse"))
    both = both.withColumn("fused", V.weighted(F.col("dense"), F.col("sparse"), alpha, beta))
    reason = F.when((F.col("dense") > 0) & (F.col("sparse") > 0), "dense and sparse").when(F.col("sparse") > 0, "sparse").when(F.col("dense") > 0, "dense").otherwise("none")
    return top_rows(both.withColumn("reason", reason), [query], [F.desc("fused"), F.asc(key)], limit)


def with_provenance(hits: DataFrame, chunks: DataFrame, blocks: DataFrame, messages: DataFrame, conversations: DataFrame, key: str = "chunk_id") -> DataFrame:
    """hits with the block, message and conversation of their chunk; only what was found is joined with text."""
    c = chunks.select(F.col("id").alias(key), "block_id", F.col("source_char_start").alias("char_start"), F.col("source_char_end").alias("char_end"), F.col("text").alias("chunk_text")).dropDuplicates([key])
    b = blocks.select(F.col("id").alias("block_id"), "message_id", "block_type").dropDuplicates(["block_id"])
    m = messages.select(F.col("id").alias("message_id"), "conversation_id", F.col("ordinal").alias("message_ordinal"), "role", "time_utc").dropDuplicates(["message_id"])
    v = conversations.select(F.col("id").alias("conversation_id"), "title", "project_id", "update_time_utc").dropDuplicates(["conversation_id"])
    return hits.join(c, key).join(b, "block_id").join(m, "message_id").join(v, "conversation_id")
