"""The semantic graph: group nodes with pooled vectors and terms, edges between members, neighbours, parts of context packs."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.ids import stable_id
from ..session import settle, ship


def memberships(rows: DataFrame, key: str, groups: dict[str, str]) -> DataFrame:
    """(group_type, group_id, key): a row joins one group of each type whose column isn't null."""
    found = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(t).alias("group_type"), F.col(c).alias("group_id"))) for t, c in groups.items()]))
    return rows.select(F.explode(found).alias("g"), key).select("g.group_type", "g.group_id", key).distinct()


def mean_vectors(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, mean): mean of each group's vectors at length one; a zero mean stays as it is.

    Summed position by position with partial aggregation.  Groups of unequal lengths are left out.
    """
    fine = rows.where(V.finite(F.col(vector)))
    same = fine.groupBy(*by).agg(F.min(F.size(vector)).alias("_lo"), F.max(F.size(vector)).alias("_hi")).where("_lo = _hi").select(*by)
    parts = fine.join(same, by, "left_semi").select(*by, F.posexplode(vector).alias("_p", "_x")).groupBy(*by, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    mean = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("mean"))  # one entry a dimension
    return mean.withColumn("mean", V.scaled(F.col("mean")))


def top_terms(postings: DataFrame, by: list[str], k: int = 50) -> DataFrame:
    """(by, term, weight, place): each group's terms with their largest weight, the k heaviest."""
    best = postings.groupBy(*by, "term").agg(F.max("weight").alias("weight"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "term"))).where(F.col("place") <= k)


def nodes(members: DataFrame) -> DataFrame:
    """(node_id, node_type, group_id, members) of membership rows."""
    g = members.groupBy("group_type", "group_id").agg(F.count("*").alias("members"))
    return g.select(stable_id("node", F.lit("semantic_node"), F.col("group_type"), F.col("group_id")).alias("node_id"), F.col("group_type").alias("node_type"), "group_id", "members")


def edge_id(a: Column, b: Column, kind: str, policy: str = "v1") -> Column:
    return stable_id("edge", F.lit("edge"), F.least(a, b), F.greatest(a, b), F.lit(kind), F.lit(policy))


def temporal_edges(rows: DataFrame, group: str, key: str, order: list[str]) -> DataFrame:
    """(src, dst, edge_kind, score): edges between rows that follow each other in a group, ends in canonical order."""
    nxt = F.lead(key).over(Window.partitionBy(group).orderBy(*order))
    e = rows.withColumn("_n", nxt).where("_n is not null")
    return e.select(F.least(key, "_n").alias("src"), F.greatest(key, "_n").alias("dst"), F.lit("temporal_neighbor").alias("edge_kind"), F.lit(1.0).alias("score"))


def member_edges(members: DataFrame, vectors: DataFrame, terms: DataFrame, by: list[str], key: str, top_k: int = 10, most: int = 1_000) -> DataFrame:
    """(by, src, dst, edge_kind, score): the top_k most similar pairs of each group (by, key) of 2 to most members that have a vector or terms.

    vectors is (key, space, vector), usable ones, each key once a space; vectors of different spaces
    or lengths aren't compared.  terms is (key, terms), each key once: its terms, each as often as
    it occurs, so that nothing is shuffled for each term.  A branch that a pair lacks counts 0, as in the archive's edge builder; only
    scores above 0 are edges.  A group has at most most members, so one task holds its matrices.
    """
    ship(members.sparkSession)
    terms = terms.where(F.size("terms") > 0)
    have = vectors.select(key).unionByName(terms.select(key)).distinct()
    m = settle(members.dropna(subset=[*by, key]).select(*by, key).distinct().join(have, key, "left_semi"))
    m = m.join(m.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n").between(2, most)).select(*by), by)
    used = m.select(key).distinct()
    part = lambda f: F.transform("_v", lambda x: x[f])
    v = vectors.join(used, key, "left_semi").groupBy(key).agg(F.collect_list(F.struct("space", "vector")).alias("_v")).select(key, part("space").alias("_s"), part("vector").alias("_x"))
    t = terms.join(used, key, "left_semi").select(key, F.col("terms").alias("_t"))
    rows = m.join(v, key, "left").join(t, key, "left")

    def run(group: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(key)
        ids, n = p[key].to_numpy(object), len(p)
        spaces: dict = {}
        for i, (names, xs) in enumerate(zip(p["_s"], p["_x"])):
            for name, x in zip(names if names is not None else (), xs if xs is not None else ()):
                spaces.setdefault((name, len(x)), []).append((i, np.asarray(x, np.float64)))
        dense = np.full((n, n), -np.inf)
        for held in spaces.values():
            at, x = np.ix_([i for i, _ in held], [i for i, _ in held]), np.stack([x for _, x in held])
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            dense[at] = np.maximum(dense[at], x @ x.T)
        dense = np.where(np.isinf(dense), 0.0, dense)
        sparse, where = np.zeros((n, n)), {}
        for i, words in enumerate(p["_t"]):
            if words is not None:
                n_of = Counter(words)
                norm = math.sqrt(sum(c * c for c in n_of.values()))
                for word, c in n_of.items():
                    where.setdefault(word, []).append((i, c / norm))
        for held in where.values():
            if len(held) > 1:
                i, w = np.array([i for i, _ in held]), np.array([w for _, w in held])
                sparse[np.ix_(i, i)] += w[:, None] * w
        a, b = np.triu_indices(n, 1)
        dense, sparse = dense[a, b], sparse[a, b]
        hybrid = np.round(0.65 * dense + 0.35 * sparse, 9)
        top = np.lexsort((b, a, -hybrid))[:top_k]
        top = top[hybrid[top] > 0]
        out = [(*group, ids[a[k]], ids[b[k]], kind, float(s[k])) for k in top for kind, s in (("dense_sim", dense), ("sparse_overlap", sparse), ("hybrid_sim", hybrid)) if round(s[k], 9) > 0]
        return pd.DataFrame(out, columns=[*by, "src", "dst", "edge_kind", "score"])

    return rows.groupBy(*by).applyInPandas(run, ", ".join(f"{c} string" for c in (*by, "src", "dst", "edge_kind")) + ", score double")


def neighbours(edges: DataFrame, seeds: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """(seed, neighbour, score, place): ends of edges that touch a seed, the strongest first; two equi-joins in place of an OR."""
    s = seeds.select(F.col(key).alias("seed")).distinct()
    out = edges.join(s, F.col("src") == F.col("seed")).select("seed", F.col("dst").alias("neighbour"), "score")
    out = out.unionByName(edges.join(s, F.col("dst") == F.col("seed")).select("seed", F.col("src").alias("neighbour"), "score"))
    out = out.groupBy("seed", "neighbour").agg(F.max("score").alias("score"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "neighbour"))).where(F.col("place") <= limit)


def merge_paths(paths: list[DataFrame], by: list[str]) -> DataFrame:
    """Candidates of several paths, each once with its best score; of equal scores the earlier path stays."""
    out = None
    for k, p in enumerate(paths):
        p = p.select(*by, "score").withColumn("path", F.lit(k))
        out = p if out is None else out.unionByName(p)
    best = out.groupBy(*by).agg(F.min(F.struct(-F.col("score"), F.col("path"))).alias("m"))
    return best.select(*by, (-F.col("m.col1")).alias("score"), F.col("m.path").alias("path"))


def within_budget(rows: DataFrame, by: str, key: str, score: str, tokens: str, budget: int) -> DataFrame:
    """(by, key): rows taken by falling score while their tokens fit; one that doesn't fit is passed over, the first always stays.

    What is taken never lets later rows fit better, so the taken rows of one token count are its first
    ones, at most budget / tokens of them; all others are left out before a group's rows, which are
    then about budget x ln(budget) at most, are folded in one array.
    """
    rows = rows.withColumn(tokens, F.greatest(F.lit(1), F.col(tokens).cast("long")))  # a row has one token at least
    size = F.least(F.col(tokens), F.lit(budget + 1))
    w = Window.partitionBy(by, size).orderBy(F.desc(score), F.asc(key))
    fits = lambda t: F.greatest(F.lit(1), F.floor(F.lit(budget) / t))
    rows = rows.where(F.col(tokens).isNotNull() & F.col(score).isNotNull()).withColumn("_p", F.row_number().over(w)).where((F.col("_p") <= budget) & (F.col("_p") <= fits(size)))
    item = F.struct((-F.col(score)).alias("o"), F.col(key).alias("id"), F.col(tokens).cast("long").alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def take(acc: Column, x: Column) -> Column:
        skip = (acc["used"] >= budget) | ((acc["used"] + x["t"] > budget) & (F.size(acc["ids"]) > 0))
        return F.when(skip, acc).otherwise(F.struct((acc["used"] + x["t"]).alias("used"), F.array_append(acc["ids"], x["id"]).alias("ids")))

    g = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("r"))
    return g.select(by, F.explode(F.aggregate("r", start, take, lambda a: a["ids"])).alias(key))
