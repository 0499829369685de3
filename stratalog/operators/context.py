"""Context for a question: direct hits, members of the best nodes and graph neighbours merged into one budgeted pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settle
from . import graph, retrieve

# The paths' names, what a neighbour's weight counts, and the words that ask for decisions and preferences.
DIRECT, MEMBER, NEIGHBOUR, NEIGHBOUR_SHARE = "query -> block direct", "query -> node -> member block", "query -> block -> neighbor", 0.5
DECISIONS, PREFERENCES = "decision decision accepted final", "preference prefer avoid"
STRATEGIES = ("auto", "basement", "semantic_groups")


def strategy(asked: str, groups: bool, vectors: bool) -> str:
    """The retrieval strategy that can be used: semantic groups need groups and their vectors, else the basement is searched."""
    if asked not in STRATEGIES:
        raise ValueError(f"a strategy is one of {', '.join(STRATEGIES)}")
    return "semantic_groups" if asked != "basement" and groups and vectors else "basement"


def capabilities(**tables: DataFrame) -> dict[str, bool]:
    """Whether each of the named tables has a row."""
    return {f"has_{name}": not df.isEmpty() for name, df in tables.items()}


def best_members(members: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """(query, block_id, score): the first members (node_id, block_id, weight, tokens) of each query's nodes (query, node_id, score).

    Members go by weight, then by tokens, then by id; they are cut to limit a node before the join.
    """
    order = [F.desc("weight"), F.desc("tokens"), F.asc("block_id")]
    top = retrieve.top_rows(members.join(nodes.select("node_id").distinct(), "node_id", "left_semi"), ["node_id"], order, limit)
    return nodes.join(top, "node_id").select("query", "block_id", (F.col("score") * F.col("weight")).alias("score"))


def seed_neighbours(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """(query, block_id, score): the blocks on the other end of edges (src, dst, weight) of each query's seeds (query, block_id), heaviest first.

    Of an edge between two seeds only the later end counts.
    """
    s = seeds.select("query", "block_id").distinct()
    out = edges.join(s, F.col("src") == F.col("block_id")).select("query", F.col("dst").alias("block_id"), "weight", F.col("src").alias("other"))
    back = edges.join(s, F.col("dst") == F.col("block_id")).select("query", F.col("src").alias("block_id"), "weight", F.col("dst").alias("other"))
    back = back.join(s, ["query", "block_id"], "left_anti")
    near = out.unionByName(back).groupBy("query", "block_id").agg(F.max("weight").alias("weight"))
    top = retrieve.top_rows(near, ["query"], [F.desc("weight"), F.asc("block_id")], limit)
    return top.select("query", "block_id", (F.col("weight") * NEIGHBOUR_SHARE).alias("score"))


def context_pack(direct: DataFrame, nodes: DataFrame, members: DataFrame, edges: DataFrame, sizes: DataFrame, budget: int = 4_000, member_limit: int = 5, neighbour_limit: int = 5) -> DataFrame:
    """(query, block_id, score, path, tokens): the blocks of each query's context pack.

    direct is (query, block_id, score), nodes (query, node_id, score), members (node_id, block_id,
    weight, tokens), edges (src, dst, weight), sizes (block_id, tokens).  A block found by several
    paths keeps its best score, of equal ones that of the earlier path; blocks are taken by score
    while they fit into the budget, the first always.
    """
    direct, own = settle(direct), settle(best_members(members, settle(nodes), member_limit))  # each is needed twice
    seeds = direct.select("query", "block_id").unionByName(own.select("query", "block_id")).distinct()
    near = seed_neighbours(edges, seeds, neighbour_limit)
    merged = graph.merge_paths([direct, own, near], ["query", "block_id"]).join(sizes, "block_id")
    merged = merged.withColumn("score", F.round("score", 9))
    kept = graph.within_budget(merged, "query", "block_id", "score", "tokens", budget)
    path = F.element_at(F.array(F.lit(DIRECT), F.lit(MEMBER), F.lit(NEIGHBOUR)), F.col("path") + 1)
    return merged.join(kept, ["query", "block_id"]).select("query", "block_id", "score", path.alias("path"), F.col("tokens").cast("long").alias("tokens"))


def expanded(df: DataFrame, query: str, text: str, decisions: bool = True, preferences: bool = True) -> DataFrame:
    """(query, n, asked): up to four queries of each context: itself, its first eight terms, and these with words for decisions and preferences."""
    terms = F.array_join(F.slice(T.meaningful_terms(F.col(text)), 1, 8), " ")
    more = [F.when((terms != "") & (terms != F.col(text)), terms)]
    more += [F.concat(terms, F.lit(f" {DECISIONS}"))] if decisions else []
    more += [F.concat(terms, F.lit(f" {PREFERENCES}"))] if preferences else []
    asked = F.array_distinct(F.array_compact(F.array(F.col(text), *more)))
    return df.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(query, F.posexplode(asked).alias("n", "asked"))


def bounded(value: Column | int, low: int, high: int) -> Column:
    """value, or an error where it is out of its bounds."""
    c = F.lit(value) if isinstance(value, int) else value
    return F.when(c.between(low, high), c).otherwise(F.raise_error(F.concat(F.lit(f"must be from {low} to {high}: "), c.cast("string"))))
