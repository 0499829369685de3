"""Mixing sources to target shares of all tokens, by balanced sampling with the cube method.

A source whose share of the mix is more than it holds is repeated, less is thinned: each of its
documents is to be used w times on average.  The whole part of w is certain; the rest is a
probability, and the cube method turns it into 0 or 1 for every document such that the source's
tokens and documents stay what the probabilities promise: the vector of probabilities is moved
through the null space of the balancing constraints until a coordinate becomes whole, again and
again, first within blocks, then among what the blocks leave, until no more than a few documents
of a source are left to land.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, ship

BLOCK = 5_000  # documents of one source that are balanced together
EPS = 1e-9


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: p moved within the null space of (1, x) until at most two entries are fractional.

    Three fractional units at a time span, with two constraints (documents and tokens), a null
    direction u given by a cross product; a random step to one of its two ends keeps expectations.
    """
    p = p.astype(float).copy()
    todo = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    draws, at = rng.random(len(todo) + 8), 0
    act, nxt = todo[:3], 3
    while len(act) == 3:
        i, j, k = act
        u = (x[k] - x[j], x[i] - x[k], x[j] - x[i])
        if u[0] == u[1] == u[2] == 0:  # equal sizes: any exchange of two keeps both constraints
            u = (1.0, -1.0, 0.0)
        up, down = math.inf, math.inf
        for a, d in zip(act, u):
            if d > 0:
                up, down = min(up, (1 - p[a]) / d), min(down, p[a] / d)
            elif d < 0:
                up, down = min(up, -p[a] / d), min(down, -(1 - p[a]) / d)
        step = up if draws[at] * (up + down) < down else -down
        at += 1
        for a, d in zip(act, u):
            p[a] += step * d
        keep = [a for a in act if EPS < p[a] < 1 - EPS]
        for a in act:
            if a not in keep:
                p[a] = round(p[a])
        if len(keep) == 3:  # numerical standstill: settle the one nearest to whole
            a = min(keep, key=lambda b: min(p[b], 1 - p[b]))
            p[a] = round(p[a])
            keep.remove(a)
        while len(keep) < 3 and nxt < len(todo):
            keep.append(todo[nxt])
            nxt += 1
        act = keep
        if at >= len(draws):
            draws, at = rng.random(len(todo) + 8), 0
    return p


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Landing phase for the last few units: the 0/1 vector whose tokens and documents are nearest to the promised ones."""
    left = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    want, docs = sum(p[i] * x[i] for i in left), sum(p[i] for i in left)
    best = min(range(2 ** len(left)), key=lambda m: (abs(want - sum(x[i] for k, i in enumerate(left) if m >> k & 1)), abs(docs - bin(m).count("1")), m)) if left else 0
    p = p.copy()
    for k, i in enumerate(left):
        p[i] = best >> k & 1
    return np.round(p)


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, docs, uses): uses is how often a document of the source is used on average.

    The mix is as large as it can be with every target share met: the source that is scarcest for
    its share, repeated max_repeats times, sets the size.  Targets without share don't count;
    where a source with a share has no tokens, no mix can hold its share, and the others are
    scaled up among themselves.
    """
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    t = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = F.broadcast(t).join(held, "source").where("tokens > 0")
    size = rows.agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share")).alias("size"))
    return rows.crossJoin(F.broadcast(size)).select("source", "target_share", "max_repeats", "tokens", "docs", F.least(F.col("size") * F.col("target_share") / F.col("tokens"), F.col("max_repeats").cast("double")).alias("uses"))


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(key, source, n_tokens, copies): every document used, and how often.

    sizes has (key, source, n_tokens), targets (source, target_share, max_repeats).  Documents of
    a null or untargeted source, with a null key or without tokens aren't used; copies is at most
    the source's max_repeats.  An empty table gives an empty result.  The result follows from the
    rows and the seed alone.
    """
    spark = sizes.sparkSession
    ship(spark)
    sizes = settle(sizes.select(key, "source", F.col("n_tokens").cast("long").alias("n_tokens")).where(F.col(key).isNotNull() & F.col("source").isNotNull() & (F.col("n_tokens") > 0)))
    uses = settle(plan(sizes, targets)).select("source", "uses")
    rows = sizes.join(F.broadcast(uses), "source")
    rows = rows.withColumn("sure", F.floor("uses")).withColumn("p", F.col("uses") - F.floor("uses"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.col(key)))
    # a use within rounding of a whole number of repeats is that whole number
    rows = rows.withColumn("sure", F.when(F.col("p") > 1 - 1e-7, F.col("sure") + 1).otherwise(F.col("sure"))).withColumn("p", F.when((F.col("p") > 1 - 1e-7) | (F.col("p") < 1e-7), 0.0).otherwise(F.col("p")))
    whole = rows.where("p = 0 and sure > 0").select(key, "source", "n_tokens", F.col("sure").cast("int").alias("copies"))
    open_ = rows.where("p > 0")
    kind = dict(open_.dtypes)[key]
    cols = [key, "source", "n_tokens", "sure", "p", "h"]
    schema = f"`{key}` {kind}, source string, n_tokens long, sure long, p double, h long"

    def step(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf[cols]
            pdf = pdf.sort_values(["h", key], ignore_index=True)
            rng = np.random.default_rng(abs(int(pdf["h"].iloc[0])) + seed)
            x = pdf["n_tokens"].to_numpy(float)
            p = flight(pdf["p"].to_numpy(float), x, rng)
            pdf["p"] = land(p, x) if last else p
            return pdf

        return run

    biggest = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    open_, done = open_.select(*cols), []
    salt = 0
    while biggest > block:  # each level leaves two of a block's documents
        blocks = math.ceil(biggest / (block / 2))
        salt += 1
        level = settle(
            open_.withColumn("b", F.pmod(F.xxhash64(F.lit(salt), F.col("h")), F.lit(blocks)))
            .groupBy("source", "b")
            .applyInPandas(step(False), schema)
        )
        done.append(level.where("p in (0, 1)"))
        open_ = level.where("p not in (0, 1)")
        biggest = min(biggest, 2 * blocks)
    done.append(open_.groupBy("source").applyInPandas(step(True), schema))
    out = whole
    for d in done:
        out = out.unionByName(d.withColumn("copies", (F.col("sure") + F.round("p")).cast("int")).where("copies > 0").select(key, "source", "n_tokens", "copies"))
    return out


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, uses, tokens, share, most_copies): what each source contributes; 0 where it has nothing."""
    got = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum("copies").alias("uses"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens").alias("all"))
    joined = F.broadcast(targets.select("source", "target_share", "max_repeats")).join(got, "source", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("source", "target_share", "max_repeats", zero("docs"), zero("uses"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("share"), zero("most_copies"))
