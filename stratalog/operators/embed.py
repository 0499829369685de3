"""Embedding: the provider protocol, stand-in providers, batches by length, validity and vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import ship
from .lineage import numbered


class Provider(Protocol):
    """A model that embeds documents; made anew in every Python worker by its factory."""

    space: str
    limit: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed_with(df: DataFrame, key: str, text: str, factory: Callable[[], Provider], batch: int = 64) -> DataFrame:
    """(key, vector) of every text by a provider, one model a worker, texts of like length together."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            b = b.assign(_n=b["_text"].str.len()).sort_values("_n")
            out: list = []
            for k in range(0, len(b), batch):
                out += model.embed(b["_text"].iloc[k : k + batch].tolist())
            yield pd.DataFrame({key: b[key].tolist(), "vector": out})

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, vector array<float>")


def hashed_dense(df: DataFrame, key: str, text: str, dim: int = 16) -> DataFrame:
    """(key, vector): the deterministic stand-in provider, in built-in expressions alone."""
    return df.select(key, V.hashed_vector(F.col(text), dim).alias("vector"))


def length_batches(df: DataFrame, key: str, tokens: str, size: int) -> DataFrame:
    """df with batch: rows of like token count in batches of the given size, in order of (tokens, key).

    A global order without a global window: the number of rows of each token count gives where
    each count starts, and rows are numbered within their count.
    """
    counts = df.groupBy(tokens).agg(F.count("*").alias("_c"))
    starts = counts.select(tokens, (F.sum("_c").over(Window.orderBy(tokens)) - F.col("_c")).alias("_s"))  # one row a token count
    n = F.row_number().over(Window.partitionBy(tokens).orderBy(key)) - 1
    return df.join(F.broadcast(starts), tokens).withColumn("batch", F.floor((F.col("_s") + n) / size)).drop("_s")


def vector_state(vector: Column, dim: Column) -> Column:
    """null, empty, length, not finite, zero or usable."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNull(), "null").when(F.size(vector) == 0, "empty").when(F.size(vector) != dim, "length").when(~fine, "not finite").when(~F.exists(vector, lambda x: x != 0), "zero").otherwise("usable")


def vocabulary(postings: DataFrame) -> DataFrame:
    """(term, token_index): terms numbered from 0 in order.

    Terms are sorted over all tasks; each task's offset comes from the counts of the tasks before it,
    a list of one row a task.
    """
    terms = postings.select("term").where("term is not null").distinct()
    return numbered(terms, "term").select("term", F.col("at").alias("token_index"))


def legacy_compatible(stored: Column, asked: Column) -> Column:
    """Whether vectors of a stored legacy space may serve a requested space."""
    named = F.contains(stored, F.lit("sentence-transformers")) & F.startswith(asked, F.lit("sentence-transformers-dense;"))
    return F.coalesce(named, F.lit(False))


def embedding_text(project: Column, title: Column, role: Column, kind: Column, content: Column) -> Column:
    """The text of a block that is embedded: what it belongs to, line by line; lines without a value are left out."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", line("Project", project), line("Conversation", title), F.concat(F.lit("Role: "), F.upper(role)), F.concat(F.lit("Block type: "), kind), F.concat(F.lit("Content: "), content))


def space_id(model: str, dim: int, pool: str, norm: str, policy: str) -> str:
    return f"{model};dim={dim};pool={pool};norm={norm};chunk_policy={policy}"
