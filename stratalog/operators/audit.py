"""Audits: counts, orphans, duplicates, presence, coverage and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key is not null and not among the parent's keys."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows): keys that occur more than once; counted on the map side before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that exactly one of two tables has."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer").where("_a is null or _b is null")
    return both.select(key, F.when(F.col("_a").isNotNull(), "left").otherwise("right").alias("side"))


def pending(chunks: DataFrame, dense: DataFrame, sparse: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Chunks that lack a dense or a sparse representation; all of them if forced."""
    if force:
        return chunks
    have = dense.select(key).distinct().join(sparse.select(key).distinct(), key)
    return chunks.join(have, key, "left_anti")


def covered(ranges: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, covered): length of the union of ranges of each group, by a running maximum of ends."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(end).over(w), F.col(start))
    return ranges.withColumn("_c", F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), before))).groupBy(*by).agg(F.sum("_c").alias("covered"))


def spread(c: Column, prefix: str) -> list[Column]:
    """Percentiles in the two definitions in use: interpolated, and nearest rank."""
    out = [F.percentile(c, F.lit(p / 100)).alias(f"{prefix}_p{p}") for p in (50, 95, 99)]
    return out + [F.expr(f"percentile_disc({p / 100}) within group (order by {prefix})").alias(f"{prefix}_near{p}") for p in (50, 95, 99)]


def bucket(n: Column) -> Column:
    """Bucket of a count of chunks."""
    return F.when(n <= 5, n.cast("string")).when(n <= 10, "6-10").when(n <= 20, "11-20").when(n <= 50, "21-50").otherwise(">50")


def fingerprint(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, rows, fingerprint): a hash of a table's rows that doesn't depend on their order.

    Sums of row hashes, so nothing is collected: equal tables have equal fingerprints, however
    their rows are spread.
    """
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    part = lambda a: F.sum(F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    agg = [F.count("*").alias("rows"), F.concat_ws("-", part(1), part(13), part(25)).alias("fingerprint")]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def chunk_faults(chunks: DataFrame, blocks: DataFrame, limit: int, strict: bool = False) -> DataFrame:
    """(block_id, fault): blocks (block_id, char_start, char_end, text) whose chunks have a gap, an inexact text, a broken order or too many tokens.

    With strict, any fault is an error that names the first.
    """
    c = chunks.select("block_id", "ordinal", "source_char_start", "source_char_end", "token_count", F.col("text").alias("_c"))
    w = Window.partitionBy("block_id").orderBy("ordinal")
    c = c.withColumn("_o", F.row_number().over(w)).withColumn("_end", F.max("source_char_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = blocks.join(c, "block_id", "left")
    exact = F.substring("text", F.col("source_char_start") - F.col("char_start") + 1, F.col("source_char_end") - F.col("source_char_start")) == F.col("_c")
    g = x.groupBy("block_id").agg(
        F.max(F.coalesce(F.col("source_char_start") > F.coalesce("_end", "char_start"), F.col("char_end") > F.col("char_start"))).alias("gap"), F.max(F.col("source_char_end") < F.col("char_end")).alias("_short"),
        F.max(F.coalesce("source_char_end", "char_start")).alias("_last"), F.max("char_end").alias("_want"), F.max(~exact).alias("inexact text"), F.max(F.col("_o") != F.col("ordinal")).alias("order"), F.max(F.col("token_count") > limit).alias("limit"),
    )
    g = g.withColumn("gap", F.col("gap") | (F.col("_last") < F.col("_want")))
    kinds = ("gap", "inexact text", "order", "limit")
    out = g.select("block_id", F.explode(F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds]))).alias("fault"))
    if strict and (first := out.orderBy("block_id", "fault").first()):
        raise ValueError(f"chunks of block {first['block_id']}: {first['fault']}")
    return out
