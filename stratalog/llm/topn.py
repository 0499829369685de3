"""Top N items of every group, in two salted stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import parallelism


def usable(c: Column) -> Column:
    """The score, or null where it is null, infinite or not a number."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, salts: int | None = None) -> DataFrame:
    """(group, item, score, place): the n items of each group with the highest score.

    An item counts once per group, with its largest score; of equal scores the smaller item goes
    first.  Rows whose group, item or usable score is missing don't count; groups left without a
    row don't appear; an empty table gives an empty result.  Other columns are ignored.

    Each group is cut into subgroups by a hash of the item, so one group may hold any share of
    the rows: a subgroup drops repeats, ranks and keeps n, in one shuffle; at most salts x n
    survivors of a group are then ranked together.
    """
    salts = salts or parallelism(df.sparkSession)
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), usable(F.col(score)).alias("s"))
    rows = rows.where("g is not null and i is not null and s is not null").withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
    once = rows.repartition("g", "salt").groupBy("g", "salt", "i").agg(F.max("s").alias("s"))
    order = [F.desc("s"), F.asc("i")]
    near = once.withColumn("r", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).where(F.col("r") <= n)
    best = near.select("g", "i", "s").withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    return best.where(F.col("place") <= n).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "place")
