"""One ranking from several differently scaled scores: Borda count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .topn import usable

HOT = 1_000_000  # rows of one group from which its ranking is cut into ranges
RANGES = 64
MOST_HOT = 2_048  # so many of the largest groups above HOT are cut into ranges: the list of them and their cut points stay within a few MB


def combine(df: DataFrame, group: str, item: str, scores: list[str], missing: str = "mid", weights: list[float] | None = None, member: str | None = None, hot: int = HOT) -> DataFrame:
    """(group, item, points, n): the Borda points of each item among the n items of its group.

    Every score ranks the group's items, higher first, ties with their average rank; an item gets
    n - rank points from each score, times the score's weight (1 each unless given).  A null, infinite
    or not-a-number score gets the middle rank (missing="mid") or the last place, that is no points
    (missing="none").  An item that occurs more than once counts with the largest usable value of each
    score; with member, only items with a true member in any of their rows count.  Rows without group
    or item don't count; an empty table gives an empty result; other columns are ignored.

    Rows are shuffled once, by group; ranks are windows over it.  A group above hot rows is not brought
    together: its values are counted and cut into ranges that are ranked apart (see _ranges).
    """
    if missing not in ("mid", "none"):
        raise ValueError("missing is 'mid' or 'none'")
    weights = weights or [1.0] * len(scores)
    if len(weights) != len(scores):
        raise ValueError("a weight for each score")
    names = [f"s{k}" for k in range(len(scores))]
    here = F.coalesce(F.col(member).cast("boolean"), F.lit(False)) if member else F.lit(True)
    # + 0.0: -0.0 and 0.0 are one value
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), here.alias("here"), *((usable(F.col(s)) + 0.0).alias(n) for s, n in zip(scores, names)))
    rows = rows.where("g is not null and i is not null")
    largest = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("c")).where(F.col("c") > hot)
    big = [r["g"] for r in largest.orderBy(F.desc("c"), "g").limit(MOST_HOT).collect()]
    once = lambda part: part.groupBy("g", "i").agg(F.max("here").alias("here"), *(F.max(n).alias(n) for n in names)).where("here").drop("here")
    none = (lambda n: (n + 1) / 2) if missing == "mid" else (lambda n: n)

    n = F.col("n")
    cold = once((rows.where(~F.col("g").isin(big)) if big else rows).repartition("g")).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    total = F.lit(0.0)
    for s, w in zip(names, weights):
        by = Window.partitionBy("g").orderBy(F.desc_nulls_last(s))
        rank = F.rank().over(by) + (F.count("*").over(by.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2
        cold = cold.withColumn(f"r{s}", rank)
        total = total + (n - F.when(F.col(s).isNull(), none(n)).otherwise(F.col(f"r{s}"))) * w
    out = cold.select("g", "i", total.alias("points"), "n")
    if big:
        out = out.unionByName(_ranges(settle(once(rows.where(F.col("g").isin(big)))), names, weights, none))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), "points", "n")


def _ranges(items: DataFrame, names: list[str], weights: list[float], none) -> DataFrame:
    """(g, i, points, n) of the items of hot groups, no group being brought together.

    Equal values are counted before they are shuffled.  Each group's values are cut into ranges,
    which are ranked apart and shifted by the counts of the ranges above.  A value held by more than
    one in MOST_HOT of all rows is met through a broadcast list, so no join has a hot key.
    """
    factor = F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("kind") + 1)
    long = items.select("g", "i", F.posexplode(F.array(*names)).alias("kind", "v"))
    values = settle(long.groupBy("g", "kind", "v").agg(F.count("*").alias("c")))
    cuts = [k / RANGES for k in range(1, RANGES)]
    split = settle(values.groupBy("g", "kind").agg(F.sum("c").alias("n"), F.percentile_approx("v", cuts, 10_000).alias("cuts")))
    each = values.join(F.broadcast(split), ["g", "kind"])
    # range 0 holds the highest values, the last one the nulls
    each = each.withColumn("part", F.when(F.col("v").isNull(), RANGES + 1).otherwise(F.size(F.filter("cuts", lambda c: c >= F.col("v")))))
    above = each.groupBy("g", "kind", "part").agg(F.sum("c").alias("in_part"))
    above = above.withColumn("before", F.sum("in_part").over(Window.partitionBy("g", "kind").orderBy("part")) - F.col("in_part")).select("g", "kind", "part", "before")
    inside = each.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "kind", "part").orderBy(F.desc_nulls_last("v"))))
    rank = F.col("before") + F.col("upto") - F.col("c") + (F.col("c") + 1) / 2
    worth = (F.col("n") - F.when(F.col("v").isNull(), none(F.col("n"))).otherwise(rank)) * factor
    points = settle(inside.join(F.broadcast(above), ["g", "kind", "part"]).select(F.col("g").alias("rg"), F.col("kind").alias("rk"), F.col("v").alias("rv"), "n", "c", worth.alias("p")))
    often = max(2, items.count() // MOST_HOT)
    same = (F.col("g") == F.col("rg")) & (F.col("kind") == F.col("rk")) & F.col("v").eqNullSafe(F.col("rv"))
    met = long.join(F.broadcast(points.where(F.col("c") >= often)), same, "left")
    cols = ["g", "i", "n", "p"]
    rest = met.where("rg is null").select("g", "i", "kind", "v").join(points.where(F.col("c") < often), same)
    return met.where("rg is not null").select(*cols).unionByName(rest.select(*cols)).groupBy("g", "i").agg(F.sum("p").alias("points"), F.max("n").alias("n"))
