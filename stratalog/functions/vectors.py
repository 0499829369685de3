"""Column functions over dense vectors and over sparse terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Cosine of two vectors; 0 for empty ones, unequal lengths or a zero norm."""
    na, nb = norm(a) if na is None else na, norm(b) if nb is None else nb
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def finite(a: Column) -> Column:
    """Whether a vector is not null, not empty and all of it finite."""
    return a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def scaled(a: Column) -> Column:
    """The vector at length one, as doubles; a zero vector as it is."""
    # bound in arrays of one element, so that neither the vector nor its norm is computed again for each entry
    one = F.transform(F.array(a), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return F.transform(one, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double"))))[0]


def hashed_vector(text: Column, dim: int = 16) -> Column:
    """A deterministic stand-in embedding: hash of position and text, mapped to [-1, 1], at length one."""
    part = lambda i: F.conv(F.substring(F.sha2(F.concat(i.cast("string"), F.lit("\x1f"), text), 256), 1, 16), 16, 10).cast("double")
    return scaled(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: part(i) / F.lit(18446744073709551615.0) * 2 - 1))


TERM = "[A-Za-z0-9А-Яа-яЁё_]{2,}"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def finite_score(c: Column) -> Column:
    """A score, or null where it is null, infinite or not a number."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def weighted(dense: Column, sparse: Column, alpha: float = 0.65, beta: float = 0.35) -> Column:
    """Weighted fusion; a missing branch counts 0."""
    if alpha < 0 or beta < 0 or alpha + beta <= 0:
        raise ValueError("weights are not negative and not both zero")
    return F.coalesce(dense, F.lit(0.0)) * alpha + F.coalesce(sparse, F.lit(0.0)) * beta


def reciprocal_ranks(*ranks: Column, k: int = 60) -> Column:
    return sum((F.coalesce(1.0 / (r + k), F.lit(0.0)) for r in ranks[1:]), F.coalesce(1.0 / (ranks[0] + k), F.lit(0.0)))


def gain(relevance: Column, rank: Column) -> Column:
    """Discounted gain of a relevance grade at a rank."""
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1)
