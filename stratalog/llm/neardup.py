"""Near-duplicate texts: an exact similarity join on word shingles by multiple-global-order filtering.

Two sets of sizes m <= n with Jaccard similarity >= t share at least o = t/(1+t) (m+n) >= t n tokens.
The first order puts rare tokens first and those of a bounded list of frequent ones last.  If two
similar sets share a rare token, their first shared token is rare and among the first n - t n + 1 of
either: such rare tokens are join keys by themselves.  Else all they share is frequent, so both sets
hold at least t n frequent tokens, and the first n' - t n + l of these share at least l.  As l shared
tokens fall into l - 1 hash classes, two of them fall into one class: pairs of one class are the keys,
which are rarer than a frequent token.  Each key carries a bitmap of its whole set: a bit that one set
has and the other lacks stands for a token they don't share, so unlike sets part within the join.
Candidates must then share prefix tokens under two further orders, before the sets are compared
exactly.  Texts with the same set are one class and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle, ship, stored

HEAVY, RARE = 1e-3, 20  # a token in more than this share of the sets, and in more than so many, is frequent: at most mean size / HEAVY are
LARGE = 4  # words of 64 bits of the bitmaps that candidates are compared by
FEW = 1_000_000  # ids of copies that may be broadcast
NARROW = 5_000_000  # up to so many sets a key of 32 bits leaves few false candidates; more sets have keys of 64 bits


def words(text: Column) -> Column:
    """Lower-cased words: unbroken runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(df: DataFrame, key: str, text: str, size: int = 5, least_words: int = 5, kind: str | None = None) -> DataFrame:
    """(kind, key, c, sh): each text's set of shingle hashes in text order, and c, which is equal for equal sets.

    Rows with a null key, a null text or fewer than least_words words (or size) are left out.
    """
    k = F.col(kind) if kind else F.lit("")
    w = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(k.alias("kind"), F.col(key).alias("key"), words(F.col(text)).alias("w")).where(F.size("w") >= max(least_words, size))
    at = lambda i, j: F.get("w", i + F.lit(j))
    sh = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.hash(*[at(i, j) for j in range(size)])))
    return w.select("kind", "key", sh.alias("sh")).select("kind", "key", F.xxhash64("kind", F.size("sh"), F.array_sort("sh")).alias("c"), "sh")


EDGES = (1, 8, 30, 240)  # steps of set size; beyond the last each step doubles


def steps(largest: int, t: float) -> list[tuple[int, int]]:
    """(least size, classes) of every size step: classes is less than the tokens that two sets of the step share."""
    edges = list(EDGES)
    while edges[-1] * 2 <= largest:
        edges.append(edges[-1] * 2)
    want = [0, 2, 16] + [16 * 2**k for k in range(1, len(edges))]
    return [(e, max(0, min(m, int(np.ceil(t * e - 1e-9)) - 1))) for e, m in zip(edges, want)]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signatures(flat: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, heavy: np.ndarray, counts: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(set number, join key) of sets laid end to end; two sets of one seed with similarity t or more share a key.

    heavy are the frequent tokens in rising order, counts their counts.  Keys of frequent tokens are
    made in the size step of a pair's larger set, so a smaller set makes them for each step a partner
    may be in.
    """
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = sizes.astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    tok = flat.astype(np.int64)
    freq = np.zeros(len(tok), np.int64)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, tok), len(heavy) - 1)
        freq = np.where(heavy[at] == tok, counts[at], 0)
    h = _mix(tok + (1 << 31))
    order = np.lexsort((h, freq, doc))
    h, frequent = h[order], freq[order] > 0
    rank = np.arange(len(tok)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    least = np.ceil(t * sizes - 1e-9).astype(np.int64)  # tokens that a similar set shares
    rare = ~frequent & (rank <= (sizes - least)[doc])
    docs, keys = [doc[rare]], [h[rare]]
    among = np.bincount(doc[frequent], minlength=len(sizes))
    rank -= (sizes - among)[doc]
    for k, (edge, classes) in enumerate(steps(int(sizes.max() / t) + 1, t)):
        top = EDGES[k + 1] if k + 1 < len(EDGES) else 2 * edge
        use = (among >= least) & (sizes < top) & (sizes / t >= edge - 1e-9)
        keep = frequent & (rank < np.where(use, among - least + classes + 1, 0)[doc])
        d, x = doc[keep], h[keep]
        if not len(d):
            continue
        if classes:
            cls = ((x >> np.uint64(17)) % np.uint64(classes)).astype(np.int64)
            o = np.lexsort((x, cls, d))
            d, cls, x = d[o], cls[o], x[o]
            gap = 1
            while gap < len(d):
                same = np.flatnonzero((d[gap:] == d[:-gap]) & (cls[gap:] == cls[:-gap]))
                if not len(same):
                    break
                docs.append(d[same])
                keys.append(_mix(x[same] + np.uint64(k + 1)) ^ x[same + gap])
                gap += 1
        else:
            docs.append(d)
            keys.append(x + np.uint64(k + 1))
    d = np.concatenate(docs)
    return d, _mix(np.concatenate(keys) ^ _mix(seeds.astype(np.uint64))[d]).view(np.int64)


def bitmaps(flat: np.ndarray, sizes: np.ndarray, words: int) -> list[np.ndarray]:
    """Words of 64 bits for each set, each token at one of 64 x words places (words is a power of two)."""
    at = _mix(flat.astype(np.int64) + (words << 32)) >> np.uint64(58 - words.bit_length() + 1)
    bit = np.uint64(1) << (at & np.uint64(63))
    start = np.cumsum(sizes) - sizes
    return [np.bitwise_or.reduceat(np.where(at >> np.uint64(6) == w, bit, np.uint64(0)), start).view(np.int64) for w in range(words)]


def alike(x: list[np.ndarray], y: list[np.ndarray], t: float) -> np.ndarray:
    """Whether x (sizes, bitmap words) and y differ in no more bits than sets of similarity t may differ in tokens."""
    share = np.ceil(t / (1 + t) * (x[0] + y[0]) - 1e-6)
    lack = lambda u, v: sum(np.bitwise_count(p & ~q).astype(np.int64) for p, q in zip(u[1:], v[1:]))
    return (lack(x, y) <= x[0] - share) & (lack(y, x) <= y[0] - share)


def meetings(batches: Iterator[pd.DataFrame], t: float, least: int = 300_000) -> Iterator[pd.DataFrame]:
    """(a, b) of rows (k, id, n, bitmap words) sorted by k: the ids of one k that may be similar.

    Rows are taken in pieces of whole runs of one k, so memory holds about least rows or one run.
    """

    def piece(p: pd.DataFrame) -> pd.DataFrame:
        k, i = p["k"].to_numpy(), p["id"].to_numpy()
        cols = [p[c].to_numpy() for c in p.columns if c not in ("k", "id")]
        cols = [cols[0].astype(np.float64), *(c.view(np.uint64) for c in cols[1:])]
        end = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))
        end = np.repeat(end, np.diff(end, prepend=0))
        at, gap, out = np.arange(len(k)), 1, []
        while len(at := at[end[at] - at > gap]):
            size, other = cols[0][at], cols[0][at + gap]
            x = at[np.minimum(size, other) >= t * np.maximum(size, other) - 1e-6]
            if len(x):
                x = x[alike([c[x] for c in cols], [c[x + gap] for c in cols], t)]
                out.append((i[x], i[x + gap]))
            gap += 1
        a, b = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in (0, 1))
        a, b = np.minimum(a, b), np.maximum(a, b)
        return pd.DataFrame({"a": a, "b": b})[a < b].drop_duplicates()

    held: list[pd.DataFrame] = []
    rows = 0
    for p in batches:
        held.append(p)
        rows += len(p)
        if rows >= least:
            p = pd.concat(held, ignore_index=True)
            last = int(np.searchsorted(p["k"].to_numpy(), p["k"].iloc[-1]))
            if last:
                yield piece(p.iloc[:last])
            held = [p.iloc[last:]]
            rows = len(held[0])
            least = max(least, 2 * rows)  # a long run isn't joined again and again
    if rows:
        yield piece(pd.concat(held, ignore_index=True))


def _near(x: str, y: str, t: float, words: int) -> str:
    """SQL of alike for x{n, b0, ...} and y{...}."""
    share = f"ceil({t / (1 + t)!r} * ({x.format('n')} + {y.format('n')}) - 1e-6)"
    lack = lambda u, v: " + ".join(f"bit_count({u.format(f'b{w}')} & ~{v.format(f'b{w}')})" for w in range(words))
    return f"{lack(x, y)} <= {x.format('n')} - {share} and {lack(y, x)} <= {y.format('n')} - {share}"


def similar_sets(reps: DataFrame, t: float) -> DataFrame:
    """(a, b, similarity), a < b: the c of all pairs of different sets (kind, c, id, sh) of one kind whose Jaccard similarity is at least t.

    Tokens are counted over all sets; those in more than HEAVY of them, a list that is bounded by
    the mean size / HEAVY, are sent to the executors, so that prefixes hold rare tokens first.
    """
    spark = reps.sparkSession
    ship(spark)
    n = reps.count()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a token that is heavy over all is heavy in some part; what is far from heavy in a part is left out of its counts
        def flush(sets: list) -> pd.DataFrame:
            u, c = np.unique(np.concatenate(sets), return_counts=True)
            k = c >= max(2, HEAVY / 8 * len(sets))
            return pd.DataFrame({"h": u[k], "n": c[k]})

        held: list = []
        for b in batches:
            held += b["sh"].tolist()
            if len(held) > 100_000:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    heavy = reps.select("sh").mapInPandas(count, "h int, n long").groupBy("h").agg(F.sum("n").alias("count")).where(F.col("count") > max(RARE, HEAVY * n)).toPandas().sort_values("h")
    frequent = spark.sparkContext.broadcast((heavy["h"].to_numpy(np.int64), heavy["count"].to_numpy(np.int64)))
    shift = 32 if n <= NARROW else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hv, ct = frequent.value
        for b in batches:
            for at in range(0, len(b), 2_000):
                p = b.iloc[at : at + 2_000]
                sh = p["sh"].tolist()
                if not sh:
                    continue
                flat, sizes = np.concatenate(sh), np.array([len(x) for x in sh])
                d, keys = signatures(flat, sizes, p["seed"].to_numpy(np.int64), hv, ct, t)
                b0, b1 = bitmaps(flat, sizes, 2)
                yield pd.DataFrame({"k": keys >> shift, "id": p["id"].to_numpy()[d], "n": sizes[d], "b0": b0[d], "b1": b1[d]})

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if sh := b["sh"].tolist():
                sizes = np.array([len(x) for x in sh])
                yield pd.DataFrame({"id": b["id"], "n": sizes, **{f"b{w}": x for w, x in enumerate(bitmaps(np.concatenate(sh), sizes, LARGE))}})

    keys = reps.select("id", F.xxhash64("kind").alias("seed"), "sh").mapInPandas(run, f"k {'int' if shift else 'long'}, id long, n int, b0 long, b1 long")
    met = keys.repartition("k").sortWithinPartitions("k").mapInPandas(lambda rows: meetings(rows, t), "a long, b long").distinct()
    cand = stored(met)
    # larger bitmaps, one a set, part what the small ones in the keys let pass
    large = reps.select("id", "sh").mapInPandas(sketch, "id long, n int, " + ", ".join(f"b{w} long" for w in range(LARGE)))
    cand = stored(_fetch(cand, large).where(_near("{}_a", "{}_b", t, LARGE)).select("a", "b"))
    ends = cand.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    both = _fetch(cand, reps.join(ends, "id", "left_semi").select("id", "c", "sh"))

    def prefix(side: str, seed: int) -> Column:
        n = F.size(f"sh_{side}")
        return F.slice(F.array_sort(F.transform(f"sh_{side}", lambda h: F.hash(h, F.lit(seed)))), F.lit(1), n - F.ceil(F.lit(t) * n - F.lit(1e-9)).cast("int") + 1)

    for seed in (1, 2):
        both = both.where(F.arrays_overlap(prefix("a", seed), prefix("b", seed)))
    common = F.size(F.array_intersect("sh_a", "sh_b"))
    sim = common / (F.size("sh_a") + F.size("sh_b") - common)
    found = both.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b"), sim.alias("similarity"))
    return found.where(F.col("similarity") >= t - 1e-12)


def _fetch(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of rows (id, ...) for either end."""
    side = lambda s: rows.select(*(F.col(c).alias(f"{c}_{s}") for c in rows.columns))
    return pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))


def _sets(df: DataFrame, key: str, text: str, size: int, least_words: int, kind: str | None) -> tuple[DataFrame, DataFrame]:
    """Members (kind, key, c) and one set (kind, c, id, sh) of each c.

    Shingles are made once and stored; which rows are copies is decided on their hashes, so no set
    is shuffled unless there are more than FEW copies.
    """
    rows = stored(shingles(df, key, text, size, least_words, kind).withColumn("id", F.monotonically_increasing_id()))
    first = rows.groupBy("c").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("c", "first")
    copies = settle(rows.select("c", "id").join(first, "c").where("id <> first").select("id"))
    n = copies.count()
    reps = rows.join(F.broadcast(copies) if n <= FEW else copies, "id", "left_anti") if n else rows
    return rows.select("kind", "key", "c").distinct(), reps.select("kind", "c", "id", "sh") if n <= FEW else stored(reps.select("kind", "c", "id", "sh"))


def near_pairs(df: DataFrame, key: str, text: str, t: float = 0.8, size: int = 5, least_words: int = 5, kind: str | None = None) -> DataFrame:
    """(kind, id_a, id_b, similarity), id_a < id_b: all pairs of ids of one kind whose texts share at least t of their word shingles.

    Copies are expanded to pairs of ids.  Repeated rows count once; rows with a null key or text,
    or with fewer than least_words words, have no pair; an empty table gives an empty result;
    other columns are ignored.
    """
    members, reps = _sets(df, key, text, size, least_words, kind)
    members = settle(members)
    pairs = similar_sets(reps, t)
    a, b = members.select(F.col("c").alias("a"), F.col("key").alias("ka"), "kind"), members.select(F.col("c").alias("b"), F.col("key").alias("kb"))
    other = pairs.join(a, "a").join(b, "b").select("kind", "ka", "kb", "similarity")
    same = a.join(b, F.expr("a = b and ka < kb")).select("kind", "ka", "kb", F.lit(1.0).alias("similarity"))
    return other.unionByName(same).select("kind", F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b"), "similarity")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) is linked with, directly or not.

    Alternating large-star and small-star steps; each round is written to the shared folder, and
    the rounds end when the edges no longer change.  If they still do after the last round, an error
    is raised, as groups would be split.
    """
    e = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = settle(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: the edges still change after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def classes(df: DataFrame, key: str, text: str, t: float = 0.8, size: int = 5, least_words: int = 5, kind: str | None = None) -> DataFrame:
    """(kind, key, class, links): one row for each text, its group of near-duplicates and its number of similar texts of another wording.

    Groups are the connected parts of the pairs of near_pairs; copies share their class and are
    never expanded into pairs.  class is a number that is equal within a group.
    """
    members, reps = _sets(df, key, text, size, least_words, kind)
    pairs = settle(similar_sets(reps, t))
    root = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    out = members.join(root, F.col("c") == F.col("node"), "left").join(links, "c", "left")
    return out.select("kind", F.col("key").alias(key), F.coalesce("root", "c").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
