"""The k most similar vectors of every vector, by balanced posting lists.

A bounded sample is cut into balanced clusters; their centroids, linked into a graph, are held in
memory on every executor.  Each vector is written to the list of its nearest centroid and, if it
lies near a boundary, to the lists of others that are hardly farther (a distance ratio).  A query
searches the graph and reads only lists within a distance ratio of the best one.  All vectors are
indexed and all are queries; within a list, queries meet members in one matrix product.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, ship

SAMPLE, PER_LIST, MOST_SAMPLE = 20_000, 16, 1_000_000  # vectors of a space that the clusters are fitted on: PER_LIST a list, at least SAMPLE, at most MOST_SAMPLE
LIST = 1_000  # vectors a list should own
MOST_LISTS = 65_536  # per space, so that centroids and graph stay within tens of MB; beyond 65 million vectors lists grow and are searched in blocks
DEGREE = 16  # links of a centroid in the graph
BEAM = 24  # centroids a search keeps
WRITE, WRITE_RATIO = 5, 1.06  # most lists a vector is written to; how much farther they may be than the nearest
READ, READ_RATIO = 5, 1.06  # the same of the lists a query reads
BLOCK = 20_000  # members, and readers, of one list that meet in a task; larger lists are cut
FEW = 200_000  # keys that may be broadcast
TOGETHER = 256  # vectors that search the graph side by side: their candidates fit in the processor's cache


def usable(vector: Column, dim: Column) -> Column:
    """Not null, as long as dim, finite and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & (dim > 0) & fine & F.exists(vector, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def clusters(x: np.ndarray, count: int, seed: int = 3) -> np.ndarray:
    """Centroids of balanced clusters: halves along the line between two means, at a cut near the middle."""
    rng = np.random.default_rng(seed)
    parts = [(-len(x), 0, np.arange(len(x)))]  # a heap, the largest first
    made = 0
    while len(parts) < count:
        size, _, own = heapq.heappop(parts)
        if -size < 4:
            heapq.heappush(parts, (size, made + 1, own))
            break
        y = x[own]
        c = y[rng.choice(len(y), 2, replace=False)].astype(np.float64)
        for _ in range(6):
            side = y @ (c[1] - c[0]).astype(np.float32) > 0.5 * float((c[1] ** 2).sum() - (c[0] ** 2).sum())
            if side.all() or not side.any():
                break
            c = np.stack([y[~side].mean(0), y[side].mean(0)]).astype(np.float64)
        along = y @ (c[1] - c[0]).astype(np.float32)
        cut = 0.5 * float((c[1] ** 2).sum() - (c[0] ** 2).sum())
        at = int(np.clip((along <= cut).sum(), 0.3 * len(y), 0.7 * len(y)))
        order = np.argsort(along, kind="stable")
        for half in (own[order[:at]], own[order[at:]]):
            made += 1
            heapq.heappush(parts, (-len(half), made, half))
    c = np.stack([x[p].mean(0) for _, _, p in parts])
    for _ in range(3):  # a few rounds of means; clusters that would starve keep their place
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        kinds, starts = np.unique(near[order], return_index=True)
        c[kinds] = np.add.reduceat(x[order].astype(np.float64), starts) / np.diff([*starts, len(x)])[:, None]
    return c.astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c**2).sum(1)
    step = max(64, 2**24 // len(c))
    return np.concatenate([(x[k : k + step] @ c.T - half).argmax(1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


class Graph:
    """Centroids linked to their nearest ones, searched by a beam from a few entries."""

    def __init__(self, c: np.ndarray, blocks: np.ndarray, seed: int = 3):
        self.c, self.half, self.blocks = c, 0.5 * (c**2).sum(1), blocks
        n = len(c)
        rng = np.random.default_rng(seed)
        d = min(DEGREE, n - 1)
        links = np.zeros((n, d), np.int64)
        for k in range(0, n, 1024):
            s = c[k : k + 1024] @ c.T - self.half
            s[np.arange(len(s)), np.arange(k, k + len(s))] = -np.inf
            if d:
                links[k : k + 1024] = np.argpartition(-s, d - 1, axis=1)[:, :d]
        far = rng.integers(0, n, (n, 2)) if n > d + 1 else np.zeros((n, 0), np.int64)
        self.links = np.concatenate([links, far], 1)
        self.entries = np.arange(n) if n <= 64 else rng.choice(n, max(64, int(2 * math.sqrt(n))), replace=False)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists, squared distances) in rising order for each unit vector; -1 pads."""
        parts = [self._search(x[k : k + TOGETHER]) for k in range(0, len(x), TOGETHER)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, B = len(self.c), len(x)
        beam = min(BEAM, n)
        score = x @ self.c[self.entries].T - self.half[self.entries]
        m = min(beam, len(self.entries))
        top = np.argpartition(-score, m - 1, axis=1)[:, :m]
        ids = np.full((B, beam), -1, np.int64)
        best = np.full((B, beam), -np.inf, np.float32)
        ids[:, :m], best[:, :m] = self.entries[top], np.take_along_axis(score, top, 1)
        if len(self.entries) < n:
            rows = np.arange(B)
            seen = np.zeros((B, n + 1), bool)  # the last place stands for -1
            seen[:, self.entries] = seen[:, n] = True
            open_ = ids >= 0
            for _ in range(12):
                pick = np.argpartition(-np.where(open_, best, -np.inf), 2, axis=1)[:, :3]
                live = np.take_along_axis(open_, pick, 1)
                if not live.any():
                    break
                np.put_along_axis(open_, pick, False, 1)
                new = np.where(live[:, :, None], self.links[np.take_along_axis(ids, pick, 1)], -1).reshape(B, -1)
                new.sort(axis=1)
                new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
                new[seen[rows[:, None], new]] = -1
                seen[rows[:, None], new] = True
                r, k = np.nonzero(new >= 0)
                if not len(r):
                    continue
                at = new[r, k]
                s = np.full(new.shape, -np.inf, np.float32)
                s[r, k] = np.einsum("ij,ij->i", x[r], self.c[at]) - self.half[at]
                ids, best, open_ = np.concatenate([ids, new], 1), np.concatenate([best, s], 1), np.concatenate([open_, new >= 0], 1)
                keep = np.argpartition(-best, beam - 1, axis=1)[:, :beam]
                ids, best, open_ = ids[rows[:, None], keep], best[rows[:, None], keep], open_[rows[:, None], keep]
        order = np.argsort(-best, axis=1)
        ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
        return ids, np.maximum(1.0 - 2.0 * best, 1e-9)  # |x|² = 1

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, write) of every list a vector reads; write says whether it is also written there."""
        ids, d2 = self.search(x)
        ids, d = ids[:, :READ], np.sqrt(d2[:, :READ])
        read = (ids >= 0) & (d <= READ_RATIO * d[:, :1])
        write = (ids >= 0) & (d <= WRITE_RATIO * d[:, :1]) & (np.arange(ids.shape[1]) < WRITE)
        row, col = np.nonzero(read | write)
        return row, ids[row, col], write[row, col]


def first_k(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of the k largest entries of each row; s is used up.  A few passes for a maximum are cheaper than a partition."""
    k = min(k, s.shape[1])
    if k > 16:
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return at, np.take_along_axis(s, at, 1)
    rows, at, val = np.arange(len(s)), np.empty((len(s), k), np.int64), np.empty((len(s), k), s.dtype)
    for j in range(k):
        at[:, j] = s.argmax(1)
        val[:, j] = s[rows, at[:, j]]
        s[rows, at[:, j]] = -np.inf
    return at, val


def pack(x: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit integers of their largest entry, an object array of bytes."""
    q = np.rint(x * (32767 / np.abs(x).max(1, keepdims=True))).astype("<i2")
    out = np.empty(len(q), object)
    out[:] = [r.tobytes() for r in q]
    return out


def unpack(b: list[bytes]) -> np.ndarray:
    return unit(np.frombuffer(b"".join(b), "<i2").reshape(len(b), -1))


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict[str, Graph]:
    """A graph for each space, from a bounded sample: the vectors whose id has a small hash."""
    sizes = {r["space"]: r["count"] for r in rows.groupBy("space").count().collect()}  # a row for each space
    out = {}
    for space, n in sorted(sizes.items()):
        share = min(1.0, max(sample, min(MOST_SAMPLE, PER_LIST * (n // LIST))) / n)
        part = rows.where((F.col("space") == space) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))) if share < 1 else rows.where(F.col("space") == space)
        x = part.select("id", "x").toPandas()
        x = x.sort_values("id")["x"].tolist() if len(x) else rows.where(F.col("space") == space).limit(8).toPandas()["x"].tolist()
        x = unit(np.stack([np.asarray(v, np.float64) for v in x]))
        c = clusters(x, max(1, min(n // LIST, MOST_LISTS, len(x) // 8)))
        own = np.bincount(Graph(c, np.ones(len(c), np.int64)).lists(x)[1], minlength=len(c)) * n / len(x)
        out[space] = Graph(c, np.maximum(1, np.ceil(own / BLOCK)).astype(np.int64))
    return out


def _small(df: DataFrame, n: int) -> DataFrame:
    """df, broadcast where its n rows are proven few."""
    return F.broadcast(df) if n <= FEW else df


def neighbours(df: DataFrame, item: str, space: str, vector: str, dim: str, rank: str, k: int = 5, sample: int = SAMPLE) -> DataFrame:
    """(space, item, other, cosine, place): the k nearest other items of every item in its space.

    Vectors that are null, not as long as dim, not finite or all zero take no part, nor do rows
    without item or space.  An item counts once per space, with the vector of its smallest rank
    value.  Items with equal vectors are searched once; their mutual cosine is 1.  Of equal cosines
    the smaller item goes first.  An empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    ok = df.where(F.col(item).isNotNull() & F.col(space).isNotNull() & usable(F.col(vector), F.col(dim)))
    rows = ok.select(F.col(space).alias("space"), F.col(item).alias("id"), F.col(rank).alias("rank"), F.col(vector).alias("x"), F.xxhash64(space, vector).alias("v"))
    # only the vector that counts for each item is indexed; it is chosen by rank and hash, so that no vector is shuffled for it
    chosen = settle(rows.groupBy("space", "id").agg(F.min_by("v", F.struct("rank", "v")).alias("v"), F.count_distinct("v").alias("of")))
    doubtful = chosen.where("of > 1").select("space", "id")
    if n := doubtful.count():
        unused = rows.join(_small(doubtful, n), ["space", "id"], "left_semi").select("v").distinct().join(chosen.select("v"), "v", "left_anti")
        unused = settle(unused)
        rows = rows.join(_small(unused, unused.count()), "v", "left_anti")
    graphs = fit(rows, sample)
    names = sorted(graphs)
    sent = spark.sparkContext.broadcast(graphs)  # at most MOST_LISTS centroids and their links a space

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            new = [i not in seen and not seen.add(i) for i in b["v"].tolist()]
            for name, p in b[new].groupby("space"):
                g = sent.value[name]
                x = unit(np.stack(p["x"].tolist()))
                row, lst, write = g.lists(x)
                v, packed, blocks = p["v"].to_numpy(), pack(x), g.blocks[lst]
                # a list cut into b blocks has b x b meetings: a vector reads in all of its row and is read in all of its column
                home = v[row] % blocks
                out = pd.DataFrame({"s": names.index(name), "l": lst, "block": home * (blocks + 1), "v": v[row], "reads": True, "write": write, "x": packed[row]})
                more = [out]
                for j in np.flatnonzero(blocks > 1):
                    h, n = home[j], blocks[j]
                    own = [(h * n + o, True, False) for o in range(n) if o != h] + [(o * n + h, False, True) for o in range(n) if o != h and write[j]]
                    more.append(pd.DataFrame([(names.index(name), lst[j], at, v[row[j]], r, w, packed[row[j]]) for at, r, w in own], columns=out.columns))
                yield pd.concat(more, ignore_index=True) if len(more) > 1 else out

    lists = rows.select("space", "v", "x").mapInPandas(assign, "s int, l int, block int, v long, reads boolean, write boolean, x binary")

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        p = p.drop_duplicates("v")
        q, x = p["v"].to_numpy(), unpack(p["x"].tolist())
        r, w = p["reads"].to_numpy(), p["write"].to_numpy()
        ids, y = q[w], x[w]
        if not r.all():
            q, x = q[r], x[r]
        out = []
        order = np.argsort(ids)
        ids, y = ids[order], y[order]
        for at in range(0, len(q), 256) if len(ids) else ():
            s = x[at : at + 256] @ y.T
            own = np.minimum(np.searchsorted(ids, q[at : at + 256]), len(ids) - 1)
            self_ = np.flatnonzero(ids[own] == q[at : at + 256])
            s[self_, own[self_]] = -np.inf
            top, val = first_k(s, k)
            fine = np.isfinite(val)
            r, _ = np.nonzero(fine)
            out.append(pd.DataFrame({"v": q[at + r], "o": ids[top[fine]], "cos": val[fine]}))
        return pd.concat(out) if out else pd.DataFrame({"v": np.zeros(0, np.int64), "o": np.zeros(0, np.int64), "cos": np.zeros(0, np.float32)})

    met = lists.groupBy("s", "l", "block").applyInPandas(meet, "v long, o long, cos float").repartition("v")
    met = met.groupBy("v", "o").agg(F.max("cos").alias("cos"))
    near = met.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("cos"), "o"))).where(F.col("r") <= k).select("v", "o", F.col("cos").cast("double").alias("cos"))
    number = F.create_map(*[F.lit(x) for k_, name in enumerate(names) for x in (name, k_)]) if names else F.create_map(F.lit(""), F.lit(-1))
    members = chosen.select(F.element_at(number, F.col("space")).alias("s"), "id", "v")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    first = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most k + 1 entries
    links = near.unionByName(first.where(F.size("ids") > 1).select("v", F.col("v").alias("o"), F.lit(1.0).alias("cos")))
    others = links.join(first.select(F.col("v").alias("o"), "ids"), "o").select("v", (-F.col("cos")).alias("far"), F.explode("ids").alias("other"))
    # of a vector's links at most (k + 1)² names; an item takes the first k that aren't itself
    ahead = others.groupBy("v").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "other"))), 1, k + 1).alias("a"))
    best = members.join(ahead, "v").select("s", "id", F.posexplode(F.slice(F.filter("a", lambda x: x["other"] != F.col("id")), 1, k)).alias("p", "x"))
    space_name = F.element_at(F.array(*map(F.lit, names or [""])), F.col("s") + 1)
    return best.select(space_name.alias(space), F.col("id").alias(item), F.col("x.other").alias("other"), (-F.col("x.far")).alias("cosine"), (F.col("p") + 1).alias("place"))
