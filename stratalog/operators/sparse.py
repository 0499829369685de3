"""Search of one lane of rows for all queries of a group: rows stream by in blocks, and each query keeps its first k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 64  # rows of a group of one block whose greatest product is looked at first
FREQUENT, MOST_BYTES = 64, 1 << 27  # rows of a block that hold a term with a column of its own, and bytes of all columns of a block
SLACK = 1e-5  # what a product of single precision may be off by, as a share
EMITTED = 50_000  # rows of one batch that leaves a lane


def counted(row: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of term numbers that occur in rows, sorted by row and term."""
    both = (row.astype(np.int64) << 32) | flat
    both.sort()
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(both)))
    both = both[first]
    return both >> 32, both & 0xFFFFFFFF, n


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of all spans end to end."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Queries:
    """The queries of a group: their terms numbered, norms, and the first k rows found so far with score and shared terms."""

    def __init__(self, ids: pa.Array, flat: np.ndarray, sizes: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.known, at = np.unique(flat, return_inverse=True)
        self.flat, self.begin = at, np.append(0, np.cumsum(sizes))
        row, self.term, self.count = counted(np.repeat(np.arange(len(ids)), sizes), at)
        self.norm = np.sqrt(np.bincount(row, self.count * self.count, minlength=len(ids)))
        self.first = np.searchsorted(row, np.arange(len(ids) + 1))  # distinct terms of each query in term, count
        self.score, self.row, self.shared = np.full((len(ids), k), -1.0), np.full((len(ids), k), np.iinfo(np.int64).max), np.zeros((len(ids), k), np.int32)
        self.weight = np.zeros(len(self.known))  # of one query's terms, while it is asked

    def least(self, q: int) -> float:
        """The score that a row needs at least to be among the first k, 0 while these are fewer."""
        return max(0.0, self.score[q, -1])

    def keep(self, q: int, score: np.ndarray, row: np.ndarray, shared: np.ndarray) -> None:
        s, r, n = np.append(self.score[q], score), np.append(self.row[q], row), np.append(self.shared[q], shared)
        o = np.lexsort((r, -s))[: self.k]
        self.score[q], self.row[q], self.shared[q] = s[o], r[o], n[o]


class Block:
    """Rows of terms, with the products that queries have with them.

    Rows are ordered by norm in groups of WIDTH, so that the greatest product of a group bounds its
    scores; columns of counts that fit in a byte are added whole, which is exact.
    """

    def __init__(self, qs: Queries, keys: pa.Array, flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray | None, base: int):
        n, row = len(keys), np.repeat(np.arange(len(keys)), sizes)
        names, at = np.unique(flat, return_inverse=True)
        if weights is None:
            row, at, w = counted(row, at)
        else:
            w = weights
        norm = np.sqrt(np.bincount(row, w.astype(np.float64) * w, minlength=n))
        place = np.minimum(np.searchsorted(qs.known, names), max(0, len(qs.known) - 1))
        term = np.where(qs.known[place] == names, place, -1)[at] if len(qs.known) and len(names) else np.full(len(at), -1)
        held = term >= 0
        row, term, w = row[held], term[held], w[held]
        self.base, self.term, self.w, self.begin = base, term, w, np.searchsorted(row, np.arange(n + 1))
        self.exact = weights is None and (not len(w) or w.max() <= 255)
        groups = max(1, -(-n // WIDTH))
        order = np.argsort(norm, kind="stable")
        at2 = np.full(groups * WIDTH, -1)
        at2[:n] = order
        self.row_at = np.ascontiguousarray(at2.reshape(groups, WIDTH).T)
        padded = np.append(norm[order], np.full(groups * WIDTH - n, norm.max() if n else 1.0)).reshape(groups, WIDTH)
        padded = np.maximum(padded, 1e-300)
        self.inverse, self.most, self.fewest = np.ascontiguousarray(1 / padded.T), 1 / padded[:, 0], 1 / padded[:, -1]
        place = np.empty(n, np.int64)
        rank = np.arange(n)
        place[order] = rank % WIDTH * groups + rank // WIDTH
        self.norm, self.place, self.groups = np.maximum(norm, 1e-300), place, groups
        often = np.bincount(term, minlength=len(qs.known))
        own = np.argsort(-often, kind="stable")[: MOST_BYTES // (groups * WIDTH * (1 if self.exact else 4))]
        own = own[often[own] >= FREQUENT]
        self.column = np.full(len(qs.known), -1)
        self.column[own] = np.arange(len(own))
        c = self.column[term]
        columns = np.zeros((len(own), groups * WIDTH), np.uint8 if self.exact else np.float32)
        columns[c[c >= 0], place[row[c >= 0]]] = w[c >= 0]
        self.columns = list(columns)
        rare = np.flatnonzero(c < 0)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.rare_place, self.rare_w = place[row[rare]], w[rare].astype(columns.dtype)
        self.rare_begin = np.searchsorted(term[rare], np.arange(len(qs.known) + 1))
        self.top = np.zeros(len(qs.known))
        np.maximum.at(self.top, term, w)
        mine = pc.index_in(qs.ids, value_set=keys).fill_null(-1).to_numpy(zero_copy_only=False)
        self.itself = np.where(mine >= 0, place[mine] if n else -1, -1)

    def search(self, qs: Queries) -> None:
        col = self.column[qs.flat]
        bound = np.add.reduceat(np.append(self.top[qs.flat], 0), qs.begin[:-1]) if len(qs.flat) else np.zeros(0)
        few = np.flatnonzero((col < 0) & (self.rare_begin[qs.flat + 1] > self.rare_begin[qs.flat]))
        few_at, few_terms = np.searchsorted(few, qs.begin).tolist(), qs.flat[few].tolist()
        many = np.flatnonzero(col >= 0)
        many_at, many_columns = np.searchsorted(many, qs.begin).tolist(), col[many].tolist()
        begin, columns, add, itself = self.rare_begin.tolist(), self.columns, np.add, self.itself.tolist()
        size, k = self.groups * WIDTH, qs.k
        byte, wide = np.zeros(size, np.uint8 if self.exact else np.float32), np.zeros(size, np.uint32 if self.exact else np.float32)
        slack = 1 - (1e-9 if self.exact else SLACK)
        for q in range(len(qs.ids)):
            a, b, c, e = many_at[q], many_at[q + 1], few_at[q], few_at[q + 1]
            if a == b and c == e:
                continue
            acc = byte if bound[q] <= 255 else wide
            if a < b:
                acc[:] = columns[many_columns[a]]
                for x in many_columns[a + 1 : b]:
                    add(acc, columns[x], acc)
            else:
                acc[:] = 0
            for t in few_terms[c:e]:
                acc[self.rare_place[begin[t] : begin[t + 1]]] += self.rare_w[begin[t] : begin[t + 1]]
            if itself[q] >= 0:
                acc[itself[q]] = 0
            both = acc.reshape(WIDTH, self.groups)
            top = both.max(axis=0)
            least = (qs.least(q) - 2e-9) * qs.norm[q] * slack
            if least <= 0:  # of as many groups, each has a row of this score
                if 4 * k <= self.groups:
                    low = top * self.fewest
                    least = np.partition(low, self.groups - k)[self.groups - k] * slack**2 - 2e-9 * qs.norm[q]
                elif k < size:
                    low = (both * self.inverse).ravel()
                    least = np.partition(low, size - k)[size - k] * slack**2 - 2e-9 * qs.norm[q]
            g = np.flatnonzero((top * self.most >= least) & (top > 0))
            if not len(g):
                continue
            part = both[:, g]
            i, j = np.nonzero((part * self.inverse[:, g] >= least) & (part > 0))
            if not len(i):
                continue
            row = self.row_at[i, g[j]]
            self._settle(qs, q, row, part[i, j])

    def _settle(self, qs: Queries, q: int, row: np.ndarray, product: np.ndarray) -> None:
        """Exact scores and shared terms of the rows that may be among a query's first k."""
        own = qs.term[qs.first[q] : qs.first[q + 1]]
        qs.weight[own] = qs.count[qs.first[q] : qs.first[q + 1]]
        size = self.begin[row + 1] - self.begin[row]
        if self.exact:
            score = np.round(product / (qs.norm[q] * self.norm[row]), 9)
            fine = np.flatnonzero(score >= np.partition(score, len(score) - qs.k)[len(score) - qs.k]) if len(score) > qs.k else np.arange(len(score))
            row, score, size = row[fine], score[fine], size[fine]
        at, of = spans(self.begin[row], size), np.repeat(np.arange(len(row)), size)
        asked = qs.weight[self.term[at]]
        if not self.exact:
            score = np.round(np.bincount(of, asked * self.w[at], minlength=len(row)) / (qs.norm[q] * self.norm[row]), 9)
        qs.weight[own] = 0
        good = score > 0
        qs.keep(q, score[good], self.base + row[good], np.bincount(of, asked > 0, minlength=len(row))[good])


class Postings:
    """The same rows read posting by posting in doubles: the plain form that Block is compared with."""

    def __init__(self, qs: Queries, keys: pa.Array, flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray | None, base: int):
        row = np.repeat(np.arange(len(keys)), sizes)
        o = np.lexsort((flat, row))
        row, flat = row[o], flat[o]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (flat[1:] != flat[:-1]))) if len(row) else np.zeros(0, np.int64)
        share = np.diff(np.append(first, len(row))) / np.maximum(sizes, 1)[row[first]]
        row, flat = row[first], flat[first]
        share = share / np.sqrt(np.bincount(row, share * share, minlength=len(keys)))[row]
        self.begin, self.terms = np.searchsorted(row, np.arange(len(keys) + 1)), flat
        o = np.argsort(flat, kind="stable")
        self.row, self.share, flat = row[o], share[o], flat[o]
        self.low, self.high = np.searchsorted(flat, qs.known, "left").tolist(), np.searchsorted(flat, qs.known, "right").tolist()
        self.n, self.base = len(keys), base
        self.at = pc.index_in(qs.ids, value_set=keys).fill_null(-1).to_numpy(zero_copy_only=False)

    def search(self, qs: Queries) -> None:
        parts = max(1, self.n // WIDTH)
        for q in range(len(qs.ids)):
            own = qs.term[qs.first[q] : qs.first[q + 1]]
            unit = qs.count[qs.first[q] : qs.first[q + 1]] / qs.norm[q]
            lists = [(slice(self.low[t], self.high[t]), u) for t, u in zip(own.tolist(), unit) if self.low[t] < self.high[t]]
            if not lists:
                continue
            s = np.bincount(np.concatenate([self.row[x] for x, _ in lists]), np.concatenate([self.share[x] * u for x, u in lists]), minlength=self.n)
            if self.at[q] >= 0:
                s[self.at[q]] = 0
            least = qs.least(q) - 2e-9
            if least <= 0 and self.n > qs.k:  # the greatest of as many parts, or the first k themselves
                top = s[: parts * WIDTH].reshape(WIDTH, parts).max(axis=0) if qs.k <= parts and self.n >= WIDTH else s
                least = np.partition(top, len(top) - qs.k)[len(top) - qs.k] - 2e-9
            found = np.flatnonzero(s >= max(least, 1e-12))
            if not len(found):
                continue
            score = np.round(s[found], 9)
            found, score = found[score > 0], score[score > 0]
            size = self.begin[found + 1] - self.begin[found]
            held = np.isin(self.terms[spans(self.begin[found], size)], qs.known[own])
            qs.keep(q, score, self.base + found, np.bincount(np.repeat(np.arange(len(found)), size), held, minlength=len(found)))


FORMS = {"columns": Block, "postings": Postings}


class Lane:
    """Queries (kind 0), then rows (kind 1) by key, as batches of (_p, _kind, _k, _h, _w); searched in each of some forms."""

    def __init__(self, k: int, block: int, forms: tuple[str, ...]):
        self.k, self.block, self.forms = k, block, forms
        self.asked: list = []
        self.held: list = []
        self.keys: list = []
        self.qs: list = []
        self.waiting = self.seen = 0

    @staticmethod
    def _read(batches: list) -> tuple:
        ids = pa.concat_arrays([b.column("_k") for b in batches])
        h, w = pa.concat_arrays([b.column("_h") for b in batches]), pa.concat_arrays([b.column("_w") for b in batches])
        sizes = pc.list_value_length(h).fill_null(0).to_numpy(zero_copy_only=False)
        return ids, h.flatten().to_numpy(zero_copy_only=False), sizes, None if w.null_count else w.flatten().to_numpy(zero_copy_only=False)

    def add(self, batch: pa.RecordBatch, kind: int) -> None:
        if kind == 0:
            self.asked.append(batch)
            return
        piece = max(1, self.block // 4)
        for at in range(0, len(batch), piece):
            self.held.append(batch.slice(at, piece))
            self.waiting += len(self.held[-1])
            if self.waiting > self.block + piece:  # what is left for the last block is no small rest
                self._search(self.block)

    def _search(self, most: int) -> None:
        now, n = [], 0
        while self.held and (not now or n + len(self.held[0]) <= most):
            now.append(self.held.pop(0))
            n += len(now[-1])
        self.waiting -= n
        if not now or not self.asked:
            return
        if not self.qs:
            ids, flat, sizes, _ = self._read(self.asked)
            self.qs = [Queries(ids, flat, sizes, self.k) for _ in self.forms]
        keys, flat, sizes, w = self._read(now)
        for form, qs in zip(self.forms, self.qs):
            FORMS[form](qs, keys, flat, sizes, w, self.seen).search(qs)
        self.keys.append(keys)
        self.seen += n

    def end(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        while self.held:
            self._search(self.block + max(1, self.block // 4))
        each = max(1, EMITTED // self.k)
        for form, qs in zip(self.forms, self.qs):
            keys = pa.concat_arrays(self.keys)
            for at in range(0, len(qs.ids), each):
                q, i = np.nonzero(qs.score[at : at + each] > 0)
                q += at
                yield pa.RecordBatch.from_arrays([pa.array([form] * len(q), pa.string()), qs.ids.take(pa.array(q)), keys.take(pa.array(qs.row[q, i])), pa.array(qs.score[q, i]), pa.array(qs.shared[q, i], pa.int64())], names=names)


def searched(names: list[str], k: int, block: int, forms: tuple[str, ...]):
    """A function of Arrow batches sorted by lane (_p), kind and key that gives, for each form, each query's first k rows of each lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, now = None, None
        for b in batches:
            if not len(b):
                continue
            p, kinds = b.column("_p").to_numpy(zero_copy_only=False), b.column("_kind").to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(b)]
            for a, e in zip(cut, cut[1:]):
                if p[a] != now:
                    if lane:
                        yield from lane.end(names)
                    lane, now = Lane(k, block, forms), p[a]
                lane.add(b.slice(a, e - a), int(kinds[a]))
        if lane:
            yield from lane.end(names)

    return run
