"""Character-level BiLSTM with a linear-chain CRF, in numpy.

Training and inference share one set of parameters.  Inference is written for throughput: the
input projection is a table lookup per character, both directions advance in one batched
matrix product, and texts are cut into overlapping windows that are stitched before each whole text is
decoded.
"""

from __future__ import annotations

import numpy as np

TAGS = ("O", "email", "phone", "id_number", "address", "name")

# Fixed alphabet: index 0 is padding, index 1 any character not listed.
ALPHABET = (
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    "абвгдежзийклмнопрстуфхцчшщъыьэюяёєіїґАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁЄІЇҐ"
    "àâäáéèêëíîïóôöúùûüñçßÀÂÄÁÉÈÊËÍÎÏÓÔÖÚÙÛÜÑÇ"
    " \n\t.,;:!?-_@+/\\()[]{}<>\"'`#*|=&%$~^«»„“”’–—…№ºª"
)
_CODE = np.ones(0x10000, dtype=np.int32)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 2
VOCAB = len(ALPHABET) + 2

WINDOW = 512
OVERLAP = 64


def encode(text: str) -> np.ndarray:
    """Character ids of a text, one per code point."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _CODE[np.minimum(cp, 0xFFFF)]


def init_params(hidden: int, emb: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"emb": r.normal(0, 0.3, (VOCAB, emb))}
    p["Wx"] = r.normal(0, 1 / np.sqrt(emb), (2, emb, 4 * hidden))
    p["U"] = r.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden))
    p["b"] = np.zeros((2, 1, 4 * hidden))
    p["b"][:, :, hidden : 2 * hidden] = 1.0
    p["Wo"] = r.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, len(TAGS)))
    p["bo"] = np.zeros(len(TAGS))
    p["trans"] = np.where(np.eye(len(TAGS)) > 0, 1.0, -1.0)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _both(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, 2, B) ids read forwards and backwards, and the (T, B) positions read backwards."""
    T = ids.shape[1]
    back = lens[None, :] - 1 - np.arange(T)[:, None]
    back = np.where(back < 0, np.arange(T)[:, None], back)
    fwd = ids.T
    return np.stack([fwd, np.take_along_axis(fwd, back, 0)], 1), back


def _weights(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """The weights of outputs, characters and bias side by side (2, 4H, H + E + 1), and the characters' vectors (E, V); outputs are kept doubled."""
    w = np.concatenate([p["U"] * 0.5, p["Wx"], p["b"]], 1).transpose(0, 2, 1)
    return np.ascontiguousarray(w, dtype=np.float32), np.ascontiguousarray(p["emb"].T, dtype=np.float32)


def emissions(p: dict, ids: np.ndarray, lens: np.ndarray, cache: dict | None = None) -> np.ndarray:
    """(tags, B, T) scores for padded ids (B, T) of the given lengths.

    Gates lie one below the other and texts side by side, so that each step is one product and
    runs over whole gates.  The gates 0.5 + 0.5 x are kept as 1 + x; the halves are in the weights.
    """
    cache = {} if cache is None else cache
    if "weights" not in cache:
        cache["weights"] = _weights(p)
    w, emb = cache["weights"]
    H, E, (B, T) = p["U"].shape[1], len(emb), ids.shape
    both, back = _both(ids.astype(np.intp), lens)
    state = np.zeros((2, H + E + 1, B), np.float32)
    state[:, -1] = 1
    h, chars = state[:, :H], state[:, H : H + E]
    c, small = np.zeros((2, H, B), np.float32), np.empty((2, H, B), np.float32)
    g, tmp = np.empty((2, 4 * H, B), np.float32), np.empty((2, 4 * H, B), np.float32)
    out = np.empty((T, 2, H, B), np.float32)
    enter, keep, leave, new = (g[:, k * H : (k + 1) * H] for k in range(4))
    sig = g[:, : 3 * H]
    for t in range(T):
        emb.take(both[t, 0], axis=1, out=chars[0], mode="clip")
        emb.take(both[t, 1], axis=1, out=chars[1], mode="clip")
        np.matmul(w, state, out=g)
        np.abs(g, out=tmp)  # x / (1 + |x|): a bounded activation without a transcendental function
        tmp += 1
        g /= tmp
        sig += 1
        c *= keep
        np.multiply(enter, new, out=small)
        c += small
        c *= 0.5
        np.abs(c, out=small)
        small += 1
        np.divide(c, small, out=small)
        np.multiply(small, leave, out=h)
        out[t] = h
    part = lambda m, o: np.matmul(np.ascontiguousarray(m.T * 0.5), o)
    e = part(p["Wo"][:H], out[:, 0]).transpose(1, 2, 0)
    e = e + part(p["Wo"][H:], out[:, 1]).transpose(1, 2, 0)[:, np.arange(B)[:, None], back.T]
    return e + p["bo"][:, None, None]


def viterbi(p: dict, em: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """(B, T) best tags of (T, K, B) scores, texts ordered by length; beyond a length the tags mean nothing."""
    T, K, B = em.shape
    trans, score = p["trans"].astype(np.float32)[:, :, None], em[0].copy()
    ptr = np.empty((T, K, B), np.int8)
    m = np.empty((K, K, B), np.float32)
    first = np.searchsorted(lens, np.arange(T), side="right")  # texts before it have ended
    for t in range(1, T):
        k = first[t]
        part = m[:, :, k:]
        np.add(score[:, None, k:], trans, out=part)
        ptr[t, :, k:] = part.argmax(0)
        np.max(part, axis=0, out=score[:, k:])
        score[:, k:] += em[t, :, k:]
    tags = np.zeros((T, B), np.int8)
    cur, rows = score.argmax(0), np.arange(B)
    for t in range(T - 1, -1, -1):
        k = first[t]
        tags[t, k:] = cur[k:]
        if t:
            cur[k:] = ptr[t, cur[k:], rows[k:]]
    return tags.T


# --------------------------------------------------------------------------- training


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (np.log(np.exp(a - m).sum(axis, keepdims=True)) + m).squeeze(axis)


def loss_and_grads(p: dict, ids: np.ndarray, lens: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean CRF negative log-likelihood per character and its gradients."""
    H, (B, T) = p["U"].shape[1], ids.shape
    both, back = _both(ids, lens)
    table = (np.matmul(p["emb"][None], p["Wx"]) + p["b"]).astype(np.float32)
    h, c = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
    hs, cs, gs, tc = (np.empty((T, 2, B, n), np.float32) for n in (H, H, 4 * H, H))
    for t in range(T):
        g = np.matmul(h, p["U"])
        g[0] += table[0][both[t, 0]]
        g[1] += table[1][both[t, 1]]
        g /= 1 + np.abs(g)
        g[:, :, : 3 * H] = 0.5 * g[:, :, : 3 * H] + 0.5
        c = g[:, :, H : 2 * H] * c + g[:, :, :H] * g[:, :, 3 * H :]
        tc[t] = c / (1 + np.abs(c))
        h = g[:, :, 2 * H : 3 * H] * tc[t]
        hs[t], cs[t], gs[t] = h, c, g
    bw = np.take_along_axis(hs[:, 1], back[:, :, None], 0)
    feat = np.concatenate([hs[:, 0], bw], 2)
    em = (feat @ p["Wo"] + p["bo"]).astype(np.float64)
    tr, live = p["trans"].astype(np.float64), np.arange(T)[:, None] < lens[None]
    al = np.empty_like(em)
    al[0] = em[0]
    for t in range(1, T):
        al[t] = np.where(live[t][:, None], _lse(al[t - 1][:, :, None] + tr, 1) + em[t], al[t - 1])
    logz = _lse(al[-1], 1)
    be = np.zeros_like(em)
    for t in range(T - 2, -1, -1):
        be[t] = np.where(live[t + 1][:, None], _lse(tr[None] + (em[t + 1] + be[t + 1])[:, None, :], 2), 0)
    marg = np.exp(al + be - logz[None, :, None]) * live[:, :, None]
    yt, rows, n = y.T, np.arange(B), float(lens.sum())
    gold = (np.take_along_axis(em, yt[:, :, None], 2)[:, :, 0] * live).sum(0)
    pair = live[1:]
    gold = gold + (tr[yt[:-1], yt[1:]] * pair).sum(0)
    d_em = marg.copy()
    np.put_along_axis(d_em, yt[:, :, None], np.take_along_axis(d_em, yt[:, :, None], 2) - live[:, :, None], 2)
    d_tr = np.zeros_like(tr)
    for t in range(1, T):
        w = np.exp(al[t - 1][:, :, None] + tr + (em[t] + be[t] - logz[:, None])[:, None, :]) * live[t][:, None, None]
        d_tr += w.sum(0)
    np.subtract.at(d_tr, (yt[:-1][pair], yt[1:][pair]), 1.0)
    d_em = (d_em / n).astype(np.float32)
    gr = {"trans": (d_tr / n).astype(np.float32), "bo": d_em.sum((0, 1)), "Wo": feat.reshape(-1, 2 * H).T @ d_em.reshape(-1, len(TAGS))}
    d_feat = d_em @ p["Wo"].T
    d_hs = np.zeros((T, 2, B, H), np.float32)
    d_hs[:, 0] = d_feat[:, :, :H]
    for t in range(T):
        d_hs[back[t], 1, rows] += d_feat[t, :, H:]
    d_table = np.zeros((2, VOCAB, 4 * H), np.float32)
    gr["U"] = np.zeros_like(p["U"])
    dh, dc = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
    for t in range(T - 1, -1, -1):
        g = gs[t]
        i, f, o, u = (g[:, :, k * H : (k + 1) * H] for k in range(4))
        dh = dh + d_hs[t]
        dc = dc + dh * o * (1 - np.abs(tc[t])) ** 2
        prev = cs[t - 1] if t else np.zeros_like(c)
        slope = lambda s: 0.5 * (1 - np.abs(2 * s - 1)) ** 2
        dg = np.concatenate([dc * u * slope(i), dc * prev * slope(f), dh * tc[t] * slope(o), dc * i * (1 - np.abs(u)) ** 2], 2)
        hp = hs[t - 1] if t else np.zeros_like(h)
        gr["U"] += np.matmul(hp.transpose(0, 2, 1), dg)
        for k in (0, 1):
            one = np.zeros((B, VOCAB), np.float32)
            one[rows, both[t, k]] = 1
            d_table[k] += one.T @ dg[k]
        dh = np.matmul(dg, p["U"].transpose(0, 2, 1))
        dc = dc * f
    gr["b"] = d_table.sum(1, keepdims=True)
    gr["Wx"] = np.matmul(p["emb"].T[None], d_table)
    gr["emb"] = np.matmul(d_table, p["Wx"].transpose(0, 2, 1)).sum(0)
    return float((logz - gold).sum() / n), gr


def train(batches, hidden: int = 16, emb: int = 16, seed: int = 1, rate: float = 0.01, steps: int = 2000, say=None) -> dict:
    """Adam over an iterator of (ids, lens, tags) batches, with a cosine rate."""
    p = init_params(hidden, emb, seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step, (ids, lens, y) in zip(range(1, steps + 1), batches):
        loss, gr = loss_and_grads(p, ids, lens, y)
        norm = np.sqrt(sum(float((x**2).sum()) for x in gr.values()))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        lr = rate * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * step / steps))) * min(1, step / 50)
        for k in p:
            g = gr[k] * clip
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if say and step % 100 == 0:
            say(step, loss)
    return p


# --------------------------------------------------------------------------- inference over whole texts


def cut(length: int) -> list[tuple[int, int]]:
    """Overlapping windows over a whole text: at most WINDOW + OVERLAP long, OVERLAP shared."""
    if length <= WINDOW + OVERLAP:
        return [(0, length)]
    out, at = [], 0
    while length - at > WINDOW + OVERLAP:
        out.append((at, at + WINDOW))
        at += WINDOW - OVERLAP
    return [*out, (at, length)]


def stretches(trans: np.ndarray, em: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, after) of the stretches outside of which the best path of each text is O throughout.

    em (tags, characters) holds the scores of all texts end to end, starts where each begins.  A run of other tags
    gains at most the sum of its score leads over O, and of what inner transitions are better than
    O to O, and pays at least for one change from or to O, unless it is the whole text.  A character
    may be part of such a run only if the largest sum of neighbours that holds it reaches the price.
    """
    inner = max(0.0, float(trans[1:, 1:].max() - trans[0, 0]))
    price = float(trans[0, 0] - max(trans[0, 1:].max(), trans[1:, 0].max()))
    lead = (em[1:].max(0) - em[0] + inner).astype(np.float64)

    def upto(x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The largest sum of neighbours that ends at each character, within its text."""
        step = x.copy()
        step[first] -= 1e6  # sums don't reach over the start of a text
        g = np.cumsum(step)
        return np.maximum(x, np.concatenate([[-np.inf], g[1:] - np.minimum.accumulate(g)[:-1]]))

    ends = np.append(starts[1:], len(lead)) - 1
    held = upto(lead, starts) + upto(lead[::-1], len(lead) - 1 - ends[::-1])[::-1] - lead >= price - 1e-3
    held |= np.repeat(np.add.reduceat(lead, starts) >= -1e-3, ends - starts + 1)
    edge = np.zeros(len(lead) + 1, bool)
    edge[starts] = edge[-1] = True
    prev, nxt = np.append(False, held[:-1]), np.append(held[1:], False)
    return np.flatnonzero(held & (~prev | edge[:-1])), np.flatnonzero(held & (~nxt | edge[1:])) + 1


def decode(p: dict, em: np.ndarray, starts: np.ndarray, most: int = 400_000) -> np.ndarray:
    """The best path of each of the texts laid end to end.  Each stretch that may hold another tag than O is decoded
    by itself, with O before and after it, which gives the best path of the whole text."""
    tags = np.zeros(em.shape[1], np.int8)
    a, b = stretches(p["trans"], em, starts)
    opens, closes = np.isin(a, starts, invert=True), np.isin(b, np.append(starts[1:], em.shape[1]), invert=True)
    order = np.argsort(b - a, kind="stable")
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * (b - a)[order[at + n]] <= most:
            n += 1
        k = order[at : at + n]
        lens = b[k] - a[k]
        where = a[k][:, None] + np.minimum(np.arange(lens[-1]), lens[:, None] - 1)
        x = em[:, where]
        x[:, opens[k], 0] += p["trans"][0][:, None]
        x[:, closes[k], lens[closes[k]] - 1] += p["trans"][:, :1]
        best = viterbi(p, np.ascontiguousarray(x.transpose(2, 0, 1)), lens)
        live = np.arange(lens[-1]) < lens[:, None]
        tags[where[live]] = best[live]
        at += n
    return tags


def tag_texts(p: dict, texts: list[str], cache: dict | None = None, batch_chars: int = 150_000) -> list[np.ndarray]:
    """Tags of every character of every text: windows are scored in batches of like length, each
    character takes the scores of the window it lies deepest in, and each whole text is decoded."""
    cache = {} if cache is None else cache
    codes = [encode(t) for t in texts]
    wins = [(b - a, i, a, b) for i, x in enumerate(codes) for a, b in cut(len(x)) if b > a]
    wins.sort(key=lambda w: w[0])
    size = np.array([len(x) for x in codes], np.int64)
    scores = np.empty((len(TAGS), int(size.sum())), np.float32)
    start = np.cumsum(size) - size
    at = 0
    while at < len(wins):
        n = 1
        while at + n < len(wins) and (n + 1) * wins[at + n][0] <= batch_chars and wins[at + n][0] <= 1.15 * wins[at][0] + 8:
            n += 1
        part = wins[at : at + n]
        ids = np.zeros((n, part[-1][0]), np.int32)
        for k, (m, i, a, b) in enumerate(part):
            ids[k, :m] = codes[i][a:b]
        em = emissions(p, ids, np.array([w[0] for w in part]), cache)
        for k, (m, i, a, b) in enumerate(part):
            lo = a + OVERLAP // 2 if a else 0
            hi = b - OVERLAP // 2 if b < len(codes[i]) else b
            scores[:, start[i] + lo : start[i] + hi] = em[:, k, lo - a : hi - a]
        at += n
    if not scores.size:
        return [np.zeros(0, np.int8) for _ in codes]
    tags = decode(p, scores, start[size > 0])
    return [tags[a : a + n] for a, n in zip(start, size)]
