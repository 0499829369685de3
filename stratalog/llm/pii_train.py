"""python -m stratalog.llm.pii_train MESSAGES.parquet OUT.npz: train the personal-information tagger.

Reads a bounded sample of messages (SAMPLE rows at most), labels spans (pii_labels), varies the
labelled values (other names, other digits) so that the tagger learns form and context and not
the sample's own values, and fits the BiLSTM-CRF of pii_model.
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from . import pii_labels as L
from . import pii_model as M

SAMPLE = 30_000


def made_name(word: str, r: random.Random) -> str:
    """A made-up name word in the script and case of the given one."""
    cyr = bool(re.search(r"[Ѐ-ӿ]", word))
    on, vo, en = (("бвгдзклмнпрстфхш", "аеиоуя", ["", "н", "в", "нко", "ский", "р", "ова", "ев", "юк", "ль"]) if cyr else ("bcdfghjklmnprstvwz", "aeiou", ["", "n", "r", "son", "ley", "mann", "ez", "el", "ck", "ov"]))
    w = "".join(r.choice(on) + r.choice(vo) + (r.choice(on) if r.random() < 0.3 else "") for _ in range(r.randint(1, 3))) + r.choice(en)
    return w.upper() if word.isupper() and len(word) > 1 else w if word.islower() else w[:1].upper() + w[1:]


def varied(text: str, sp: list[tuple[int, int, str]], r: random.Random, share: float) -> tuple[str, list[tuple[int, int, str]]]:
    out, new, at = [], [], 0
    for a, b, kind in sp:
        s = text[a:b]
        if r.random() < share:
            if kind == "name":
                s = re.sub(r"[^\W\d_]{3,}", lambda m: made_name(m.group(0), r), s)
            elif kind in ("phone", "address"):
                s = re.sub(r"(?<!^)(?<!\+)\d", lambda m: str(r.randint(0, 9)), s)
            elif kind == "id_number":
                s = s[:2] + re.sub(r"\d", lambda m: str(r.randint(0, 9)), s[2:])
        out.append(text[at:a])
        start = sum(map(len, out))
        out.append(s)
        new.append((start, start + len(s), kind))
        at = b
    return "".join([*out, text[at:]]), new


def batches(texts: list[str], names, r: random.Random, size: int = 96, length: int = 200, vary: float = 0.35):
    """Endless (ids, lens, tags) batches of random windows; half of them touch a span."""
    lab = [(t, L.spans(t, names)) for t in texts]
    with_, without = [x for x in lab if x[1]], [x for x in lab if not x[1]]
    while True:
        ids, y, lens = np.zeros((size, length), np.int32), np.zeros((size, length), np.int64), np.zeros(size, np.int64)
        for k in range(size):
            t, sp = r.choice(with_ if k % 4 else without or with_)
            if r.random() < 0.25 and sp and without:  # the same span in other company
                o = r.choice(without)[0]
                o += r.choice(["\n", " ", "\n\n"])
                t, sp = o + t, [(a + len(o), b + len(o), c) for a, b, c in sp]
            t, sp = varied(t, sp, r, vary)
            if r.random() < 0.04:
                t = t.upper() if len(t.upper()) == len(t) else t
            elif r.random() < 0.04:
                t = t.lower() if len(t.lower()) == len(t) else t
            tag = np.zeros(len(t), np.int64)
            for a, b, c in sp:
                tag[a:b] = M.TAGS.index(c)
            mid = r.choice(sp)[0] if sp else r.randrange(max(1, len(t)))
            a = max(0, min(mid - r.randrange(length), len(t) - length))
            x = M.encode(t)[a : a + length]
            ids[k, : len(x)], y[k, : len(x)], lens[k] = x, tag[a : a + length], max(1, len(x))
        yield ids, lens, y


def counts(tags: np.ndarray, text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    edge = np.flatnonzero(np.diff(tags, prepend=0)) if len(tags) else []
    for e in edge:
        if tags[e]:
            out[M.TAGS[tags[e]]] = out.get(M.TAGS[tags[e]], 0) + 1
    return out


def main(path: str, to: str, hidden: int = 16, steps: int = 2500, seed: int = 1) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(path, columns=["raw_text"])["raw_text"].to_pylist() if t and t.strip()][:SAMPLE]
    r = random.Random(seed)
    r.shuffle(texts)
    held, texts = texts[: len(texts) // 10], texts[len(texts) // 10 :]
    words, _ = L.name_words(texts)
    names = L.name_pattern(words)
    say = lambda *x: print(*x, flush=True)
    say("name words", len(words))
    p = M.train(batches(texts, names, r), hidden=hidden, seed=seed, steps=steps, say=lambda s, x: say(s, round(x, 5)))
    np.savez(to, **{k: v.astype(np.float16 if k != "trans" else np.float32) for k, v in p.items()})
    p = load(to)
    got, want, hit = {}, {}, {}
    for t, tags in zip(held, M.tag_texts(p, held)):
        w: dict[str, int] = {}
        for _, _, c in L.spans(t, names):
            w[c] = w.get(c, 0) + 1
        g = counts(tags, t)
        for c in M.TAGS[1:]:
            got[c], want[c] = got.get(c, 0) + g.get(c, 0), want.get(c, 0) + w.get(c, 0)
            hit[c] = hit.get(c, 0) + min(g.get(c, 0), w.get(c, 0))
    for c in M.TAGS[1:]:
        say(c, "precision", round(hit[c] / max(1, got[c]), 4), "recall", round(hit[c] / max(1, want[c]), 4), "of", want[c])


def load(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


if __name__ == "__main__":
    main(*sys.argv[1:3], **{k: int(v) for k, v in (x.split("=") for x in sys.argv[3:])})
