"""Encoding of whole texts with a public byte-level BPE vocabulary, by prefixes shared in a trie.

The encoding of a word has one last token for each of its prefixes, and the last token of a prefix
follows from those of shorter prefixes: token t ends prefix w if t encodes to itself and the pair
(last token of w without t, t) stays as it is when its bytes are encoded together.  Distinct words
are visited in sorted order, which is a depth-first walk of their trie: the states of the prefix
shared with the word before are kept, so each prefix is computed once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published pre-tokenization pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_CACHED = 400_000  # words whose ids one task keeps


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TrieEncoder:
    """Ids of words by last-token states of shared prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {i: b for b, i in ranks.items()}
        lengths: dict[int, set[int]] = {}
        for b in ranks:
            lengths.setdefault(b[-1], set()).add(len(b))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.whole: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The plain definition: join the neighbours of lowest rank until none can be joined."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _stays(self, t: int) -> bool:
        if (r := self.whole.get(t)) is None:
            r = self.whole[t] = self.merge(self.text[t]) == [t]
        return r

    def _fits(self, a: int, t: int) -> bool:
        if (r := self.pairs.get((a, t))) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            r = self.pairs[a, t] = self.merge(self.text[a] + self.text[t]) == [a, t]
        return r

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of every distinct word."""
        out: dict[bytes, list[int]] = {}
        last: list[int] = []  # last[d]: the last token of the first d + 1 bytes
        before = b""
        ranks, lengths = self.ranks, self.lengths
        for w in sorted(set(words)):
            if not w:
                continue
            shared, most = 0, min(len(w), len(before))
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del last[shared:]
            for d in range(shared + 1, len(w) + 1):
                for n in lengths.get(w[d - 1], ()):
                    if n > d:
                        continue
                    t = ranks.get(w[d - n : d])
                    if t is not None and self._stays(t) and (n == d or self._fits(last[d - n - 1], t)):
                        last.append(t)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids, d = [], len(w)
            while d:
                ids.append(last[d - 1])
                d -= len(self.text[last[d - 1]])
            out[w] = ids[::-1]
            before = w
        return out


def encode_all(enc: TrieEncoder, texts: list[str | None], cache: dict[str, list[int]], pattern: regex.Pattern) -> list[list[int]]:
    """Ids of every text; the cache of words is carried from call to call."""
    cut = [pattern.findall(t) if t else [] for t in texts]
    new = {w for ws in cut for w in ws if w not in cache}
    if len(cache) + len(new) > MOST_CACHED:
        cache.clear()
        new = {w for ws in cut for w in ws}
    if new:
        by = {w.encode("utf-8", "surrogatepass"): w for w in new}
        for b, ids in enc.encode_words(by).items():
            cache[by[b]] = ids
    return [[i for w in ws for i in cache[w]] for ws in cut]


def encode(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", only_count: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, ids): ids of each whole text without special tokens, a row for each row.

    Null and empty texts have an empty list; strings of special tokens in a text are ordinary text.
    Rows with a null key are kept.  only_count gives n_tokens in place of ids.  Each Arrow batch
    encodes its distinct words together; nothing is shuffled.  The vocabulary, of fixed size, is
    sent to the executors.
    """
    spark = df.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, cache, pat = TrieEncoder(ranks.value), {}, regex.compile(PATTERN)
        for b in batches:
            ids: list = []
            texts = b["_text"].tolist()
            for k in range(0, len(texts), 500):
                part = encode_all(enc, texts[k : k + 500], cache, pat)
                ids += [len(x) for x in part] if only_count else part
            out = b.drop(columns="_text")
            out["n_tokens" if only_count else "ids"] = ids
            yield out

    src = df.select(F.col(key), *keep, F.col(text).alias("_text"))
    schema = T.StructType([f for f in src.schema.fields if f.name != "_text"])
    schema = schema.add("n_tokens", "long") if only_count else schema.add("ids", T.ArrayType(T.IntegerType()))
    return src.mapInPandas(run, schema)


def token_counts(spark: SparkSession, df: DataFrame, key: str, text: str, **kw) -> DataFrame:
    return encode(df, key, text, only_count=True, **kw)
