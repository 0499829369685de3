"""Token-budgeted chunks of blocks, with exact spans and full coverage."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.vectors import TERM
from ..session import ship

# What is kept free of a limit, the boundaries from best to least, and how far back one is looked for.
RESERVE = 4
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
REACH = 256


@dataclass(frozen=True)
class Policy:
    """How blocks are cut; built from the strictest provider's limit."""

    limit: int
    content: int
    overlap: int
    version: str = "2"

    @property
    def id(self) -> str:
        return f"canonical_token_chunks:{self.version};limit={self.limit};content={self.content};fallback_overlap={self.overlap};reserve={RESERVE}"


def policy(limits: list[int], overheads: list[int] = (0,), version: str = "2", content: int | None = None) -> Policy:
    """The policy for providers with these input limits and special-token overheads."""
    if version not in ("1", "2"):
        raise ValueError(f"unknown chunk policy version {version}")
    if not limits:
        raise ValueError("a provider must state its limit")
    budget = min(limits) - max(overheads) - RESERVE if content is None else content
    if not 0 < budget <= min(limits):
        raise ValueError(f"no room for content: {budget} of {min(limits)}")
    return Policy(min(limits), budget, max(1, budget * 15 // 100 if version == "1" else budget // 16), version)


class Strictest:
    """Several tokenizers as one: a text has as many tokens as the one that counts most, and ends where the first of them is full.

    A tokenizer has spans(text): the (start, end) of its tokens in order.
    """

    def __init__(self, *tokenizers):
        self.all = tokenizers

    def count(self, text: str) -> int:
        return max(len(t.spans(text)) for t in self.all)

    def fits(self, text: str, limit: int) -> bool:
        return all(len(t.spans(text)) <= limit for t in self.all)

    def end(self, text: str, limit: int) -> int:
        """How many characters from the start fit into limit tokens of every tokenizer."""
        return min((s[limit][0] if len(s := t.spans(text)) > limit else len(text)) for t in self.all)


class Words:
    """The tokenizer of words."""

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.finditer(TERM, text)]


class PublicVocabulary:
    """A published tokenizer of a file (tokenizers' JSON); its offsets are read once for a text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [(a, b) for a, b in self.model.encode(text, add_special_tokens=False).offsets if b > a]


def cut(text: str, p: Policy, tokenizer: Words | PublicVocabulary | None = None) -> list[tuple[int, int, int, str, int]]:
    """(start, end, tokens, reason, overlap tokens) of a text's chunks: tokens are words unless a tokenizer is given, counted from their ends.

    A chunk takes as many tokens as fit and, where it can, ends at the best boundary of its last
    characters; one that finds none is continued with an overlap (in version 1 every chunk is).
    """
    tok = (tokenizer or Words()).spans(text)
    starts, ends = [a for a, _ in tok], [b for _, b in tok]
    count = lambda a, b: max(0, bisect_right(ends, b) - bisect_right(starts, a - 1)) if b > a else 0
    out: list[tuple[int, int, int, str, int]] = []
    at = 0
    while at < len(text):
        first = bisect_right(starts, at - 1)
        last = first + p.content
        if last >= len(tok):
            end, why = len(text), "whole_block" if at == 0 else "complete"
        else:
            end, why = starts[last], "token_window_fallback"
            if p.version == "2":
                for sep in SEPARATORS:
                    i = text.rfind(sep, at, end)
                    if i > at and end - (i + len(sep)) < REACH:
                        end, why = i + len(sep), "natural_boundary"
                        break
        before = out[-1][1] if out else 0
        out.append((at, end, count(at, end), why, count(at, before) if at < before else 0))
        if end >= len(text):
            break
        nxt = end
        if p.version == "1" or why == "token_window_fallback":
            inside = bisect_right(ends, end)
            nxt = max(at + 1, starts[inside - p.overlap]) if inside - p.overlap > first else end
        at = nxt
    return out


def build(blocks: DataFrame, block: str, text: str, start: str, p: Policy, tokenizer=None) -> DataFrame:
    """(id, block_id, ordinal, source_char_start, source_char_end, token_count, text, chunk_policy_id, split_reason, overlap_token_count).

    Every character of a block is in a chunk; an empty or null text has none.  tokenizer makes the
    tokenizer in each Python worker (words by default).  Cutting is
    sequential within a block and parallel over blocks.
    """
    ship(blocks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = tokenizer() if tokenizer else None
        for b in batches:
            rows = [(k, n, s + a, s + e, a, e, c, t[a:e], why, o) for k, t, s in zip(b["block_id"], b["t"], b["s"]) for n, (a, e, c, why, o) in enumerate(cut(t, p, model), 1)]
            yield pd.DataFrame(rows, columns=["block_id", "ordinal", "source_char_start", "source_char_end", "a", "e", "token_count", "text", "split_reason", "overlap_token_count"])

    src = blocks.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(block).alias("block_id"), F.col(text).alias("t"), F.col(start).cast("long").alias("s"))
    out = src.mapInPandas(run, "block_id string, ordinal long, source_char_start long, source_char_end long, a long, e long, token_count long, text string, split_reason string, overlap_token_count long")
    ident = stable_id("chunk", F.col("block_id"), F.lit(p.id), F.col("ordinal"), F.col("a"), F.col("e"))
    return out.select(ident.alias("id"), "block_id", "ordinal", "source_char_start", "source_char_end", "token_count", "text", F.lit(p.id).alias("chunk_policy_id"), "split_reason", "overlap_token_count")
