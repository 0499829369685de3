"""Identities: stable ids of parts, canonical text and content hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 32 hex digits of the SHA-256 of the parts, joined by the unit separator; null is ''."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}_" if prefix else ""), F.substring(F.sha2(text, 256), 1, 32))


@pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no function for it."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def canonical_text(text: Column) -> Column:
    """NFC, line feeds only, no blanks at line ends, no blank lines at either end."""
    t = F.regexp_replace(F.regexp_replace(nfc(text), r"\r\n?", "\n"), r"(?m)[ \t]+$", "")
    return F.regexp_replace(t, r"^\n+|\n+$", "")


def content_hash(domain: str, *parts: Column) -> Column:
    """SHA-256 of the parts as JSON, apart for each domain."""
    return F.sha2(F.concat(F.lit(f"{domain}\x00"), F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))), 256)


def batch_id(contract: Column, first: Column, last: Column, count: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", contract, first, last, count.cast("string")), 256)


def policy_fields(policy: Column) -> dict[str, Column]:
    """The numbers of a chunk policy id."""
    g = lambda p: F.regexp_extract(policy, p, 1)
    return {"version": g("canonical_token_chunks:([^;]+)"), **{k: g(f"{k}=(\\d+)").cast("int") for k in ("limit", "content", "fallback_overlap", "reserve")}}
