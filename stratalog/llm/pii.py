"""Personal information inside free text, found by a character-level BiLSTM-CRF and replaced by placeholders.

The tagger (pii_model, trained by pii_train) reads every character of every text.  Its spans are
widened to whole words and then checked for what their type must have: digits enough, an at sign, a
street word, two words of a name.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import pii_model as M

MODEL = os.path.join(os.path.dirname(os.path.abspath(__file__)), "models", "pii.npz")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Words of streets, and words that announce a number that identifies no person.
STREET = re.compile(
    r"(?<!\w)(?:lane|road|close|avenue|street|st|drive|court|square|allee|weg|\w*stra(?:ß|ss)e|\w*str|\w*platz|gasse|rue|impasse|boulevard|chemin|place|quai|allée"
    r"|avda|avenida|c/|calle|plaza|paseo|camino|ул|улица|пер|переулок|пр|просп|проспект|бул|бульвар|вул|вулиця|пров|провулок|площадь|площа)(?!\w)|c/",
    re.I,
)
OTHER_NUMBER = re.compile(r"(?:trace|sha|hash|commit|build|version|run|section|row|line|id=)\W*$", re.I)
TIME = re.compile(r"^\W*(?:\d{4}-\d\d-\d\d|\d\d:\d\d|\d{1,3}(?:\.\d{1,3}){3}\b)")


def load(path: str = MODEL) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def snap(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without surrounding space and punctuation, widened to whole words."""
    while a < b and not text[a].isalnum() and text[a] not in "+(":
        a += 1
    while b > a and not text[b - 1].isalnum() and text[b - 1] != ".":
        b -= 1
    while a > 0 and a < b and text[a].isalnum() and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and b > a and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    return a, b


def holds(kind: str, text: str, a: int, b: int) -> bool:
    """Whether the span has what a place of its type must have."""
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        return bool(re.search(r"(?:@|[\[(]at[\])])\s?[\w-]+.*[^\W\d_]{2,}$", s, re.I))
    if kind == "phone":
        return digits >= 9 and not TIME.match(s) and not re.search(r"[^\W\d_]", s) or s.startswith("+") and digits >= 7
    if kind == "id_number":
        return digits >= 7 and re.fullmatch(r"[A-Z]{0,2}[\d -]+[A-Z]?", s, re.I) is not None and not TIME.match(s) and not OTHER_NUMBER.search(text[max(0, a - 16) : a])
    if kind == "address":
        return digits >= 1 and STREET.search(s) is not None
    words = re.findall(r"[^\W\d_]+", s)
    return not digits and len(words) >= 2 and any(len(w) > 1 for w in words)


def places(text: str, tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) of the places that the tags name and that hold."""
    if not tags.any():
        return []
    edges = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    raw: list[list] = []
    for x, y in zip(edges, edges[1:]):
        if not tags[x]:
            continue
        kind = M.TAGS[tags[x]]
        gap = 22 if kind == "address" else 3
        # parts of one place that the tags leave apart
        if raw and raw[-1][2] == kind and x - raw[-1][1] <= gap and not re.search(r"[\n;|]|[.!?]\s", text[raw[-1][1] : x]):
            raw[-1][1] = y
        else:
            raw.append([x, y, kind])
    out: list[tuple[int, int, str]] = []
    for x, y, kind in raw:
        parts = [(x, y)]
        if kind in ("name", "phone", "id_number", "email") and "\n" in text[x:y].strip():
            parts = [(x + m.start(), x + m.end()) for m in re.finditer(r"[^\n]+", text[x:y])]
        for a, b in parts:
            a, b = snap(text, int(a), int(b))
            if kind == "address" and a < b and not STREET.search(text[a:b]):
                line = text.rfind("\n", 0, a) + 1
                if near := [m for m in STREET.finditer(text, max(line, a - 32), a)]:
                    a = near[-1].start()
            if a < b and holds(kind, text, a, b) and not (out and out[-1][1] > a):
                out.append((a, b, kind))
    return out


def _scan(df: DataFrame, key: str, text: str, schema: str, rows, path: str) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    params = spark.sparkContext.broadcast(load(path))  # some tens of kilobytes
    src = df.select(F.col(key), F.col(text).alias("_text"))
    kind = src.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for b in batches:
            for at in range(0, len(b), 4_000):
                p = b.iloc[at : at + 4_000]
                texts = [t if isinstance(t, str) else None for t in p["_text"]]
                once = sorted({t for t in texts if t})
                found = dict(zip(once, (places(t, g) for t, g in zip(once, M.tag_texts(params.value, once, cache)))))
                yield pd.DataFrame([r for k, t in zip(p[key], texts) for r in rows(k, t, found.get(t, []))], columns=names)

    return src.mapInPandas(run, f"`{key}` {kind}, {schema}")


def find(df: DataFrame, key: str, text: str, path: str = MODEL) -> DataFrame:
    """(key, pii_type, nth, start, end): a row for each place; nth counts within a text and type, start and end are code points.

    Null, empty and blank texts have no place.  Repeated rows each give their rows; texts of any
    length are read whole; an empty table gives an empty result; other columns are ignored.
    """

    def rows(k, t, found):
        n: dict[str, int] = {}
        for a, b, kind in found:
            n[kind] = n.get(kind, 0) + 1
            yield k, kind, n[kind], a, b

    return _scan(df, key, text, "pii_type string, nth long, start long, end long", rows, path)


def redact(df: DataFrame, key: str, text: str, path: str = MODEL) -> DataFrame:
    """(key, text, places): every text with each place replaced by the placeholder of its type; a null text stays null."""

    def rows(k, t, found):
        out, at = [], 0
        for a, b, kind in found:
            out += [t[at:a], PLACEHOLDER[kind]]
            at = b
        yield k, None if t is None else "".join([*out, t[at:]]), len(found)

    return _scan(df, key, text, "text string, places long", rows, path)
