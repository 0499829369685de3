"""Language of texts and of the parts of mixed texts, by compression.

A segment is compressed with a raw-content zstandard dictionary of every candidate language; the
language whose dictionary leaves the fewest bytes is chosen, and a narrow margin is rejected.
Rejected segments take the language of their neighbours where these agree.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

# Languages by script, and the spellings of their labels.
CYRILLIC, LATIN = ("ru", "uk"), ("en", "de", "es", "fr")
LANGS = (*LATIN, *CYRILLIC)
SPELLINGS = {
    "en": "en eng english английский англ англійська anglais inglés ingles englisch",
    "ru": "ru rus russian русский рус російська russe ruso russisch",
    "de": "de deu ger german deutsch немецкий німецька allemand alemán aleman",
    "es": "es spa spanish español espanol castellano испанский іспанська espagnol spanisch",
    "fr": "fr fra fre french français francais французский французька francés frances französisch",
    "uk": "uk ukr ukrainian ua українська украинский ukrainien ucraniano ukrainisch",
    "mixed": "mixed mul multiple multilingual смешанный змішаний gemischt mixte mixto",
}
DOCS_PER_LANG = 300  # labelled documents from which a dictionary is made
SHORTEST, LONGEST = 100, 20_000  # characters of such a document: the sample that is fetched stays within 300 x 20,000 a language
DICT_BYTES = 64_000
LEVEL = 3
MARGIN = 0.04  # least lead of the best language over the second, as a share of the second's bytes
CLEAR = 0.2  # a segment with a smaller lead goes with its neighbours if these are clear and agree

WORD = re.compile(r"[^\W_]+")
FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
SENTENCE = re.compile(r"[^\s.!?…][^\r\n]*?(?:[.!?…]+(?=\s|\Z)|(?=\s/\s)|(?=[\r\n])|\Z)")
_CYR = re.compile("[Ѐ-ӿ]")
_LAT = re.compile("[A-Za-zÀ-ɏ]")
_MAIL = re.compile(r"\S+@\S+")


def label(c: Column) -> Column:
    """A label in its usual code: en, ru, de, es, fr, uk or mixed; null where it says nothing."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"^([a-z]{2,3})[-_][a-z0-9]+$", "$1")
    table = F.create_map(*[F.lit(v) for code, words in SPELLINGS.items() for w in words.split() for v in (w, code)])
    return F.element_at(table, x)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences outside code fences, as code points."""
    t = FENCE.sub(lambda m: "\n" * (m.end() - m.start()), text)
    return [m.span() for m in SENTENCE.finditer(t)]


def _script(segment: str) -> bool | None:
    """Whether most letters are Cyrillic; None without letters."""
    cyr, lat = len(_CYR.findall(segment)), len(_LAT.findall(segment))
    return cyr > lat if cyr or lat else None


class Classifier:
    """Compressors of all languages over their dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.by: dict[str, zstandard.ZstdCompressor] = {}
        for lang, data in dictionaries.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)

    def best(self, segment: str) -> tuple[str | None, float]:
        """(language, margin); None without letters or where the margin is narrow."""
        cyr, lat = len(_CYR.findall(segment)), len(_LAT.findall(segment))
        if not cyr and not lat:
            return None, 0.0
        data = segment.lower().encode("utf-8", "replace")
        sizes = sorted((len(self.by[k].compress(data)), k) for k in (CYRILLIC if cyr > lat else LATIN) if k in self.by)
        if not sizes:
            return None, 0.0
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return (sizes[0][1] if margin >= MARGIN else None), margin

    def runs(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(language, confidence, words, start, end) of the unbroken stretches of one language.

        A sentence of no clear language takes its neighbours' language, if that has its script.
        """
        parts, scripts = [], []
        for a, b in sentences(text):
            s = text[a:b]
            n = len(WORD.findall(s))
            if n:
                lang, margin = self.best(s)
                parts.append([lang, margin, n, a, b])
                scripts.append(_script(_MAIL.sub(" ", s)))  # an address has no script
        known = [p[0] if p[1] >= CLEAR else None for p in parts]
        ahead, nxt = [None] * len(known), None
        for k in range(len(known) - 1, -1, -1):
            ahead[k] = nxt = known[k] or nxt
        before = None
        for k, p in enumerate(parts):
            if known[k] is None:
                left, right = before, ahead[k]
                near = left or right
                if (left == right or left is None or right is None) and near and scripts[k] in (None, near in CYRILLIC):
                    p[0] = near
            before = known[k] or before
        out: list[list] = []
        for lang, margin, n, a, b in parts:
            if out and out[-1][0] == lang:
                r = out[-1]
                r[1], r[2], r[4] = (r[1] * r[2] + margin * n) / (r[2] + n), r[2] + n, b
            else:
                out.append([lang, margin, n, a, b])
        return [tuple(r) for r in out]


def dictionaries(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = DOCS_PER_LANG, shortest: int = SHORTEST, longest: int = LONGEST) -> dict[str, bytes]:
    """A dictionary for each language, from at most per_lang labelled documents of it.

    The documents are whole ones of more than shortest and at most longest characters, those of the
    smallest hash of their key: a bounded sample that the classifier is fitted on.  As labels may be wrong, the
    sample is classified with a first set of dictionaries and only what agrees with its label
    makes the final ones.
    """
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), label(F.col(lang)).alias("l")).where(F.col("l").isin(*LANGS) & (F.length("t") > shortest) & (F.length("t") <= longest))
    w = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    sample = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_lang).select("l", "t").collect()
    by: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r["l"], r["t"])):
        by.setdefault(r["l"], []).extend(s.lower() for s in (r["t"][a:b].strip() for a, b in sentences(r["t"])) if s[:1] not in "#-`>" and len(WORD.findall(s)) >= 5)

    def pack(lines: dict[str, list[str]]) -> dict[str, bytes]:
        out = {}
        for k, v in lines.items():
            v = v[:]
            random.Random(5).shuffle(v)
            own = _CYR if k in CYRILLIC else _LAT
            data = "\n".join(s for s in v if len(own.findall(s)) > 0.5 * len(s)).encode("utf-8", "replace")[:DICT_BYTES]
            if len(data) > 200:
                out[k] = data
        return out

    first = Classifier(pack(by))
    return pack({k: [s for s in v if first.best(s)[0] == k] for k, v in by.items()})


def runs(df: DataFrame, key: str, text: str, dicts: dict[str, bytes]) -> DataFrame:
    """(key, nth, lang, confidence, words, start, end, all_words): the stretches of one language of every whole text.

    Code fences (also unclosed ones) are left out; confidence is the margin, weighted by words;
    lang is null where no language leads clearly; start and end are code points.  A null, empty or
    blank text, or one without a word, has no row.  Repeated rows each give their rows; other
    columns are ignored.
    """
    ship(df.sparkSession)
    src = df.select(F.col(key), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    kind = src.schema[key].dataType.simpleString()
    cols = [key, "nth", "lang", "confidence", "words", "start", "end", "all_words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Classifier(dicts)
        for b in batches:
            rows = []
            for k, t in zip(b[key], b["_text"]):
                found = c.runs(t)
                n = sum(r[2] for r in found)
                rows += [(k, j + 1, *r, n) for j, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=cols)

    return src.mapInPandas(run, f"`{key}` {kind}, nth int, lang string, confidence double, words int, start int, end int, all_words int")


def languages(df: DataFrame, key: str, text: str, dicts: dict[str, bytes]) -> DataFrame:
    """(key, lang, confidence, langs): a text's main language, how sure it is, and all its languages in order of words.

    Texts without a clear language have no row; keys are taken as unique.
    """
    r = runs(df, key, text, dicts).where("lang is not null")
    by = r.groupBy(key, "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("sure"))
    by = by.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("n"), "lang", "sure"))).alias("a"))  # at most one entry a language
    return by.select(key, F.col("a")[0]["lang"].alias("lang"), F.col("a")[0]["sure"].alias("confidence"), F.transform("a", lambda x: x["lang"]).alias("langs"))


def wrong_labels(df: DataFrame, key: str, text: str, given: str, dicts: dict[str, bytes], least_words: int = 3) -> DataFrame:
    """(key, lang): one row for each language of every text whose label is missing, says nothing or is not its language.

    Two languages are rightly labelled as mixed; a right label in another spelling is right.
    """
    r = runs(df, key, text, dicts).where("lang is not null").groupBy(key, "lang").agg(F.sum("words").alias("words"), F.max("all_words").alias("n"))
    found = r.where((F.col("words") >= least_words) | (F.col("words") == F.col("n"))).groupBy(key).agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    own = df.select(F.col(key), label(F.col(given)).alias("said")).distinct()
    right = F.when(F.size("langs") > 1, F.col("said") == "mixed").otherwise(F.col("said") == F.col("langs")[0])
    return found.join(own, key).where(~F.coalesce(right, F.lit(False))).select(key, F.explode("langs").alias("lang")).distinct()
