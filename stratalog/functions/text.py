"""Column functions over text: all are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Introductions that carry no information, title words that name nothing, English function and question
# words, the line of a code fence and the form of an address.
INTRODUCTIONS = ("bgp", "yes", "no", "correct", "right", "верно", "да", "нет", "вот это и есть")
STOP_WORDS = tuple(
    "the and for with from into chat new project analysis assistant python rust linux windows memory model models data code about "
    "это как что для про или chatgpt user using use based make need help problem issue error file files folder "
    "project_01 project_02 project_03 project_04 project_05 project_06 project_07 project_08 project_09 "
    "проект чат тема нужно надо можно сделать ошибка файл файлы".split()
)
ENGLISH_FUNCTION_WORDS = tuple("a an and are as be by can does for from how in is it of or should that the to what when where which why with without".split())
QUESTION_WORDS = ("what", "why", "how", "when", "where", "which")
FENCE_LINE = r"^```[A-Za-z0-9_+.-]*\s*$"
URL = r"https?://[^\s)>\"']+"


def estimate_tokens(text: Column) -> Column:
    """Tokens of a text at four characters each, at least one."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int"))


def word_count(text: Column) -> Column:
    """White-space separated words, at least one."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")))


def clip(text: Column, budget: Column | int) -> Column:
    """text, or its first budget - 1 characters without trailing space and an ellipsis."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    cut = F.regexp_replace(F.substring(text, F.lit(1), F.greatest(b - 1, F.lit(0))), r"\s+$", "")
    return F.when(F.length(text) <= b, text).otherwise(F.concat(cut, F.lit("…")))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column, limit: int = 320) -> Column:
    return clip(collapse(text), limit)


def meaningful_terms(text: Column) -> Column:
    """Distinct lower-case terms of three characters or more that aren't numbers."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_.-]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.rlike(r"^\p{N}+$")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared / all elements of two arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def lexical_similarity(a: Column, b: Column) -> Column:
    return jaccard(meaningful_terms(a), meaningful_terms(b))


def information_score(text: Column) -> Column:
    """How much a text says, from 0 to 1."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    terms = F.size(meaningful_terms(s))
    marks = F.length(F.regexp_replace(s, r"[^:;,.!?\-—()\[\]{}]", "")) / F.greatest(F.length(s), F.lit(1))
    rich = F.least(F.lit(1.0), F.lit(0.35) + F.least(terms, F.lit(14)) / 20 - F.greatest(F.lit(0.0), marks - 0.35))
    bare = F.regexp_replace(F.lower(s), r"[:.!?…]+$", "")
    return F.when(text.isNull(), None).when((s == "") | bare.isin(*INTRODUCTIONS), F.lit(0.0)).when((F.length(s) < 24) | (terms < 3), F.lit(0.15)).otherwise(rich)


def slug(text: Column, fallback: Column | str = "chat") -> Column:
    """Lower-case letters and digits joined by underscores, at most 120 characters."""
    f = F.lit(fallback) if isinstance(fallback, str) else fallback
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9а-яё]+", "_"), r"^_+|_+$", "")
    return F.left(F.coalesce(F.nullif(s, F.lit("")), F.nullif(F.left(f, F.lit(12)), F.lit("")), F.lit("chat")), F.lit(120))


def safe_file_name(text: Column, fallback: Column | str) -> Column:
    f = F.lit(fallback) if isinstance(fallback, str) else fallback
    s = F.regexp_replace(F.regexp_replace(F.trim(text), "[/:]", "_"), r"\x00", "")
    s = F.regexp_replace(F.trim(F.regexp_replace(s, r"\s+", " ")), r"^\.+|\.+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), f)


def title_tokens(title: Column) -> Column:
    """Lower-case words of a title, of three characters or more and no stop word."""
    found = F.transform(F.regexp_extract_all(title, F.lit("[A-Za-z0-9А-Яа-яЁё]{2,}"), F.lit(0)), F.lower)
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def phrases(tokens: Column, most_words: int = 3) -> Column:
    """All runs of 1 to most_words neighbouring tokens, shorter ones first."""

    def of(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.flatten(F.array(*[of(n) for n in range(1, most_words + 1)]))


def display_phrase(phrase: Column) -> Column:
    """Words in title case; ASCII words of up to four letters in upper case."""
    return F.array_join(F.transform(F.split(phrase, " "), lambda t: F.when(t.rlike("^[A-Za-z]{1,4}$"), F.upper(t)).otherwise(F.initcap(t))), " ")


def urls(text: Column) -> Column:
    return F.regexp_count(text, F.lit(URL))


def code_blocks(text: Column) -> Column:
    return F.floor(F.regexp_count(text, F.lit("```")) / 2)


def script_language(text: Column) -> Column:
    """ru, en, or mixed where the lesser script has at least a third of the greater one's letters."""
    cyr = F.length(F.regexp_replace(text, r"[^Ѐ-ӿ]", ""))
    lat = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when((cyr > 0) & (lat > 0) & (F.least(cyr, lat) * 3 >= F.greatest(cyr, lat)), "mixed").when(cyr > lat, "ru").otherwise("en")


def language_mismatch(query: Column, language: Column) -> Column:
    """Why a query can't be of its stated language (ru or en), or null."""
    cyr = F.regexp_count(query, F.lit("[А-яЁё]"))
    latin = F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0)), F.lower)
    russian = F.regexp_count(query, F.lit("[А-Яа-яЁё]{2,}"))
    have = lambda words: F.size(F.array_intersect(latin, F.array(*map(F.lit, words))))
    asks = F.regexp_replace(query, r"\s+$", "").endswith("?") & (have(QUESTION_WORDS) > 0)
    english = (F.size(latin) >= 5) & ((have(ENGLISH_FUNCTION_WORDS) >= 2) | asks)
    return F.when((language == "ru") & (cyr == 0) & english, "english sentence").when((language == "en") & (russian >= 3), "russian sentence")


def selection_reasons(text: Column) -> Column:
    """What makes a text worth sampling."""
    n = lambda p: F.length(F.regexp_replace(text, p, ""))
    flags = [
        (n(r"[^Ѐ-ӿ]") > 200, "russian_or_mixed"), (n("[^A-Za-z]") > 300, "english_or_mixed"),
        (F.length(text) > 4000, "long_message_candidate"), (F.length(text) > 8000, "very_long_message_candidate"),
        (text.contains("```"), "fenced_code"), (text.contains("\n|"), "table"),
        (text.contains("\n- ") | text.contains("\n* "), "list"), (text.rlike(r"[\x{1F301}-\x{10FFFF}]"), "emoji"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in flags]))


def tail_query(text: Column) -> Column:
    """The last eight words of three characters or more among the last 2,000 characters."""
    words = F.transform(F.split(F.right(text, F.lit(2000)), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,:;!?()\[\]{}<>`*_#]+|[.,:;!?()\[\]{}<>`*_#]+$", ""))
    kept = F.filter(words, lambda w: F.length(w) >= 3)
    return F.coalesce(F.nullif(F.array_join(F.when(F.size(kept) > 8, F.slice(kept, -8, 8)).otherwise(kept), " "), F.lit("")), F.lit("preflight tail query"))


def overlap_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)))


def block_kind(raw: Column) -> Column:
    """table, quote, list, heading or prose of a text outside code fences, by its lines."""
    lines = F.filter(F.transform(F.split(raw, "\n"), F.trim), lambda x: x != "")
    every = lambda p: (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(p))
    return F.when(every(r"^\|.*\|$"), "table").when(every("^>"), "quote").when(every(r"^([-*+]|\d+\.)\s+"), "list").when(every(r"^#{1,6}\s"), "heading").otherwise("prose")


def natural_cut(text: Column) -> Column:
    """Length of the longest start of text that ends after a natural boundary in its last 256 characters, or of the whole text."""
    out = F.length(text)
    for sep in (" ", ", ", "; ", "? ", "! ", ". ", "\n", "\n\n"):
        at = F.length(text) - F.locate(sep[::-1], F.reverse(text)) + 1  # end of the last occurrence
        found = F.locate(sep[::-1], F.reverse(text))
        out = F.when((found > 0) & (found - 1 < 256) & (at > len(sep)), at).otherwise(out)
    return out


def iso_time(epoch: Column) -> Column:
    """Seconds since 1970 as ISO text in UTC, with microseconds only where there are some; '' for null."""
    t = F.timestamp_micros(F.round(epoch * 1_000_000).cast("long"))
    whole = epoch == F.floor(epoch)
    return F.coalesce(F.when(whole, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")), F.lit(""))
