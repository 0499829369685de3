"""Labelled spans for training the character tagger, from a bounded sample of texts.

Forms (addresses of mail, phones, numbers, streets) are labelled by patterns; names are
bootstrapped: words that follow an introducing phrase (a signature, a name field) often enough
become name words, and a span of them is a name wherever it stands.
"""

from __future__ import annotations

import re
from collections import Counter

# The written forms that are labelled.
_DOT = r"(?:\.|\s?[\[(](?:dot|punkt|point|punto|точка|крапка)[\])]\s?)"
EMAIL = re.compile(rf"[\w.+'-]*\w\s?(?:@|\[at\]|\(at\))\s?(?:[\w-]+{_DOT})+[^\W\d_]{{2,}}", re.I)
PHONE = re.compile(
    r"(?<![\w.+-])(?:\+\d[\d ()-]{8,18}\d|00\d\d(?: \d{2,4}){3,4}|\(\d{3}\) \d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|8 \d{3} \d{3} \d\d \d\d|0\d\d \d{4} \d{4})(?![\w-])"
)
ID_NUMBER = re.compile(
    r"(?<![\w-])(?:[A-Z]{2}\d{2}(?: \d{4}){4} \d{2}|[A-Z]{2}\d{20}|9\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}|9\d\d-\d\d-\d{4}|\d{3}-\d{3}-\d{3} \d\d|\d{8}[A-Z]|[A-Z]{2}\d{7}|\d\d \d{3} \d{3} \d{3}|00\d{10})(?![\w-])"
)
_CAP = r"[^\W\d_][\w'’-]*"
ADDRESS = re.compile(
    rf"(?<!\w)(?:\d{{1,4}}[a-z]? (?:{_CAP} ){{1,3}}(?:Lane|Road|Close|Avenue|Street|St\.?)(?!\w)(?:, (?:Flat|Apt\.?) \d+)?"
    rf"|\d{{1,4}}(?: bis| ter)? (?:rue|avenue|impasse|boulevard|place|chemin) (?:des?|du|de la)(?: {_CAP}){{1,2}}"
    rf"|{_CAP} (?:Allee|Weg|Stra(?:ß|ss)e|Str\.) \d+[a-z]?(?:, \d{{5}})?"
    rf"|(?:Avda\.|C/|Calle|Avenida|Plaza|Paseo)(?: (?:de|del|la|las|el|los)){{0,2}}(?: {_CAP}){{1,3}} \d+(?:, (?:piso \d+|\dº \w))?"
    rf"|(?:ул\.|улица|пер\.|переулок|вул\.|вулиця|пров\.|провулок)(?: {_CAP}){{1,2}}, (?:(?:д\.|дом|буд\.) )?\d+(?:, кв\. \d+)?)",
    re.I,
)
INTRODUCED = re.compile(r'(?:Name: |"full_name": "|(?:^|\n)--\n|contact;)([^\n",;]{3,40})')


def name_words(texts: list[str], least: int = 4, most_lower: float = 0.35) -> tuple[set[str], Counter]:
    """Words that stand in introduced names at least so often and are mostly written with a capital elsewhere."""
    seen, lower, upper = Counter(), Counter(), Counter()
    for t in texts:
        for m in INTRODUCED.finditer(t):
            seen.update(w.lower() for w in re.findall(r"[^\W\d_]{2,}", m.group(1)))
        for w in re.findall(r"(?<![\w@.+-])[^\W\d_]{2,}(?![\w@+-])", t):
            (lower if w.islower() else upper)[w.lower()] += 1
    return {w for w, n in seen.items() if n >= least and lower[w] <= most_lower * upper[w]}, seen


def name_pattern(words: set[str]) -> re.Pattern:
    any_ = "|".join(sorted(map(re.escape, words), key=len, reverse=True)) or r"(?!)"
    return re.compile(rf"(?<![\w@.+-])(?:(?:[^\W\d_]\. )?(?:{any_})|(?:{any_}) [^\W\d_]\.)(?:,? (?:{any_})){{0,2}}(?![\w@+-])", re.I)


def spans(text: str, names: re.Pattern) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, type) spans, forms before names."""
    out: list[tuple[int, int, str]] = []
    fences = [m.span() for m in re.finditer(r"```.*?(?:```|$)", text, re.S)]
    for kind, pat in (("email", EMAIL), ("address", ADDRESS), ("id_number", ID_NUMBER), ("phone", PHONE), ("name", names)):
        for m in pat.finditer(text):
            a, b = m.span()
            if kind == "name" and not re.search(r"\w\W+\w", m.group(0)):
                continue
            if kind == "id_number" and re.search(r"(?:trace|sha)\s*$", text[:a], re.I):
                continue
            if any(a < y and x < b for x, y, _ in out) or any(x <= a < y for x, y in fences):
                continue
            out.append((a, b, kind))
    return sorted(out)
