"""Template residue and error-page text, by TF-IDF containment against labelled exemplars.

A text's running part (without code fences and quoted code) is cut into passage windows: sentences,
placeholders, and the words that lead to a value that was never filled in.  An inverted index of the
exemplars' words retrieves, for each window, the exemplars that share a word with it; a window is
residue if it covers enough of the exemplar's weight and the exemplar covers enough of the window's.
Word weights come from document frequencies over the whole table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

VOID = "voidmark"  # stands for a value never filled in
LEAD = 9  # most words before such a value that are read with it

# The written forms of unfilled fields and of missing values.
FIELD_FORM = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%[^%\n]{1,60}%>|[$#]\{[\w .-]{1,60}\}|%%\w{2,40}%%|@@\w{2,40}@@"
    r"|(?<!\w)__[A-Za-z]\w{0,40}[A-Za-z]__(?!\w)|\[\[[\w .-]{1,60}\]\]|(?<![\w\\}\]$#{])\{[A-Za-z_][\w .-]{0,40}\}(?!\{)"
    r"|\[(?:your|insert|add|enter|type|recipient|company|first|last|вставьте|вставте|введите|ваше|укажите|inserte?|insertar|insérez|insérer|votre|einfügen|ihr|hier)\b[^\]\n]{0,60}\](?!\()"
    r"|\[[^\]\n]{0,40}\b(?:eintragen|einfügen|ergänzen|goes here|here|aquí|ici)\](?!\()"
    r"|<[^<>\n/=\"]{0,40}(?:goes here|here|имя|ім'я|название|дата|recipient|your|nombre|nom|name|datum|fecha|ici|aquí|тут|здесь|eintragen)[^<>\n/=\"]{0,40}>",
    re.I,
)
VOID_FORM = re.compile(r"(?<![\w.=\"'])(?:null|undefined|NaN|\[object Object\]|#REF!|#N/A)(?![\w(=\"'])")
# Words that stand for the opening marks of placeholders.
SHAPES = {
    "{{": "markcurlytwo", "{%": "markcurlypercent", "<%": "markanglepercent", "${": "markdollar", "#{": "markhash", "%%": "markpercent",
    "@@": "markat", "__": "markunderline", "[[": "marksquaretwo", "{": "markcurly", "[": "marksquare", "<": "markangle",
}
WORD = re.compile(r"[^\W_]+")
FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`", re.S)
TAG = re.compile(r"</?(?:noscript|html|head|body|title|center|h\d|hr|p|br|div|span)\b[^>]*>", re.I)
BREAK = re.compile(r"(?<=[.!?…])\s+|[\r\n\u2028\u2029\x0b\x0c\x85]+")

# Labelled exemplars of residue by kind.
STATUS = {
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 408: "Request Timeout",
    410: "Gone", 413: "Payload Too Large", 429: "Too Many Requests", 500: "Internal Server Error", 501: "Not Implemented",
    502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}
ERRORS = [
    "404 the page you asked for was not found", "page not found", "the requested url was not found on this server",
    "internal server error", "service temporarily unavailable 503", "service unavailable", "too many requests", "access denied", "permission denied",
    "oops something went wrong while loading this conversation", "something went wrong please try again later", "an unexpected error occurred",
    "this site can't be reached", "the connection has timed out",
    "this shared link has expired or was removed", "this link has expired", "your session has expired please sign in again", "the server is temporarily unable to service your request", "the service is temporarily unavailable", "bad gateway", "gateway timeout",
    "traceback most recent call last", "unhandled exception", "segmentation fault core dumped", "fatal error uncaught",
    "ошибка 404 страница не найдена", "страница не найдена", "внутренняя ошибка сервера повторите позже", "доступ запрещён", "сервис временно недоступен", "служба временно недоступна", "срок действия ссылки истёк или она удалена", "что-то пошло не так",
    "помилка 404 сторінку не знайдено", "сторінку не знайдено", "внутрішня помилка сервера спробуйте пізніше", "доступ заборонено", "сервіс тимчасово недоступний", "служба тимчасово недоступна", "термін дії посилання минув або його видалено", "щось пішло не так",
    "fehler 404 seite nicht gefunden", "seite nicht gefunden", "interner serverfehler bitte später erneut versuchen", "zugriff verweigert", "der dienst ist vorübergehend nicht erreichbar", "der dienst ist vorübergehend nicht verfügbar", "dieser link ist abgelaufen oder wurde entfernt", "etwas ist schiefgelaufen",
    "erreur 404 page introuvable", "page introuvable", "erreur interne du serveur réessayez plus tard", "accès refusé", "le service est temporairement indisponible", "ce lien a expiré ou a été supprimé", "une erreur est survenue",
    "error 404 página no encontrada", "página no encontrada", "error interno del servidor inténtelo más tarde", "acceso denegado", "el servicio no está disponible temporalmente", "el servicio no está disponible en este momento", "este enlace ha caducado o fue eliminado", "algo salió mal",
]
SCRIPTS = [
    "please enable javascript to continue using this site", "you need to allow cookies and scripts to view this page", "your browser is not supported or blocks scripts",
    "this app needs scripts turn on javascript and reload", "this app needs scripts", "turn on javascript and reload", "checking your browser before opening the page",
    "javascript is required", "javascript is disabled in your browser", "please enable cookies", "cookies must be enabled to continue", "please update your browser",
    "you need to enable javascript to run this app", "this site requires javascript",
    "для просмотра страницы включите javascript", "ваш браузер не поддерживает скрипты", "включите cookies и скрипты чтобы продолжить",
    "щоб переглянути сторінку увімкніть javascript", "ваш браузер не підтримує скрипти",
    "bitte aktivieren sie javascript um fortzufahren", "ihr browser unterstützt keine skripte",
    "veuillez activer javascript pour afficher cette page", "votre navigateur ne prend pas en charge les scripts",
    "active javascript para ver esta página", "su navegador no admite scripts",
]
FILLER = [
    "placeholder text to be replaced later", "sample text goes here", "type your notes in this field", "your text here", "enter a description", "insert text here", "description goes here", "add your content here",
    "текст заглушка заменить позже", "здесь будет текст", "введите описание", "текст заглушка замінити пізніше", "текст заповнювач замінити пізніше", "тут буде текст", "введіть опис",
    "blindtext bitte ersetzen", "hier steht später der text", "beschreibung eingeben", "texte de remplissage à remplacer plus tard", "le texte viendra ici", "saisissez une description",
    "texto de relleno sustituir más tarde", "aquí va el texto", "escriba una descripción",
]
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor tempora incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vitae felis porta cursus lacus pulvinar tellus ornare mollis"
STROKES = "x xx xxx xxxx asdf asdfgh qwerty qwertz text test blah foo bar lorem ipsum текст тест"  # typed again and again in place of content
GREETINGS = ["dear {}", "hello {}", "hi {}", "здравствуйте {}", "уважаемый {}", "вітаємо {}", "шановний {}", "hallo {}", "liebe {}", "bonjour {}", "cher {}", "hola {}", "estimado {}"]
SENTENCES = [
    "this summary was prepared for {}", "the next review is due on {} and goes to {}", "the next review is due on {}", "сводка подготовлена для {}", "звіт складено для {}",
    "diese übersicht ist für {} bestimmt", "ce résumé est destiné à {}", "este resumen es para {}", "your order {} ships on {}", "welcome {}", "name {}", "date {}", "total {}",
]


def exemplars() -> list[tuple[str, str, float, float, int]]:
    """(kind, text, least share of the exemplar's weight, least share of the window's weight, fewest words of the window in it)."""
    out = [("field", x, 1.0, 0.1, 1) for x in SHAPES.values()]
    out += [("field", x.format(*[VOID] * 2), 0.7, 0.7, 2) for x in GREETINGS + SENTENCES]
    out += [("error", f"{c} {p}", 1.0, 0.99, 2) for c, p in STATUS.items()]
    out += [("error", f"{lead} {c}", 1.0, 0.99, 2) for c in STATUS for lead in ("status", "http", "error", "error code", "ошибка", "помилка", "fehler", "erreur")]
    out += [("error", p, 1.0, 0.99, 2) for p in STATUS.values() if " " in p]
    out += [("error", f"{lead} {c} {p}", 0.55, 0.8, 2) for c, p in STATUS.items() for lead in ("error", "http", "status")]
    out += [("error", f"code {c} message {p} trace", 0.7, 0.5, 4) for c, p in STATUS.items()]
    out += [("error", f"detail {p}", 1.0, 0.99, 2) for p in STATUS.values()]
    out += [("error", x, 0.8, 0.8, 2) for x in ERRORS]
    out += [("error", f"error {p} status {c}", 0.7, 0.8, 2) for c, p in STATUS.items()]
    out += [("scripts", x, 0.8, 0.8, 2) for x in SCRIPTS]
    out += [("filler", x, 0.8, 0.8, 2) for x in FILLER]
    out += [("filler", STROKES, 0.0, 0.9, 5), ("lorem", LOREM, 0.0, 0.85, 2)]
    return [(kind, text.lower(), a, b, n) for kind, text, a, b, n in out]


def tokens(window: str) -> list[str]:
    """Lower-cased words; the opening mark of a placeholder and a value never filled in are words too."""

    def field(m: re.Match) -> str:
        return f" {SHAPES.get(m[0][:2]) or SHAPES[m[0][0]]} {m[0]} "

    w = VOID_FORM.sub(f" {VOID} ", FIELD_FORM.sub(field, window))
    return [t.lower() for t in WORD.findall(w)]


def windows(text: str) -> list[list[str]]:
    """Passage windows of the running text: sentences, broken at line ends; each placeholder with what it names; and each
    value that was never filled in with the words before it."""
    text = TAG.sub("\n", FENCE.sub("\n", text))
    out = []
    for w in BREAK.split(text):
        if not w or not (t := tokens(w)):
            continue
        out.append(t)
        out += [tokens(m[0]) for m in FIELD_FORM.finditer(w)]
        for k, word in enumerate(t):
            if word == VOID:
                out += [t[k - n : k + 1] for n in range(1, min(LEAD, k) + 1)]
    return out


class Index:
    """Inverted index over the exemplars' words."""

    def __init__(self, idf: dict[str, float], plain: float):
        self.idf, self.plain = idf, plain
        self.rows, self.posts = [], {}
        for k, (kind, text, a, b, n) in enumerate(exemplars()):
            words = set(WORD.findall(text))
            self.rows.append((kind, words, sum(self.weight(w) for w in words), a, b, n))
            for w in words:
                self.posts.setdefault(w, []).append(k)

    def weight(self, w: str) -> float:
        return self.idf.get(w, self.plain)

    def match(self, toks: list[str]) -> tuple[str, float] | None:
        """(kind, containment) of the best exemplar that the window matches; containment is the smaller of the shares it must reach."""
        words = set(toks)
        hit = words & self.posts.keys()
        if not hit:
            return None
        tf = {w: toks.count(w) for w in words}
        whole = sum(self.weight(w) * n for w, n in tf.items())
        best = None
        for k in {k for w in hit for k in self.posts[w]}:
            kind, ex, total, least_ex, least_win, fewest = self.rows[k]
            both = words & ex
            b = sum(self.weight(w) * tf[w] for w in both) / whole
            if b < least_win or sum(tf[w] for w in both) < fewest or kind == "error" and both <= {"error", "http", "status", "code", "message"}:
                continue
            a = sum(self.weight(w) for w in both) / total
            if a >= least_ex and (best is None or (b if not least_ex else min(a, b)) > best[1]):
                best = (kind, b if not least_ex else min(a, b))
        return best


def vocabulary() -> list[str]:
    return sorted({w for _, text, *_ in exemplars() for w in WORD.findall(text)})


def document_frequencies(df: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """Number of texts, and of those whose windows hold each word of the exemplars, over the whole table."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frozenset(vocabulary())
        n: Counter = Counter()
        for b in batches:
            for t in b[text]:
                n[""] += 1
                n.update({w for ws in windows(t) for w in ws} & known)
        yield pd.DataFrame({"w": list(n.keys()), "n": list(n.values())})

    rows = df.select(text).mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # at most one row for each word of the exemplars
    by = {r["w"]: r["n"] for r in rows}
    return by.pop("", 0), by


def score(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, containment, windows, residue): a row for each row whose running text holds residue.

    kind and containment are those of the best match (field, error, scripts, filler, lorem);
    windows counts the passage windows and residue those that match.  Null, empty and blank texts
    never match.  Repeated rows each give their row; an empty table gives an empty result; other
    columns are ignored.  Whole texts are read, of any length.
    """
    spark = df.sparkSession
    ship(spark)
    src = df.select(F.col(key), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    n, freq = document_frequencies(src, "_text")
    idf = {w: math.log((n + 1) / (freq.get(w, 0) + 1)) + 1 for w in vocabulary()}
    plain = math.log(n + 1) / 2 + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(idf, plain)
        for b in batches:
            rows = []
            for k, t in zip(b[key], b["_text"]):
                ws = windows(t)
                found = [m for w in ws if (m := index.match(w))]
                if found:
                    kind, c = max(found, key=lambda m: m[1])
                    rows.append((k, kind, float(c), len(ws), len(found)))
            yield pd.DataFrame(rows, columns=[key, "kind", "containment", "windows", "residue"])

    kind = src.schema[key].dataType.simpleString()
    return src.mapInPandas(run, f"`{key}` {kind}, kind string, containment double, windows int, residue int")


def without_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """df without the rows that score() finds; the key is unique and rows with a null key are kept."""
    return df.join(score(df, key, text).select(key), key, "left_anti")
