"""Chat Markdown: sections, metadata, messages and blocks of whole texts, with exact code-point spans.

Lines are exploded once and cut by running counts: fences, headings and offsets are window sums,
so a text of any length is parsed without a Python loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FENCE_LINE, block_kind

HEADING = r"(?i)^### (\d+)\. (USER|ASSISTANT|SYSTEM|TOOL|UNKNOWN)\s*$"
FIELD = r"^- `?([^`:]+)`?: ?(.*)$"


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, start): the lines of each text with their code-point offset."""
    x = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return x.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def _fenced(x: DataFrame, key: str) -> DataFrame:
    """x with f (a fence line) and c (fences so far, this line included)."""
    f = F.col("line").rlike(FENCE_LINE)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("f", f).withColumn("c", F.sum(F.col("f").cast("int")).over(w))


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, block_type, language, char_start, char_end, block_text): code fences and the texts between them.

    Any fence line opens or closes; a fence that is never closed runs to the end.  Edge newlines
    of the texts between fences aren't part of them, and blank ones are no block.
    """
    x = _fenced(lines(df, key, text), key)
    code = (F.col("c") % 2 == 1) | F.col("f")
    gid = F.when(code, F.ceil(F.col("c") / 2)).otherwise(F.floor(F.col("c") / 2))
    x = x.withColumn("code", code).withColumn("gid", gid.cast("long"))
    first = F.min_by("line", "pos")
    g = x.groupBy(key, "code", "gid").agg(F.min("start").alias("a"), F.max(F.col("start") + F.length("line")).alias("b"), first.alias("head"))
    whole = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"))
    g = g.join(whole, key).withColumn("raw", F.substring("_t", F.col("a") + 1, F.col("b") - F.col("a")))
    lead = F.when(F.col("code"), 0).otherwise(F.length(F.regexp_extract("raw", r"^\n*", 0)))
    tail = F.when(F.col("code"), 0).otherwise(F.length(F.regexp_extract("raw", r"\n*$", 0)))
    g = g.withColumn("s", F.col("a") + lead).withColumn("e", F.col("b") - tail).where((F.col("e") > F.col("s")))
    g = g.withColumn("block_text", F.substring("_t", F.col("s") + 1, F.col("e") - F.col("s"))).where(F.col("code") | F.col("block_text").rlike(r"\S"))
    lang = F.nullif(F.lower(F.regexp_extract("head", r"^```([A-Za-z0-9_+.-]*)", 1)), F.lit(""))
    kind = F.when(F.col("code") & (lang == "mermaid"), "mermaid").when(F.col("code"), "code").otherwise(block_kind(F.col("block_text")))
    n = F.row_number().over(Window.partitionBy(key).orderBy("s")) - 1
    return g.select(key, n.cast("long").alias("ordinal"), kind.alias("block_type"), F.when(F.col("code"), lang).alias("language"), F.col("s").cast("long").alias("char_start"), F.col("e").cast("long").alias("char_end"), "block_text")


def metadata(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value): the fields of the Metadata section; names in lower case with underscores, the last of a name stays."""
    x = lines(df, key, text)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("line").rlike("^## "), F.lower(F.trim(F.substring("line", 4, 100)))), ignorenulls=True).over(w)
    x = x.withColumn("section", section).where((F.col("section") == "metadata") & F.col("line").rlike(FIELD))
    name = F.regexp_replace(F.lower(F.trim(F.regexp_extract("line", FIELD, 1))), "[ -]", "_")
    value = F.regexp_replace(F.trim(F.regexp_extract("line", FIELD, 2)), "^`(.*)`$", "$1")
    return x.select(key, name.alias("name"), value.alias("value"), "pos").groupBy(key, "name").agg(F.max_by("value", "pos").alias("value"))


def messages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, heading_ordinal, role, body): messages by their headings outside code fences.

    Ordinals follow the sequence; the heading's own number is kept.  Leading field lines and blank
    lines of a body are left out.
    """
    x = _fenced(lines(df, key, text), key)
    head = ~F.col("f") & (F.col("c") % 2 == 0) & F.col("line").rlike(HEADING)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("head", head).withColumn("n", F.sum(F.col("head").cast("int")).over(w)).where("n > 0")
    wn = Window.partitionBy(key, "n").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    real = ~F.col("head") & ~F.col("line").rlike(FIELD) & F.col("line").rlike(r"\S")
    x = x.withColumn("in_body", F.max(real.cast("int")).over(wn))
    g = x.groupBy(key, "n").agg(
        F.max(F.when(F.col("head"), F.regexp_extract("line", HEADING, 1).cast("long"))).alias("heading_ordinal"),
        F.max(F.when(F.col("head"), F.lower(F.regexp_extract("line", HEADING, 2)))).alias("role"),
        F.array_sort(F.collect_list(F.when((F.col("in_body") == 1) & ~F.col("head"), F.struct("pos", "line")))).alias("ls"),  # the lines of one message
    )
    body = F.regexp_replace(F.array_join(F.transform("ls", lambda s: s["line"]), "\n"), r"^\n+|\n+$", "")
    return g.select(key, F.col("n").cast("long").alias("ordinal"), "heading_ordinal", "role", body.alias("body"))


def render(messages_: DataFrame, conversation: str, title: Column) -> DataFrame:
    """(conversation, markdown): a conversation's messages (ordinal, role, time_utc, message_id, raw_text) as chat Markdown."""
    nul = lambda c: F.coalesce(F.col(c), F.lit(""))
    part = F.concat(F.lit("### "), F.col("ordinal").cast("string"), F.lit(". "), F.upper("role"), F.lit("\n\n- `time_utc`: `"), nul("time_utc"), F.lit("`\n- `message_id`: `"), nul("message_id"), F.lit("`\n\n"), nul("raw_text"), F.lit("\n"))
    g = messages_.groupBy(conversation).agg(F.first(title).alias("_t"), F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("ordinal", part.alias("p")))).alias("_m"))
    head = F.concat(F.lit("# "), F.coalesce(F.trim("_t"), F.lit("Untitled Chat")), F.lit("\n\n## Metadata\n\n- `id`: `"), F.col(conversation), F.lit("`\n- `message_count`: `"), F.col("_n").cast("string"), F.lit("`\n\n## Conversation\n\n"))
    return g.select(conversation, F.concat(head, F.array_join(F.transform("_m", lambda s: s["p"]), "\n")).alias("markdown"))
