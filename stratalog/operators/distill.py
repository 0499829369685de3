"""Distillation of an export: flattened messages, groups, routing, names and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

OLD_DAYS, FEW_ANSWERS = 60, 9  # defaults of the routing of old common chats


def potential_trash(common: Column, reference_seconds: Column, assistant_messages: Column, now: float, days: int = OLD_DAYS, most: int = FEW_ANSWERS) -> Column:
    """An old common chat with few answers; a chat without a time never is."""
    return F.coalesce(common & (reference_seconds < now - days * 86_400) & (assistant_messages <= most), F.lit(False))


def group_name(pinned: Column, template: Column, labels: Column) -> Column:
    """Pinned, the template's project label, or Common."""
    return F.when(pinned, "Pinned").when(F.coalesce(template, F.lit("")) != "", labels).otherwise("Common")


def project_labels(conversations: DataFrame, template: str, prefix: str = "Project") -> DataFrame:
    """(template, label): Project_01 and so on, by sorted template id."""
    t = conversations.select(F.col(template).alias("template")).where("coalesce(template, '') <> ''").distinct()
    n = F.row_number().over(Window.orderBy("template"))  # over the distinct templates only
    return t.select("template", F.concat(F.lit(f"{prefix}_"), F.lpad(n.cast("string"), 2, "0")).alias("label"))


def route(folder_kind: Column, trash: Column | None = None) -> Column:
    """Top folder of a chat: Pinned, Common (useful or potential_trash) or Projects."""
    common = F.lit("Common") if trash is None else F.when(trash, "Common/potential_trash").otherwise("Common/useful")
    return F.when(folder_kind == "pinned", "Pinned").when(folder_kind == "common", common).otherwise("Projects")


def folder_kind(path: Column) -> Column:
    """common_useful, common_trash, pinned, project or other, by the parts of a relative path."""
    p = F.split(path, "/")
    first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return F.when((first == "Common") & (second == "useful"), "common_useful").when((first == "Common") & (second == "potential_trash"), "common_trash").when(first == "Pinned", "pinned").when((first == "Projects") & (F.size(p) > 2), "project").otherwise("other")


def file_kind(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.upper(name).isin("INDEX.MD", "SUMMARY.MD"), "index").when(F.array_contains(F.split(path, "/"), "attachments"), "attachment").when(F.lower(name).endswith(".md"), "chat_md").otherwise("attachment")


def interest_tier(kind: Column) -> Column:
    return F.when(kind == "common_trash", "low").otherwise("normal")


def interesting(rows: DataFrame, tier: str, low: bool = False) -> DataFrame:
    """rows without content of low interest or in quarantine, unless low asks for it; a row without a tier stays."""
    return rows if low else rows.where(~F.coalesce(F.col(tier), F.lit("normal")).isin("low", "quarantine"))


def extension_counts(files: DataFrame, name: str) -> DataFrame:
    """(extension, files): how many file names have each extension, most first; a name without one counts as [no-ext]."""
    ext = F.when(F.col(name).rlike(r"[^.]\.[^.]+$"), F.lower(F.regexp_extract(name, r"\.[^.]+$", 0))).otherwise("[no-ext]")
    return files.where(F.col(name).isNotNull()).groupBy(ext.alias("extension")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "extension")


def unique_names(df: DataFrame, group: str, base: str, order: str, ending: str = ".md") -> DataFrame:
    """df with file_name: the base name, from its second use in a group on with _2, _3 and so on."""
    n = F.row_number().over(Window.partitionBy(group, base).orderBy(order))
    return df.withColumn("file_name", F.concat(F.col(base), F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(ending)))


def sample_list(df: DataFrame, by: str, name: str, k: int = 5) -> DataFrame:
    """(by, samples): a group's first k names, and how many more there are; names are cut before they are collected."""
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last(name))))
    top = r.where((F.col("_r") <= k) & F.col(name).isNotNull()).groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("_s"))
    n = df.groupBy(by).agg(F.count(name).alias("_n"))
    return n.join(top, by, "left").select(by, F.concat(F.coalesce("_s", F.lit("")), F.when(F.col("_n") > k, F.concat(F.lit(" +"), (F.col("_n") - k).cast("string"), F.lit(" more"))).otherwise("")).alias("samples"))


def project_names(titles: DataFrame, group: str, title: str, most_words: int = 3, least: int = 2) -> DataFrame:
    """(group, name, confidence): high where titles repeat a phrase of two words or more, medium where they repeat a word.

    The best phrase is the one in most titles, then of most words, then last in order; of words the
    two in most titles count, ties in alphabetical order.
    """
    t = titles.where(F.col(title).isNotNull()).select(F.col(group), F.monotonically_increasing_id().alias("_t"), T.title_tokens(F.col(title)).alias("w"))
    grams = t.select(group, "_t", F.explode(F.array_distinct(T.phrases(F.col("w"), most_words))).alias("p")).groupBy(group, "p").agg(F.count("*").alias("n"))
    grams = grams.withColumn("k", F.size(F.split("p", " "))).where(F.col("n") >= least)
    best = grams.where("k >= 2").groupBy(group).agg(F.max(F.struct("n", "k", "p")).alias("m")).select(group, T.display_phrase(F.col("m.p")).alias("high"))
    words = grams.where("k = 1").withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "p"))).where("r <= 2")
    words = words.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p"))), lambda s: s["p"]), " ").alias("w")).select(group, T.display_phrase(F.col("w")).alias("medium"))
    all_ = titles.select(group).distinct().join(best, group, "left").join(words, group, "left")
    return all_.select(group, F.coalesce("high", "medium").alias("name"), F.when(F.col("high").isNotNull(), "high").when(F.col("medium").isNotNull(), "medium").otherwise("none").alias("confidence"))
