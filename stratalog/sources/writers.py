"""Sinks: Markdown trees and their pages, attachments, JSON, reports, upserts, validated vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.distill import extension_counts
from ..operators.embed import vector_state


def markdown_tree(df: DataFrame, root: str, folder: str, name: str, text: str) -> None:
    """One Markdown file a row in its folder below root, on any file system; names are unique in a folder.

    The tasks stage the files below root/_staged; files that are there are then moved to their folders.
    """
    spark = df.sparkSession
    staged = f"{root}/_staged"
    rows = df.select(F.col(folder).cast("string").alias("folder"), F.col(name).cast("string").alias("name"), F.coalesce(F.col(text), F.lit("")).alias("value"))
    # a partition value for each file: Spark's own committer makes the write safe when a task runs twice
    rows.write.mode("overwrite").partitionBy("folder", "name").option("lineSep", "\n").text(staged)
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(sc._jsc.hadoopConfiguration())
    files = fs.listFiles(hadoop(staged), True)
    unescape = sc._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    while files.hasNext():
        f = files.next().getPath()
        if f.getName().startswith("part-"):
            inner, outer = f.getParent().getName(), f.getParent().getParent().getName()
            to = hadoop(f"{root}/{unescape(outer.split('=', 1)[1])}/{unescape(inner.split('=', 1)[1])}")
            fs.mkdirs(to.getParent())
            fs.delete(to, False)
            fs.rename(f, to)
    fs.delete(hadoop(staged), True)


def json_lines(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def replace_subset(df: DataFrame, path: str, partition: str) -> None:
    """Write rows, replacing only the partitions they belong to: a rerun changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose keys aren't among the new ones, and the new rows; of several of one key the one of the largest hash, in whatever order they come."""
    rest = [c for c in new.columns if c not in keys]
    row = F.struct(*rest) if rest else F.struct(*keys)
    one = new.groupBy(*keys).agg(F.max_by(row, F.struct(F.xxhash64(F.to_json(row)), F.to_json(row))).alias("_r"))
    once = one.select(*[F.col(c) if c in keys else F.col(f"_r.`{c}`").alias(c) for c in new.columns])
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(once)


def checked_vectors(df: DataFrame, vector: str, dim: str) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with their reason)."""
    s = df.withColumn("reason", vector_state(F.col(vector), F.col(dim)))
    return s.where("reason = 'usable'").drop("reason"), s.where("reason <> 'usable'")


def attachment_names(files: DataFrame, folder: str, name: str) -> DataFrame:
    """files once a (folder, name) with target: the name, from its second use by another file on with _2, _3 before the ending.

    files has asset, the file that is copied; a file named twice in a folder is copied once.
    """
    once = files.select(folder, name, "asset").distinct()
    stem, ending = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy("asset"))
    return once.withColumn("target", F.concat(stem, F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), ending))


def chat_json(messages: DataFrame, conversation: str) -> DataFrame:
    """(conversation, json): each parsed chat as one JSON object, its messages in order."""
    m = F.struct("ordinal", "role", "message_id", "time_utc", "raw_text")
    g = messages.groupBy(conversation).agg(F.array_sort(F.collect_list(m)).alias("messages"))  # one chat's messages
    return g.select(conversation, F.to_json(F.struct(F.col(conversation).alias("conversation_id"), F.size("messages").alias("message_count"), "messages")).alias("json"))


def replace_group(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows with all rows of every key that new has replaced by its own: a document's blocks never mix two versions."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.distinct())


def report(rows: DataFrame, title: str, path: str) -> None:
    """A small table of results (a row a variant, type or table) as JSON lines and as a Markdown page below path."""
    cols = rows.columns
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), F.lit(" |"))
    ordered = rows.orderBy(*cols)
    ordered.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    head = rows.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| " + " | ".join(cols) + " |"), (3, "|" + " --- |" * len(cols))], "n long, value string")
    body = ordered.select((F.monotonically_increasing_id() + 4).alias("n"), line.alias("value"))
    head.unionByName(body).orderBy("n").coalesce(1).select("value").write.mode("overwrite").text(f"{path}/markdown")


def index_pages(chats: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(folder, name, text): the SUMMARY and INDEX pages of a tree of chats (group, file_name, title, message_count), and ATTACHMENTS for assets (name).

    A page lists one folder; lists are put together in order of their names.
    """
    entry = F.concat(F.lit("- ["), F.coalesce("title", "file_name"), F.lit("]("), F.col("file_name"), F.lit(") — "), F.coalesce(F.col("message_count").cast("string"), F.lit("0")), F.lit(" messages"))
    index = chats.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_name", entry.alias("e")))), lambda x: x["e"]), "\n").alias("list"))
    index = index.select(F.col("group").alias("folder"), F.lit("INDEX.md").alias("name"), F.concat(F.lit("# "), F.col("group"), F.lit("\n\n"), F.col("list")).alias("text"))
    counts = chats.groupBy("group").agg(F.count("*").alias("n"), F.coalesce(F.sum("message_count"), F.lit(0)).cast("long").alias("m"))
    row = F.concat(F.lit("- "), F.col("group"), F.lit(": "), F.col("n").cast("string"), F.lit(" chats, "), F.col("m").cast("string"), F.lit(" messages"))
    summary = counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", row.alias("e")))), lambda x: x["e"]), "\n").alias("list"))
    out = index.unionByName(summary.select(F.lit(".").alias("folder"), F.lit("SUMMARY.md").alias("name"), F.concat(F.lit("# Summary\n\n"), F.col("list")).alias("text")))
    if assets is None:
        return out
    kinds = extension_counts(assets, "name").select(F.struct((-F.col("files")).alias("o"), "extension", F.concat(F.lit("- `"), F.col("extension"), F.lit("`: `"), F.col("files").cast("string"), F.lit("`")).alias("e")).alias("s"))
    page = kinds.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["e"]), "\n").alias("list"))
    return out.unionByName(page.select(F.lit(".").alias("folder"), F.lit("ATTACHMENTS.md").alias("name"), F.concat(F.lit("# Attachments\n\n## By extension\n\n"), F.col("list")).alias("text")))
