"""Reading exports: conversation JSON (folders, files, zip archives), library files, file trees, attachments and JSON lines."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import distill
from ..session import ship

MESSAGE = "struct<id: string, author: struct<role: string>, create_time: string, content: struct<parts: array<string>>, metadata: struct<attachments: array<struct<id: string>>>>"
CONVERSATION = f"id string, conversation_id string, conversation_template_id string, title string, create_time double, update_time double, pinned_time double, mapping map<string, struct<message: {MESSAGE}>>"


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """Raw conversations of a folder (conversations-*.json), a JSON file, or zip archives of such files; what isn't an object is skipped."""
    if path.endswith(".zip"):
        ship(spark)

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for data in b["content"]:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for n in sorted(z.namelist()):
                            if re.fullmatch(r"(?:.*/)?conversations[^/]*\.json", n):
                                rows = json.loads(z.read(n))
                                yield pd.DataFrame({"value": [json.dumps(r, ensure_ascii=False) for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []})

        raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "value string")
        return raw.select(F.from_json("value", CONVERSATION).alias("c")).select("c.*")
    schema = T.StructType(T._parse_datatype_string(CONVERSATION).fields)
    files = path if path.endswith(".json") else f"{path}/conversations*.json"
    return spark.read.schema(schema).option("multiLine", True).json(files).where(F.coalesce("id", "conversation_id").isNotNull() | F.col("mapping").isNotNull())


def discover_inputs(spark: SparkSession, folder: str, explicit: str | None = None) -> list[str]:
    """Paths of the inputs of a folder (conversations-*.json and zip archives), sorted, each once; an explicit path wins.

    It is an error if there is none, or if an explicit path is neither a folder, a JSON file nor a zip archive.
    """
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path
    at = hadoop(explicit or folder)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(explicit or folder)
    if not fs.getFileStatus(at).isDirectory():
        if not re.search(r"\.(?:json|zip)$", at.getName(), re.I):
            raise ValueError(f"neither JSON nor zip: {at.getName()}")
        return [at.toString()]
    found = sorted({f.getPath().toString() for f in fs.listStatus(at) if re.fullmatch(r"conversations-.*\.json|.*\.zip", f.getPath().getName())})
    if not found:
        raise FileNotFoundError(f"no conversations-*.json and no zip archive in {folder}")
    return found


def asset_names(spark: SparkSession, path: str) -> DataFrame:
    """(asset, name) of the export's map of asset names: pairs of text alone, each asset once; what isn't text is left out."""
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.explode(F.from_json("value", "map<string,variant>")).alias("asset", "v"))
    return pairs.where(F.schema_of_variant("v") == "STRING").select("asset", F.variant_get("v", "$", "string").alias("name")).distinct()


def probe_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Probes of a manifest in either schema (a list of probes, or an object that holds it), missing fields filled with their defaults."""
    probe = "struct<probe_id:string,id:string,query:string,query_language:string,language:string,expected_message_id:string,expected_conversation_id:string,category:string>"
    raw = spark.read.text(path, wholetext=True)
    both = F.coalesce(F.from_json("value", f"struct<probes:array<{probe}>>")["probes"], F.from_json("value", f"array<{probe}>"))
    p = raw.select(F.explode(both).alias("p")).select("p.*")
    return p.select(F.coalesce("probe_id", "id").alias("probe_id"), "query", F.coalesce("query_language", "language", F.lit("unknown")).alias("query_language"), "expected_message_id", "expected_conversation_id", F.coalesce("category", F.lit("unspecified")).alias("category"))


def library_threads(library: DataFrame, conversations: DataFrame) -> DataFrame:
    """Library files with the title of the conversation that each comes from; a file of an unknown one keeps its row."""
    c = conversations.select(F.coalesce("id", "conversation_id").alias("origination_thread_id"), F.col("title").alias("thread_title")).where("origination_thread_id is not null").dropDuplicates(["origination_thread_id"])
    return library.join(c, "origination_thread_id", "left")


def flatten(raw: DataFrame) -> DataFrame:
    """(conversation_id, ordinal, role, message_id, epoch, raw_text): messages in order of time and id; parts joined, blank ones dropped."""
    cid = F.coalesce("id", "conversation_id").alias("conversation_id")
    m = raw.select(cid, F.explode(F.map_values("mapping")).alias("n")).select("conversation_id", "n.message").where("message is not null")
    parts = F.filter(F.transform(F.coalesce(F.col("message.content.parts"), F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p != "")
    rows = m.select("conversation_id", F.lower(F.coalesce("message.author.role", F.lit("other"))).alias("role"), F.col("message.id").alias("message_id"), F.col("message.create_time").try_cast("double").alias("epoch"), F.array_join(parts, "\n\n").alias("raw_text"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.coalesce("epoch", F.lit(0.0)), "message_id"))
    return rows.where("raw_text <> ''").withColumn("ordinal", n.cast("long"))


def attachment_ids(raw: DataFrame) -> DataFrame:
    """(conversation_id, attachment_id): distinct attachments of each conversation."""
    cid = F.coalesce("id", "conversation_id").alias("conversation_id")
    a = raw.select(cid, F.explode(F.map_values("mapping")).alias("n")).select("conversation_id", F.explode("n.message.metadata.attachments.id").alias("attachment_id"))
    return a.where("attachment_id is not null").distinct()


def library_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of library_files.json with a name: the file's, the normalized one, its id, or unknown."""
    schema = "file_id string, file_name string, normalized_name string, mime_type string, library_file_category string, directory_id string, origination_thread_id string, is_project boolean, created_at string"
    f = spark.read.schema(schema).option("multiLine", True).json(path)
    name = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("file_name", "normalized_name", "file_id")], F.lit("unknown"))
    return f.withColumn("name", name)


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, size, sha256, folder_kind, file_kind, interest_tier) of every file under a folder."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", f"^(?:file:)?/*{re.escape(root.strip('/'))}/", "")
    t = b.select(rel.alias("relative_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    t = t.withColumn("folder_kind", distill.folder_kind(F.col("relative_path"))).withColumn("file_kind", distill.file_kind(F.col("relative_path")))
    return t.withColumn("interest_tier", distill.interest_tier(F.col("folder_kind")))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def parse_attachment(name: str, data: bytes) -> tuple[str, list[tuple[int, str]], str | None]:
    """(status, [(ordinal, text)], error): text files are one block, paragraphs and slides one each; blank ones leave gaps for slides."""
    ending = name.rsplit(".", 1)[-1].lower()
    try:
        if ending in ("txt", "md", "json", "yaml", "yml", "csv", "log"):
            text = data.decode("utf-8", "replace")
            return "extracted", [(1, text)] if text.strip() else [], None
        if ending == "docx":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
            found = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
            return "extracted", list(enumerate((x for x in found if x), 1)), None
        if ending == "pptx":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = sorted(n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
                texts = ["\n".join(x for t in ElementTree.fromstring(z.read(n)).iter(f"{_A}t") if (x := (t.text or "").strip())) for n in names]
            return "extracted", [(k, x) for k, x in enumerate(texts, 1) if x], None
        if ending == "pdf":
            import pdfplumber

            with pdfplumber.open(io.BytesIO(data)) as pdf:
                return "extracted", [(k, x) for k, p in enumerate(pdf.pages, 1) if (x := (p.extract_text() or "").strip())], None
    except Exception as e:
        return "failed", [], f"{type(e).__name__}: {e}"[:300]
    return "unsupported", [], None


def attachments(spark: SparkSession, root: str) -> DataFrame:
    """(path, status, error, ordinal, text): the blocks of every attachment; a file without a block has one row without ordinal."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                status, found, error = parse_attachment(path, data)
                rows += [(path, status, error, o, t) for o, t in found or [(None, None)]]
            yield pd.DataFrame(rows, columns=["path", "status", "error", "ordinal", "text"]).astype({"ordinal": "Int64"})

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content").mapInPandas(run, "path string, status string, error string, ordinal long, text string")


def json_lines(spark: SparkSession, path: str, schema: str, version: str | None = None) -> DataFrame:
    """Records of a JSON-lines file; with a version given, rows of another schema_version are an error."""
    df = spark.read.schema(schema).json(path)
    if version is None:
        return df
    ok = F.col("schema_version").eqNullSafe(version)
    return df.withColumn("schema_version", F.when(ok, F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("unknown schema_version "), F.coalesce("schema_version", F.lit("null"))))))
