"""Queries of identities, resumption, inspection and export summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distill, embed, graph, lineage
from ..sources import writers
from ..sources.tables import table
from .archive import _CH, _MEMBERS, _members, chunks, trash_routing
from .registry import SQL, query
from .retrieval import _TERMS, _VECS, chunk_term_lists, usable_vectors
from .texts import messages

_MS = "(SELECT DISTINCT id, conversation_id, ordinal, role, message_id, time_utc, raw_text FROM messages)"
_BL = "(SELECT DISTINCT id, message_id, ordinal, block_type, language, source_char_start, source_char_end FROM blocks)"


def _hash(domain: str, *parts: str) -> str:
    return f"sha256('{domain}' || chr(0) || to_json([{', '.join(f'''coalesce(CAST({p} AS VARCHAR), '')''' for p in parts)}]))"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").select("id", "message_id", "ordinal", "block_type", "language", "source_char_start", "source_char_end").distinct()


@query(f"SELECT id, {_hash('conversation', 'id', 'title', 'create_time_utc', 'update_time_utc', 'metadata_json')} AS revision FROM conversations")
def conversation_revisions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("id", lineage.conversation_revision(F.col("id"), *[F.col(x) for x in ("title", "create_time_utc", "update_time_utc", "metadata_json")]).alias("revision"))


_BI = "'block_' || " + _hash("block", "m.message_id", "'1'", "b.ordinal", "b.block_type", "b.language", "b.source_char_start", "b.source_char_end")


@query(f"SELECT b.id, {_BI} AS identity FROM {_BL} b JOIN (SELECT DISTINCT id AS message_id FROM messages WHERE id IS NOT NULL) m ON m.message_id = b.message_id")
def block_identities(spark: SparkSession, d: str) -> DataFrame:
    """Identities of blocks; the message's id stands for its revision."""
    b = _blocks(spark, d).join(messages(spark, d).select(F.col("id").alias("message_id")).where("message_id is not null").distinct(), "message_id")
    return b.select("id", lineage.block_identity(*[F.col(c) for c in ("message_id", "ordinal", "block_type", "language", "source_char_start", "source_char_end")]).alias("identity"))


@query(f"""WITH c AS (SELECT DISTINCT id, block_id, ordinal, source_char_start, source_char_end, text, chunk_policy_id FROM retrieval_chunks), e AS (SELECT *, {_hash('chunk-derivation', 'block_id', 'block_id', "'1'", "'1'", "'2'", 'chunk_policy_id')} AS derivation FROM c)
SELECT id, derivation, 'chunk_' || {_hash('chunk', 'derivation', 'ordinal', 'source_char_start', 'source_char_end')} AS identity, {_hash('chunk-content', 'text')} AS content FROM e""")
def chunk_identities(spark: SparkSession, d: str) -> DataFrame:
    """Derivation, identity and content hash of chunks; the block's id stands for its message's revision."""
    c = table(spark, d, "retrieval_chunks").select("id", "block_id", "ordinal", "source_char_start", "source_char_end", "text", "chunk_policy_id").distinct()
    c = c.withColumn("derivation", lineage.chunk_derivation(F.col("block_id"), F.col("block_id"), F.col("chunk_policy_id")))
    return c.select("id", "derivation", lineage.chunk_identity(*[F.col(x) for x in ("derivation", "ordinal", "source_char_start", "source_char_end")]).alias("identity"), lineage.ids.content_hash("chunk-content", F.col("text")).alias("content"))


@query(f"""WITH {_VECS}, {_TERMS}, a AS (SELECT DISTINCT id AS chunk_id FROM retrieval_chunks WHERE id IS NOT NULL),
s AS (SELECT chunk_id, CASE WHEN v AND w THEN 'complete' WHEN v OR w THEN 'repair' ELSE 'pending' END AS state FROM (SELECT chunk_id, chunk_id IN (SELECT chunk_id FROM v WHERE chunk_id IS NOT NULL) AS v, chunk_id IN (SELECT chunk_id FROM w) AS w FROM a)),
o AS (SELECT chunk_id, (row_number() OVER (ORDER BY chunk_id) - 1) // 64 AS batch FROM s WHERE state <> 'complete')
SELECT s.chunk_id, s.state, coalesce(o.batch, -1) AS batch FROM s LEFT JOIN o USING (chunk_id)""")
def embedding_resume(spark: SparkSession, d: str) -> DataFrame:
    """What an embedding job that was stopped has still to do, in batches."""
    c = chunks(spark, d).where("id is not null").select(F.col("id").alias("chunk_id"))
    r = lineage.resume(c, usable_vectors(spark, d), chunk_term_lists(spark, d).where(F.size("terms") > 0), "chunk_id")
    return r.select("chunk_id", "state", F.coalesce("batch", F.lit(-1)).cast("long").alias("batch"))


@query(f"""WITH {_VECS}, v2 AS (SELECT count(*) AS n FROM v), g AS (SELECT count(*) AS n FROM conversations WHERE project_id IS NOT NULL) SELECT (SELECT n FROM v2) > 0 AS has_vectors, (SELECT count(*) FROM retrieval_chunks) > 0 AS has_chunks, (SELECT n FROM g) > 0 AS has_groups, (SELECT count(*) FROM real_probes) > 0 AS has_probes""")
def capability_flags(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.context import capabilities

    flags = capabilities(vectors=usable_vectors(spark, d), chunks=table(spark, d, "retrieval_chunks"), groups=table(spark, d, "conversations").where("project_id is not null"), probes=table(spark, d, "real_probes"))
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in flags.items()])


@query("""SELECT CASE WHEN regexp_matches(file_name, '[^.]\\.[^.]+$') THEN lower(regexp_extract(file_name, '\\.[^.]+$')) ELSE '[no-ext]' END AS extension, count(*) AS files FROM documents WHERE file_name IS NOT NULL GROUP BY 1""")
def extension_counts(spark: SparkSession, d: str) -> DataFrame:
    return distill.extension_counts(table(spark, d, "documents"), "file_name")


@query("SELECT bucket, trash, count(*) AS conversations FROM (" + SQL["trash_routing"] + ") GROUP BY 1, 2")
def export_summary(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of each top folder, old ones with few answers apart."""
    return trash_routing(spark, d).groupBy("bucket", "trash").agg(F.count("*").alias("conversations"))


@query(f"""SELECT b.id, md5(concat_ws(chr(10), CASE WHEN coalesce(c.project_id, '') <> '' THEN 'Project: ' || c.project_id END, CASE WHEN coalesce(c.title, '') <> '' THEN 'Conversation: ' || c.title END, 'Role: ' || upper(m.role), 'Block type: ' || b.block_type,
 'Content: ' || substr(m.raw_text, b.source_char_start + 1, b.source_char_end - b.source_char_start))) AS text_hash FROM {_BL} b JOIN {_MS} m ON m.id = b.message_id LEFT JOIN (SELECT DISTINCT id, project_id, title FROM conversations) c ON c.id = m.conversation_id""")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """A hash of the text of each block that is embedded."""
    m = messages(spark, d).select(F.col("id").alias("message_id"), "conversation_id", "role", "raw_text")
    c = table(spark, d, "conversations").select(F.col("id").alias("conversation_id"), "project_id", "title").distinct()
    x = _blocks(spark, d).join(m, "message_id").join(c, "conversation_id", "left")
    content = F.substring("raw_text", F.col("source_char_start") + 1, F.col("source_char_end") - F.col("source_char_start"))
    return x.select("id", F.md5(embed.embedding_text(F.col("project_id"), F.col("title"), F.col("role"), F.col("block_type"), content)).alias("text_hash"))


@query(f"""WITH {_VECS}, p AS (SELECT c.id AS chunk_id, b.id AS block_id, m.id AS message_id, m.conversation_id, CASE WHEN v.folder_kind = 'common_trash' THEN 'low' ELSE 'normal' END AS tier FROM (SELECT DISTINCT id, block_id FROM retrieval_chunks) c JOIN {_BL} b ON b.id = c.block_id JOIN {_MS} m ON m.id = b.message_id LEFT JOIN (SELECT DISTINCT id, folder_kind FROM conversations) v ON v.id = m.conversation_id)
SELECT chunk_id, message_id, conversation_id, coalesce(space, 'none') AS space FROM p LEFT JOIN v USING (chunk_id) WHERE tier NOT IN ('low', 'quarantine')""")
def searchable_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that search may find, with provenance and the space of each of their vectors; content of low interest is left out, as is the default."""
    c = chunks(spark, d).select(F.col("id").alias("chunk_id"), "block_id").distinct()
    b = _blocks(spark, d).select(F.col("id").alias("block_id"), "message_id")
    m = messages(spark, d).select(F.col("id").alias("message_id"), "conversation_id")
    v = table(spark, d, "conversations").select(F.col("id").alias("conversation_id"), "folder_kind").distinct()
    p = c.join(b, "block_id").join(m, "message_id").join(v, "conversation_id", "left").withColumn("tier", distill.interest_tier(F.col("folder_kind")))
    out = distill.interesting(p, "tier").join(usable_vectors(spark, d).select("chunk_id", "space"), "chunk_id", "left")
    return out.select("chunk_id", "message_id", "conversation_id", F.coalesce("space", F.lit("none")).alias("space"))


@query(f"SELECT m.conversation_id, count(*) AS blocks, count_if(b.block_type IN ('code', 'mermaid')) AS code_blocks, CAST(sum(b.source_char_end - b.source_char_start) AS BIGINT) AS chars FROM {_BL} b JOIN {_MS} m ON m.id = b.message_id WHERE m.conversation_id IS NOT NULL GROUP BY 1")
def block_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Blocks, code blocks and characters of each conversation, counted from its blocks."""
    x = _blocks(spark, d).join(messages(spark, d).select(F.col("id").alias("message_id"), "conversation_id"), "message_id").where("conversation_id is not null")
    return x.groupBy("conversation_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("block_type").isin("code", "mermaid")).alias("code_blocks"), F.sum(F.col("source_char_end") - F.col("source_char_start")).cast("long").alias("chars"))


_REQUIRED = {"messages": ("id", "conversation_id", "ordinal", "role", "raw_text", "embedding"), "blocks": ("id", "message_id", "block_type", "sha"), "retrieval_chunks": ("id", "block_id", "text")}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in _REQUIRED.items() for c in cs) + ") r(table_name, field) EXCEPT SELECT table_name, column_name FROM information_schema.columns")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    """Required fields that the tables lack."""
    need = spark.createDataFrame([(t, c) for t, cs in _REQUIRED.items() for c in cs], "table_name string, field string")
    have = spark.createDataFrame([(t, c) for t in _REQUIRED for c in table(spark, d, t).columns], "table_name string, field string")
    return need.exceptAll(have)


@query("""SELECT embedding_space_id AS space, count(*) AS vectors, count_if(contains(embedding_space_id, 'sentence-transformers')) AS legacy FROM dense_native_metadata GROUP BY 1""")
def legacy_spaces(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "dense_native_metadata")
    fits = embed.legacy_compatible(F.col("embedding_space_id"), F.lit("sentence-transformers-dense;dim=64"))
    return v.groupBy(F.col("embedding_space_id").alias("space")).agg(F.count("*").alias("vectors"), F.count_if(fits).alias("legacy"))


@query("""WITH v AS (SELECT embedding_space_id AS space, CASE WHEN vector IS NULL THEN 'null' WHEN len(vector) = 0 THEN 'empty' WHEN len(vector) <> dim THEN 'length' WHEN NOT list_bool_and(list_transform(vector, lambda e: coalesce(isfinite(e), false))) THEN 'not finite' WHEN NOT list_bool_or(list_transform(vector, lambda e: e <> 0)) THEN 'zero' ELSE 'usable' END AS state FROM dense_native_metadata)
SELECT space, count_if(state = 'usable') AS migrated, count_if(state <> 'usable') AS rejected, CAST(ceil(count_if(state = 'usable') / 256.0) AS BIGINT) AS batches FROM v GROUP BY 1""")
def vector_migration(spark: SparkSession, d: str) -> DataFrame:
    """Vectors from their form as JSON text to native ones: what is taken over, in batches of 256, and what is rejected."""
    old = table(spark, d, "dense_native_metadata").select(F.col("embedding_space_id").alias("space"), "dim", F.to_json("vector", {"ignoreNullFields": "false"}).alias("vector_json"), F.col("vector").isNull().alias("none"))
    native = old.withColumn("vector", F.when(~F.col("none"), F.from_json("vector_json", "array<float>")))
    ok, bad = writers.checked_vectors(native, "vector", "dim")
    both = ok.select("space", F.lit(1).alias("good")).unionByName(bad.select("space", F.lit(0).alias("good")))
    good = F.sum("good").cast("long")
    return both.groupBy("space").agg(good.alias("migrated"), (F.count("*") - good).alias("rejected"), F.ceil(good / 256).cast("long").alias("batches"))


@query(f"""WITH {_MEMBERS}, n AS (SELECT 'node_' || substr(sha256(concat_ws(chr(31), 'semantic_node', group_type, group_id)), 1, 32) AS node_id, group_type AS node_type, group_id, count(*) AS members FROM mb GROUP BY ALL) SELECT * FROM n""")
def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Nodes written twice, the second time over half of the first: an upsert by their ids changes nothing."""
    n = graph.nodes(_members(spark, d))
    return writers.upsert(writers.upsert(n.where("node_type = 'project'"), n, ["node_id"]), n, ["node_id"])


@query(f"""WITH n AS (SELECT b.id, b.block_type, count(c.id) AS n FROM {_BL} b LEFT JOIN {_CH} c ON c.block_id = b.id GROUP BY 1, 2)
SELECT block_type, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS chunks, max(n) AS most, quantile_cont(n, 0.5) AS median, count_if(n = 0) AS without FROM n GROUP BY 1""")
def database_observations(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each type and how many chunks they have."""
    n = _blocks(spark, d).select(F.col("id").alias("block_id"), "block_type").join(chunks(spark, d).groupBy("block_id").agg(F.count("*").alias("n")), "block_id", "left").na.fill(0, ["n"])
    return n.groupBy("block_type").agg(F.count("*").alias("blocks"), F.sum("n").cast("long").alias("chunks"), F.max("n").alias("most"), F.percentile("n", F.lit(0.5)).alias("median"), F.count_if(F.col("n") == 0).alias("without"))


@query()
def storage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows, files and bytes of every table."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(d).getFileSystem(sc._jsc.hadoopConfiguration())
    out = None
    for t in ("conversations", "messages", "blocks", "retrieval_chunks", "dense_native_metadata", "snapshot_rows", "native_retrieval_hits", "real_probes", "documents"):
        s = fs.getContentSummary(path(f"{d}/{t}.parquet"))
        one = table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("rows")).withColumns({"files": F.lit(s.getFileCount()).cast("long"), "bytes": F.lit(s.getLength()).cast("long")})
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""SELECT id, CASE WHEN trim(coalesce(conversation_id, '')) <> '' THEN {_hash('source:conversation', 'conversation_id')} ELSE {_hash('fallback:conversation', 'title', 'create_time_utc')} END AS identity, CASE WHEN trim(coalesce(conversation_id, '')) <> '' THEN 'native' ELSE 'fallback' END AS method FROM conversations""")
def source_identities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    identity, method = lineage.source_identity(F.col("conversation_id"), "conversation", F.col("title"), F.col("create_time_utc"))
    return c.select("id", identity.alias("identity"), method.alias("method"))


_CANON = "regexp_replace(regexp_replace(regexp_replace(nfc_normalize(raw_text), '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '^\\n+|\\n+$', '', 'g')"


@query(f"SELECT id, {_hash('message', 'id', 'lower(trim(role))', _CANON)} AS revision FROM {_MS} WHERE id IS NOT NULL")
def message_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Revisions of messages: equal for texts that differ in line ends, blank edges and normal form only."""
    m = messages(spark, d).where("id is not null")
    return m.select("id", lineage.message_revision(F.col("id"), F.col("role"), F.col("raw_text")).alias("revision"))


@query("""WITH p AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 256 AS b FROM (SELECT DISTINCT id FROM retrieval_chunks WHERE id IS NOT NULL)) SELECT b AS batch, sha256(concat_ws(chr(31), 'contract', min(id), max(id), CAST(count(*) AS VARCHAR))) AS batch_id, count(*) AS chunks FROM p GROUP BY 1""")
def batch_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identities of embedding batches: their contract, ends and size."""
    ids = lineage.numbered(table(spark, d, "retrieval_chunks").select("id").where("id is not null").distinct(), "id")
    g = ids.groupBy(F.floor(F.col("at") / 256).alias("batch")).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("chunks"))
    return g.select("batch", lineage.ids.batch_id(F.lit("contract"), F.col("a"), F.col("b"), F.col("chunks")).alias("batch_id"), "chunks")


_PATH = "CASE WHEN doc_id % 5 = 0 THEN 'Common/useful/' WHEN doc_id % 5 = 1 THEN 'Common/potential_trash/' WHEN doc_id % 5 = 2 THEN 'Pinned/' WHEN doc_id % 5 = 3 THEN 'Projects/one/' ELSE 'Projects/attachments/two/' END || file_name"


@query(f"""WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents WHERE file_name IS NOT NULL), k AS (SELECT doc_id, path, CASE WHEN path LIKE 'Common/useful/%' THEN 'common_useful' WHEN path LIKE 'Common/potential_trash/%' THEN 'common_trash' WHEN path LIKE 'Pinned/%' THEN 'pinned' ELSE 'project' END AS folder FROM p)
SELECT doc_id, folder AS folder_kind, CASE WHEN contains(path, '/attachments/') THEN 'attachment' WHEN path LIKE '%.md' THEN 'chat_md' ELSE 'attachment' END AS file_kind, CASE WHEN folder = 'common_trash' THEN 'low' ELSE 'normal' END AS tier FROM k""")
def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds and interest of files by their paths; documents are laid into made-up folders."""
    p = table(spark, d, "documents").where("file_name is not null").select("doc_id", F.expr(_PATH.replace("||", "||")).alias("path"))
    kind = distill.folder_kind(F.col("path"))
    return p.select("doc_id", kind.alias("folder_kind"), distill.file_kind(F.col("path")).alias("file_kind"), distill.interest_tier(kind).alias("tier"))


@query("""WITH l AS (SELECT template, 'Project_' || lpad(CAST(row_number() OVER (ORDER BY template) AS VARCHAR), 2, '0') AS label FROM (SELECT DISTINCT conversation_template_id AS template FROM conversations WHERE coalesce(conversation_template_id, '') <> ''))
SELECT id, CASE WHEN folder_kind = 'pinned' THEN 'Pinned' WHEN coalesce(conversation_template_id, '') <> '' THEN label ELSE 'Common' END AS group_name FROM conversations LEFT JOIN l ON l.template = conversation_template_id""")
def group_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    labels = distill.project_labels(c, "conversation_template_id").withColumnRenamed("template", "conversation_template_id")
    name = distill.group_name(F.coalesce(F.col("folder_kind") == "pinned", F.lit(False)), F.col("conversation_template_id"), F.col("label"))
    return c.join(labels, "conversation_template_id", "left").select("id", name.alias("group_name"))


@query("SELECT id FROM (SELECT DISTINCT id FROM messages WHERE ordinal % 3 = 0) WHERE id NOT IN (SELECT id FROM messages WHERE coalesce(ordinal % 2, 1) = 1 AND id IS NOT NULL)")
def appended_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a batch that a target lacks; batch and target are parts of the messages by ordinal, and the batch is appended twice."""
    m = table(spark, d, "messages").select("id", "ordinal").where("id is not null")
    target = m.where("coalesce(ordinal % 2, 1) = 1").select("id")
    batch = m.where("ordinal % 3 = 0").select("id")
    new = lineage.append_missing(target, batch, "id")
    return new.unionByName(lineage.append_missing(target.unionByName(new), batch, "id"))


@query("SELECT '' AS block_id, '' AS fault WHERE false")
def chunk_build_faults(spark: SparkSession, d: str) -> DataFrame:
    """Gaps, inexact texts, broken orders and too many tokens among the chunks that are built: there are none."""
    from ..operators import audit, chunk
    from ..sources import markdown

    b = markdown.blocks(messages(spark, d).select("id", "raw_text").distinct(), "id", "raw_text").withColumn("block_id", F.concat_ws(":", "id", "ordinal"))
    b = b.select("block_id", "char_start", "char_end", F.col("block_text").alias("text"))
    c = chunk.build(b, "block_id", "text", "char_start", chunk.policy([64]))
    return audit.chunk_faults(c, b, 64)
