"""Queries of parsing, chunking, naming and whole search pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import assemble, audit, chunk, distill, embed, evaluate, retrieve  # noqa: F401
from ..sources import markdown
from ..sources.tables import table
from .archive import _HITS, _hits, chunks
from .registry import query
from .texts import _INFO, _TERMS, messages

_LINES = """l AS (SELECT id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT id, string_split(raw_text, chr(10)) AS a FROM (SELECT DISTINCT id, raw_text FROM messages WHERE raw_text IS NOT NULL))),
o AS (SELECT *, regexp_matches(line, '^```[A-Za-z0-9_+.-]*\\s*$') AS f, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM l),
c AS (SELECT *, sum(f::INT) OVER (PARTITION BY id ORDER BY pos) AS n FROM o), k AS (SELECT *, n % 2 = 1 OR f AS code, CASE WHEN n % 2 = 1 OR f THEN (n + 1) // 2 ELSE n // 2 END AS gid FROM c),
g AS (SELECT id, code, gid, min(st) AS a, max(st + length(line)) AS b FROM k GROUP BY 1, 2, 3), m AS (SELECT DISTINCT id, raw_text FROM messages WHERE raw_text IS NOT NULL),
t AS (SELECT g.*, substr(raw_text, (a + 1)::BIGINT, (b - a)::BIGINT) AS raw FROM g JOIN m USING (id)),
e AS (SELECT id, code, a + CASE WHEN code THEN 0 ELSE length(raw) - length(ltrim(raw, chr(10))) END AS s, b - CASE WHEN code THEN 0 ELSE length(raw) - length(rtrim(raw, chr(10))) END AS e, raw FROM t)"""


@query(f"WITH {_LINES} SELECT id, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS ordinal, code, CAST(s AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end FROM e WHERE e > s AND (code OR regexp_matches(raw, '\\S'))")
def block_segmentation(spark: SparkSession, d: str) -> DataFrame:
    b = markdown.blocks(messages(spark, d).select("id", "raw_text").distinct(), "id", "raw_text")
    return b.select("id", "ordinal", F.col("block_type").isin("code", "mermaid").alias("code"), "char_start", "char_end")


_DL = """l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)), o AS (SELECT *, regexp_matches(line, '^```[A-Za-z0-9_+.-]*\\s*$') AS f FROM l),
c AS (SELECT *, sum(f::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM o), h AS (SELECT *, NOT f AND n % 2 = 0 AND regexp_matches(line, '(?i)^### (\\d+)\\. (USER|ASSISTANT|SYSTEM|TOOL|UNKNOWN)\\s*$') AS head FROM c)"""


@query(f"""WITH {_DL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal, CAST(regexp_extract(line, '^### (\\d+)', 1) AS BIGINT) AS heading_ordinal, lower(regexp_extract(line, '(?i)^### \\d+\\. (USER|ASSISTANT|SYSTEM|TOOL|UNKNOWN)', 1)) AS role FROM h WHERE head""")
def heading_detection(spark: SparkSession, d: str) -> DataFrame:
    return markdown.messages(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "ordinal", "heading_ordinal", "role")


@query("""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
s AS (SELECT *, last_value(CASE WHEN line LIKE '## %' THEN lower(trim(substr(line, 4, 100), ' ')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l),
f AS (SELECT doc_id, pos, regexp_replace(lower(trim(regexp_extract(line, '^- `?([^`:]+)`?: ?(.*)$', 1), ' ')), '[ -]', '_', 'g') AS name, regexp_replace(trim(regexp_extract(line, '^- `?([^`:]+)`?: ?(.*)$', 2), ' '), '^`(.*)`$', '\\1') AS value FROM s WHERE section = 'metadata' AND regexp_matches(line, '^- `?([^`:]+)`?: ?(.*)$'))
SELECT doc_id, name, arg_max(value, pos) AS value FROM f GROUP BY 1, 2""")
def markdown_metadata(spark: SparkSession, d: str) -> DataFrame:
    return markdown.metadata(table(spark, d, "documents"), "doc_id", "text")


@query()
def markdown_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Conversations rendered to Markdown and parsed again: messages and readable headings of each."""
    c = table(spark, d, "conversations").select(F.col("id").alias("conversation_id"), "title").distinct()
    m = messages(spark, d).where("ordinal is not null").join(c, "conversation_id")
    doc = markdown.render(m, "conversation_id", F.col("title"))
    back = markdown.messages(doc, "conversation_id", "markdown").groupBy("conversation_id").agg(F.count("*").alias("parsed"))
    return m.groupBy("conversation_id").agg(F.count("*").alias("rendered")).join(back, "conversation_id", "left")


@query()
def retrieval_chunk_build(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the messages cut to 60 tokens of content, as the archive's own policy says."""
    b = markdown.blocks(messages(spark, d).select("id", "raw_text").distinct(), "id", "raw_text")
    b = b.withColumn("block_id", F.concat_ws(":", "id", "ordinal"))
    return chunk.build(b, "block_id", "block_text", "char_start", chunk.policy([64]))


@query()
def chunk_audit(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, limits and reasons of the chunks that are built."""
    c = retrieval_chunk_build(spark, d)
    return c.groupBy("split_reason").agg(F.count("*").alias("chunks"), F.max("token_count").alias("longest"), F.sum("overlap_token_count").alias("overlap"), F.count_if(F.col("token_count") > 64).alias("over_limit"))


_TT = "list_filter(list_transform(regexp_extract_all(title, '[A-Za-z0-9А-Яа-яЁё]{2,}'), lambda t: lower(t)), lambda t: length(t) >= 3 AND t NOT IN (" + ", ".join(f"'{w}'" for w in __import__("stratalog.functions.text", fromlist=["STOP_WORDS"]).STOP_WORDS) + "))"


@query(f"""WITH t AS (SELECT project_id, id, {_TT} AS w FROM conversations WHERE title IS NOT NULL AND project_id IS NOT NULL),
g AS (SELECT DISTINCT project_id, id, array_to_string(w[i:i + n - 1], ' ') AS p, n AS k FROM t, range(1, 4) r(n), range(1, 40) q(i) WHERE i + n - 1 <= len(w)), c AS (SELECT project_id, p, k, count(*) AS n FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 2),
b AS (SELECT project_id, p FROM c WHERE k >= 2 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, k DESC, p DESC) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, p) AS r FROM c WHERE k = 1 QUALIFY r <= 2),
s AS (SELECT project_id, string_agg(p, ' ' ORDER BY r) AS p FROM r GROUP BY 1)
SELECT a.project_id, array_to_string(list_transform(string_split(coalesce(b.p, s.p), ' '), lambda t: CASE WHEN regexp_full_match(t, '[A-Za-z]{{1,4}}') THEN upper(t) ELSE upper(left(t, 1)) || lower(substr(t, 2)) END), ' ') AS name, CASE WHEN b.p IS NOT NULL THEN 'high' WHEN s.p IS NOT NULL THEN 'medium' ELSE 'none' END AS confidence FROM (SELECT DISTINCT project_id FROM conversations WHERE project_id IS NOT NULL) a LEFT JOIN b USING (project_id) LEFT JOIN s USING (project_id)""")
def project_naming(spark: SparkSession, d: str) -> DataFrame:
    n = distill.project_names(table(spark, d, "conversations").where("project_id is not null"), "project_id", "title")
    return n.select("project_id", "name", "confidence")


@query("""WITH h AS (SELECT DISTINCT id, text FROM retrieval_chunks), e AS (SELECT id, i, ('0x' || substr(sha256(i || chr(31) || text), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0::DOUBLE * 2 - 1 AS x FROM h, range(0, 16) r(i)), n AS (SELECT id, sqrt(sum(x * x)) AS l FROM e GROUP BY 1)
SELECT id, i AS position, round(x / l, 6) AS value FROM e JOIN n USING (id)""")
def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = embed.hashed_dense(chunks(spark, d).select("id", "text").distinct(), "id", "text")
    return v.select("id", F.posexplode("vector").alias("position", "value")).select("id", F.col("position").cast("long").alias("position"), F.round("value", 6).alias("value"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the probes with query, text and place."""
    c = chunks(spark, d).select(F.col("id").alias("chunk_id"), "block_id", F.col("source_char_start").alias("char_start"), F.col("source_char_end").alias("char_end"), "text").dropDuplicates(["chunk_id"])
    p = table(spark, d, "real_probes").groupBy("probe_id").agg(F.first("query").alias("query_text"))
    v = table(spark, d, "conversations").groupBy(F.col("id").alias("conversation_id")).agg(F.first("project_id").alias("project_id"))
    return _hits(spark, d).withColumnRenamed("score", "fused").join(c, "chunk_id").join(p, "probe_id").join(v, "conversation_id", "left")


@query(f"""WITH {_HITS}, x AS (SELECT k.probe_id, k.chunk_id, k.score AS fused, regexp_replace(c.text, '^\\s+|\\s+$', '', 'g') AS s, {_TERMS.format('c.text')} AS ct, {_TERMS.format('p.query')} AS qt FROM k JOIN (SELECT id, min(text) AS text FROM retrieval_chunks GROUP BY 1) c ON c.id = k.chunk_id JOIN (SELECT probe_id, min(query) AS query FROM real_probes GROUP BY 1) p ON p.probe_id = k.probe_id),
i AS (SELECT *, {_INFO.replace(' n < 3', ' len(ct) < 3').replace('least(n, 14)', 'least(len(ct), 14)')} AS info FROM x)
SELECT probe_id, chunk_id, round(CAST(fused + 0.035 * len(list_intersect(qt, ct)) / greatest(1, len(qt)) + 0.012 * info - CASE WHEN info <= 0.15 THEN 0.018 ELSE 0 END AS DOUBLE), 6) AS rerank FROM i""")
def rerank_score(spark: SparkSession, d: str) -> DataFrame:
    return assemble.rerank(_asked(spark, d)).select("probe_id", "chunk_id", F.round("rerank", 6).alias("rerank"))


def _searched(spark: SparkSession, d: str) -> DataFrame:
    """Focused results of every probe, with the messages beside each excerpt."""
    b = table(spark, d, "blocks").select(F.col("id").alias("block_id"), "message_id").distinct()
    m = messages(spark, d)
    at = b.join(m.select(F.col("id").alias("message_id"), F.col("ordinal").alias("message_ordinal")), "message_id").dropDuplicates(["block_id"]).select("block_id", "message_ordinal")
    hits = assemble.rerank(_asked(spark, d)).join(at, "block_id", "left")
    return assemble.focused(assemble.with_context(hits, m, 1), "probe_id")


@query()
def search_archive(spark: SparkSession, d: str) -> DataFrame:
    """Focused search of every probe: rerank, evidence groups, diversification, excerpts and neighbouring messages within the budget."""
    out = _searched(spark, d)
    near = F.array_join(F.transform("context", lambda c: c["message_id"]), " ")
    return out.select("probe_id", "place", "chunk_id", "message_id", "conversation_id", "chunks", "excerpt", near.alias("context"), F.round("rerank", 6).alias("rerank"))


@query()
def search_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What each focused result covers, and its warnings."""
    return assemble.coverage(_searched(spark, d), "probe_id")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL AND coalesce(source, '') <> 'chat_md'),
p AS (SELECT doc_id, string_split_regex(t, '\n{2,}') AS a FROM t), u AS (SELECT doc_id, unnest(a) AS block_text, generate_subscripts(a, 1) - 1 AS ordinal FROM p)
SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, block_text FROM u WHERE regexp_matches(block_text, '[^ \t\n\x{0B}\f\r]')""")
def attachment_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that aren't chats, as ordered paragraphs; one without a source is no chat."""
    t = table(spark, d, "documents").where("text is not null and coalesce(source, '') <> 'chat_md'")
    p = t.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), r"\n{2,}")).alias("ordinal", "block_text")).where(F.col("block_text").rlike(r"\S"))
    return p.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "block_text")
