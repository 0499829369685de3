"""Queries of the text functions over messages, conversations, documents and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text, vectors
from ..sources.tables import table
from .registry import query

_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_.-]{{3,}}'), lambda t: NOT regexp_full_match(t, '\\p{{N}}+')))"
_MESSAGES = "(SELECT DISTINCT id, conversation_id, ordinal, role, message_id, time_utc, raw_text FROM messages)"
_INTROS = ", ".join(f"'{w}'" for w in text.INTRODUCTIONS)
_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOKENS = f"list_filter(list_transform(regexp_extract_all({{0}}, '[A-Za-z0-9А-Яа-яЁё]{{{{2,}}}}'), lambda t: lower(t)), lambda t: length(t) >= 3 AND t NOT IN ({_STOPS}))"


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Message rows, each delivered once."""
    return table(spark, d, "messages").select("id", "conversation_id", "ordinal", "role", "message_id", "time_utc", "raw_text").distinct()


_INFO = f"""CASE WHEN s = '' OR regexp_replace(lower(s), '[:.!?…]+$', '') IN ({_INTROS}) THEN 0.0
 WHEN length(s) < 24 OR n < 3 THEN 0.15
 ELSE least(1.0, 0.35 + least(n, 14) / 20.0 - greatest(0.0, length(regexp_replace(s, '[^:;,.!?\\-—()\\[\\]{{}}]', '', 'g')) / CAST(length(s) AS DOUBLE) - 0.35)) END"""


@query(f"""WITH a AS (SELECT id, regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g') AS s FROM {_MESSAGES} WHERE raw_text IS NOT NULL),
b AS (SELECT id, s, len({_TERMS.format('s')}) AS n FROM a)
SELECT id, CAST(n AS INT) AS terms, round(CAST({_INFO} AS DOUBLE), 6) AS score FROM b""")
def information_score(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where("raw_text is not null")
    s = F.regexp_replace("raw_text", r"^\s+|\s+$", "")
    return m.select("id", F.size(text.meaningful_terms(s)).alias("terms"), F.round(text.information_score(F.col("raw_text")), 6).alias("score"))


@query(f"""SELECT id, greatest(1, (length(raw_text) + 3) // 4)::INT AS tokens,
 CASE WHEN length(raw_text) <= 100 THEN raw_text ELSE regexp_replace(substr(raw_text, 1, 99), '\\s+$', '') || '…' END AS clipped,
 CASE WHEN length(c) <= 320 THEN c ELSE regexp_replace(substr(c, 1, 319), '\\s+$', '') || '…' END AS preview
FROM (SELECT *, trim(regexp_replace(raw_text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS c FROM {_MESSAGES} WHERE raw_text IS NOT NULL)""")
def trim_preview(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("raw_text")
    return messages(spark, d).where("raw_text is not null").select("id", text.estimate_tokens(t).alias("tokens"), text.clip(t, 100).alias("clipped"), text.preview(t).alias("preview"))


@query("""SELECT id, left(CASE WHEN s = '' THEN left(id, 12) ELSE s END, 120) AS slug,
 coalesce(nullif(regexp_replace(trim(regexp_replace(regexp_replace(trim(title), '[/:]', '_', 'g'), '\\s+', ' ', 'g')), '^\\.+|\\.+$', '', 'g'), ''), id) AS file_name
FROM (SELECT id, title, regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9а-яё]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM conversations WHERE title IS NOT NULL)""")
def slugify_titles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("title is not null")
    return c.select("id", text.slug(F.col("title"), F.col("id")).alias("slug"), text.safe_file_name(F.col("title"), F.col("id")).alias("file_name"))


@query(f"""WITH t AS (SELECT id, {_TOKENS.format('title')} AS w FROM conversations WHERE title IS NOT NULL),
g AS (SELECT id, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM t, range(1, 4) r(n), range(1, 40) q(i) WHERE i + n - 1 <= len(w))
SELECT phrase, count(DISTINCT id) AS titles FROM g GROUP BY 1""")
def title_ngrams(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("title is not null")
    grams = c.select("id", F.explode(text.phrases(text.title_tokens(F.col("title")))).alias("phrase"))
    return grams.groupBy("phrase").agg(F.countDistinct("id").alias("titles"))


@query("""SELECT doc_id, c AS cyrillic, l AS latin, CASE WHEN c > 0 AND l > 0 AND least(c, l) * 3 >= greatest(c, l) THEN 'mixed' WHEN c > l THEN 'ru' ELSE 'en' END AS script_language
FROM (SELECT doc_id, length(regexp_replace(text, '[^\\x{0400}-\\x{04FF}]', '', 'g'))::INT AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::INT AS l FROM documents WHERE text IS NOT NULL)""")
def language_heuristic(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    n = lambda p: F.length(F.regexp_replace(t, p, ""))
    return table(spark, d, "documents").where("text is not null").select("doc_id", n(r"[^Ѐ-ӿ]").alias("cyrillic"), n("[^A-Za-z]").alias("latin"), text.script_language(t).alias("script_language"))


_EN = ", ".join(f"'{w}'" for w in text.ENGLISH_FUNCTION_WORDS)
_ASK = ", ".join(f"'{w}'" for w in text.QUESTION_WORDS)


@query(f"""WITH p AS (SELECT probe_id, query, said, list_transform(regexp_extract_all(query, '[A-Za-z][A-Za-z''-]*'), lambda w: lower(w)) AS w,
 len(regexp_extract_all(query, '[А-яЁё]')) AS cyr, len(regexp_extract_all(query, '[А-Яа-яЁё]{{2,}}')) AS rus FROM (SELECT *, unnest(['ru', 'en']) AS said FROM real_probes))
SELECT probe_id, said, CASE WHEN said = 'ru' AND cyr = 0 AND len(w) >= 5 AND (len(list_distinct(list_filter(w, lambda x: x IN ({_EN})))) >= 2
 OR (regexp_replace(query, '\\s+$', '') LIKE '%?' AND len(list_filter(w, lambda x: x IN ({_ASK}))) > 0)) THEN 'english sentence'
 WHEN said = 'en' AND rus >= 3 THEN 'russian sentence' END AS mismatch FROM p""")
def query_language_mismatch(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "real_probes").select("probe_id", "query", F.explode(F.array(F.lit("ru"), F.lit("en"))).alias("said"))
    return p.select("probe_id", "said", text.language_mismatch(F.col("query"), F.col("said")).alias("mismatch"))


@query("""SELECT doc_id, array_to_string(list_filter([
 CASE WHEN length(regexp_replace(text, '[^\\x{0400}-\\x{04FF}]', '', 'g')) > 200 THEN 'russian_or_mixed' END, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 300 THEN 'english_or_mixed' END,
 CASE WHEN length(text) > 4000 THEN 'long_message_candidate' END, CASE WHEN length(text) > 8000 THEN 'very_long_message_candidate' END,
 CASE WHEN contains(text, '```') THEN 'fenced_code' END, CASE WHEN contains(text, chr(10) || '|') THEN 'table' END,
 CASE WHEN contains(text, chr(10) || '- ') OR contains(text, chr(10) || '* ') THEN 'list' END, CASE WHEN regexp_matches(text, '[\\x{1F301}-\\x{10FFFF}]') THEN 'emoji' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM documents WHERE text IS NOT NULL""")
def selection_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(text.selection_reasons(F.col("text")), ",").alias("reasons"))


@query("""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split_regex(right(text, 2000), '\\s+'), lambda x: regexp_replace(x, '^[.,:;!?()\\[\\]{}<>`*_#]+|[.,:;!?()\\[\\]{}<>`*_#]+$', '', 'g')), lambda x: length(x) >= 3) AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce(nullif(array_to_string(a[greatest(1, len(a) - 7):], ' '), ''), 'preflight tail query') AS tail FROM w""")
def tail_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.tail_query(F.col("text")).alias("tail"))


@query("""SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\\s)>"'']+')) AS urls, len(regexp_extract_all(text, '```')) // 2 AS code_blocks,
 CAST(greatest(1, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))) AS INT) AS words, len(regexp_extract_all(lower(text), '[a-z0-9а-яё_]{2,}')) AS terms FROM documents WHERE text IS NOT NULL""")
def token_counters(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", text.urls(t).cast("long").alias("urls"), text.code_blocks(t).cast("long").alias("code_blocks"), text.word_count(t).alias("words"), F.size(vectors.terms(t)).cast("long").alias("terms")
    )


@query("""SELECT DISTINCT id, 'msg_' || substr(sha256(concat_ws(chr(31), coalesce(conversation_id, ''), coalesce(CAST(ordinal AS VARCHAR), ''), coalesce(message_id, ''))), 1, 32) AS stable FROM messages""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("id", ids.stable_id("msg", F.col("conversation_id"), F.col("ordinal"), F.col("message_id")).alias("stable")).distinct()


@query("""SELECT DISTINCT chunk_policy_id, regexp_extract(chunk_policy_id, 'canonical_token_chunks:([^;]+)', 1) AS version, CAST(regexp_extract(chunk_policy_id, 'limit=(\\d+)', 1) AS INT) AS "limit",
 CAST(regexp_extract(chunk_policy_id, 'content=(\\d+)', 1) AS INT) AS content, CAST(regexp_extract(chunk_policy_id, 'fallback_overlap=(\\d+)', 1) AS INT) AS fallback_overlap, CAST(regexp_extract(chunk_policy_id, 'reserve=(\\d+)', 1) AS INT) AS reserve FROM retrieval_chunks""")
def policy_fields(spark: SparkSession, d: str) -> DataFrame:
    f = ids.policy_fields(F.col("chunk_policy_id"))
    return table(spark, d, "retrieval_chunks").select("chunk_policy_id").distinct().select("chunk_policy_id", *(c.alias(n) for n, c in f.items()))


def slices(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with their text, cut from the message by code points."""
    m = table(spark, d, "messages").where("raw_text is not null").groupBy("id").agg(F.first("raw_text").alias("raw_text"))
    b = table(spark, d, "blocks").select("id", "message_id", "ordinal", "block_type", "language", "source_char_start", "source_char_end")
    cut = F.substring("raw_text", F.col("source_char_start") + 1, F.col("source_char_end") - F.col("source_char_start"))
    return b.join(m.withColumnRenamed("id", "message_id"), "message_id").withColumn("text", cut)


_SLICES = "(SELECT b.*, substr(m.raw_text, b.source_char_start + 1, b.source_char_end - b.source_char_start) AS text FROM blocks b JOIN (SELECT id, min(raw_text) AS raw_text FROM messages WHERE raw_text IS NOT NULL GROUP BY 1) m ON m.id = b.message_id)"


def _all(p: str) -> str:
    return f"(len(l) > 0 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '{p}'))) = 0)"


@query(f"""WITH s AS (SELECT id, block_type, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM {_SLICES} WHERE block_type <> 'code')
SELECT id, block_type, CASE WHEN {_all('^\\|.*\\|$')} THEN 'table' WHEN {_all('^>')} THEN 'quote' WHEN {_all('^([-*+]|\\d+\\.)\\s+')} THEN 'list' WHEN {_all('^#{1,6}\\s')} THEN 'heading' ELSE 'prose' END AS kind FROM s""")
def block_classify(spark: SparkSession, d: str) -> DataFrame:
    return slices(spark, d).where("block_type <> 'code'").select("id", "block_type", text.block_kind(F.col("text")).alias("kind"))


@query(f"""SELECT block_type, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, count_if(block_type = 'code' AND starts_with(text, '```')) AS fenced FROM {_SLICES} GROUP BY 1""")
def block_text_slices(spark: SparkSession, d: str) -> DataFrame:
    s = slices(spark, d)
    return s.groupBy("block_type").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_if((F.col("block_type") == "code") & F.col("text").startswith("```")).alias("fenced"))


@query("""SELECT event_id, epoch(ts)::BIGINT AS seconds, strftime(to_timestamp(epoch(ts)::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events""")
def iso_times(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")  # event times carry no zone and are read as UTC
    return table(spark, d, "events").select("event_id", seconds.alias("seconds"), text.iso_time(seconds.cast("double")).alias("iso"))


@query("""SELECT a.chunk_id AS chunk_id, b.id AS dup_id, round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 6) AS similarity
FROM (SELECT id AS chunk_id, block_id, ordinal, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_.-]{3,}'), lambda t: NOT regexp_full_match(t, '\\p{N}+'))) AS t FROM (SELECT DISTINCT id, block_id, ordinal, text FROM retrieval_chunks)) a
JOIN (SELECT id, block_id, ordinal, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_.-]{3,}'), lambda t: NOT regexp_full_match(t, '\\p{N}+'))) AS t FROM (SELECT DISTINCT id, block_id, ordinal, text FROM retrieval_chunks)) b
ON a.block_id = b.block_id AND b.ordinal = a.ordinal + 1 WHERE len(a.t) > 0 AND len(b.t) > 0""")
def lexical_similarity_neighbours(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "retrieval_chunks").select("id", "block_id", "ordinal", "text").distinct().select("id", "block_id", "ordinal", text.meaningful_terms(F.col("text")).alias("t"))
    a, b = c.alias("a"), c.select(F.col("id").alias("dup_id"), "block_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("t").alias("u"))
    return a.join(b, ["block_id", "ordinal"]).where((F.size("t") > 0) & (F.size("u") > 0)).select(F.col("id").alias("chunk_id"), "dup_id", F.round(text.jaccard(F.col("t"), F.col("u")), 6).alias("similarity"))


@query("""SELECT message_id, ordinal, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{2,}'), lambda x: true))), ' ') AS words FROM """ + _SLICES + """ WHERE block_type = 'list'""")
def overlap_terms(spark: SparkSession, d: str) -> DataFrame:
    return slices(spark, d).where("block_type = 'list'").select("message_id", "ordinal", F.array_join(F.array_sort(text.overlap_terms(F.col("text"))), " ").alias("words"))
