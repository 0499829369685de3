"""Lineage: identities, revisions, diffs, generation manifests and atomic publishing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..session import settle
from . import audit


def source_identity(native: Column, kind: str, *fallback: Column) -> tuple[Column, Column]:
    """(identity, method): of the native id, or of the fallback parts where that is null or empty."""
    has = F.coalesce(F.trim(native), F.lit("")) != ""
    return F.when(has, ids.content_hash(f"source:{kind}", native)).otherwise(ids.content_hash(f"fallback:{kind}", *fallback)), F.when(has, "native").otherwise("fallback")


def message_revision(identity: Column, role: Column, text: Column) -> Column:
    """Changes only with what a message says: line ends, blank edges and normal form don't matter."""
    return ids.content_hash("message", identity, F.lower(F.trim(role)), ids.canonical_text(text))


# Versions that are part of derived identities.
CANONICALIZER, BLOCK_BUILDER, CHUNKER = "1", "1", "2"


def conversation_revision(identity: Column, *fields: Column) -> Column:
    """Changes with what a conversation's record says: its ids, title, times and metadata."""
    return ids.content_hash("conversation", identity, *fields)


def block_identity(revision: Column, ordinal: Column, kind: Column, language: Column, start: Column, end: Column) -> Column:
    """A block of one revision of a message: another place, type or builder is another block."""
    return F.concat(F.lit("block_"), ids.content_hash("block", revision, F.lit(BLOCK_BUILDER), ordinal, kind, language, start, end))


def chunk_derivation(revision: Column, block: Column, policy: Column) -> Column:
    """What a chunk is derived from: it is made anew where this changes."""
    return ids.content_hash("chunk-derivation", revision, block, F.lit(CANONICALIZER), F.lit(BLOCK_BUILDER), F.lit(CHUNKER), policy)


def chunk_identity(derivation: Column, ordinal: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("chunk_"), ids.content_hash("chunk", derivation, ordinal, start, end))


def resume(chunks: DataFrame, dense: DataFrame, sparse: DataFrame, key: str, size: int = 64) -> DataFrame:
    """(key, state, batch): what an embedding job that was stopped has still to do.

    A chunk with both representations is complete, with one of them it is a repair (the half pair is
    replaced), else it is pending.  What is stored decides, no cursor: a job that is run again after any
    failure takes up the rest.  Batches of size number what isn't complete, in order of the key.
    """
    have = lambda df, c: df.select(key).distinct().withColumn(c, F.lit(1))
    all_ = chunks.select(key).distinct().join(have(dense, "_d"), key, "left").join(have(sparse, "_s"), key, "left")
    state = F.when(F.col("_d").isNotNull() & F.col("_s").isNotNull(), "complete").when(F.col("_d").isNotNull() | F.col("_s").isNotNull(), "repair").otherwise("pending")
    rows = all_.select(key, state.alias("state"))
    at = numbered(rows.where("state <> 'complete'").select(key), key).select(key, F.floor(F.col("at") / size).alias("batch"))
    return rows.join(at, key, "left")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with at, the place of each row in order of a unique key from 0: ranges are sorted apart and shifted by the counts before them."""
    rows = settle(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    n = rows.groupBy(task.alias("_t")).agg(F.count("*").alias("_n"))  # a row a task
    before = n.select("_t", (F.sum("_n").over(Window.orderBy("_t")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), task == F.col("_t")).withColumn("at", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_t", "_before")


def reindex(spark: SparkSession, root: str, generation: str, canonical: list[str], derive) -> str:
    """Publish a generation with the current one's canonical tables and derived tables made anew.

    derive takes the canonical tables by name and gives the derived ones.  The new generation is
    named only if its canonical tables have the fingerprints of the current ones; otherwise, or if
    anything fails, the current generation stays.
    """
    old = current(spark, root)
    if old is None:
        raise ValueError("there is no generation to reindex")
    kept = {n: spark.read.parquet(f"{old}/{n}.parquet") for n in canonical}

    def same(written: dict[str, DataFrame]) -> None:
        a, b = ({r["table_name"]: (r["rows"], r["fingerprint"]) for r in manifest({n: t[n] for n in canonical}).collect()} for t in (kept, written))
        if a != b:
            raise ValueError(f"canonical tables differ: {sorted(n for n in a if a[n] != b[n])}")

    return publish(spark, root, generation, kept | derive(kept), guard=same)


def compare_revisions(old: DataFrame, new: DataFrame, key: str, revision: str) -> DataFrame:
    """(key, state, old, new): unchanged, changed, new or absent; absent is never a deletion."""
    a, b = old.select(key, F.col(revision).alias("old"), F.lit(1).alias("_o")), new.select(key, F.col(revision).alias("new"), F.lit(1).alias("_n"))
    state = F.when(F.col("_n").isNull(), "absent").when(F.col("_o").isNull(), "new").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"), "old", "new")


def embedding_contract(model: str, dim: int, space: str, **fields: str | int) -> str:
    """Fingerprint of what decides a vector's value; batch size and device aren't part of it."""
    import hashlib

    body = {"model": model, "dim": dim, "space": space} | {k: v for k, v in fields.items() if k not in ("batch_size", "device")}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows, fingerprint): counts and order-free fingerprints of a generation's tables."""
    out = None
    for name, df in sorted(tables.items()):
        one = audit.fingerprint(df, sorted(df.columns)).select(F.lit(name).alias("table_name"), "rows", "fingerprint")
        out = one if out is None else out.unionByName(one)
    return out


def publish(spark: SparkSession, root: str, generation: str, tables: dict[str, DataFrame], check: bool = True, guard=None) -> str:
    """Write the tables as one generation and then name it in CURRENT; readers see the old or the new one, never a part.

    The manifest is written with the tables; a generation that exists is never overwritten.
    """
    at = f"{root}/generations/{generation}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{at}/{name}.parquet")
    written = {name: spark.read.parquet(f"{at}/{name}.parquet") for name in tables}
    m = manifest(written)
    m.write.mode("errorifexists").parquet(f"{at}/manifest.parquet")
    if check and (bad := orphans_of(written)):
        raise ValueError(f"generation {generation} isn't whole: {bad}")
    if guard:
        guard(written)
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    stage, final = hadoop.Path(f"{root}/CURRENT.{generation}"), hadoop.Path(f"{root}/CURRENT")
    out = stage.getFileSystem(sc._jsc.hadoopConfiguration()).create(stage, True)
    out.write(bytearray(generation.encode()))
    out.close()
    # one rename that replaces the old file: there is never none
    options = sc._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(final.toUri(), sc._jsc.hadoopConfiguration()).rename(stage, final, options)
    return at


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the published generation, or None."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return f"{root}/generations/" + spark.read.text(f"{root}/CURRENT").first()[0].strip()


def orphans_of(tables: dict[str, DataFrame]) -> list[str]:
    """Which references of a generation point nowhere."""
    links = [("messages", "conversation_id", "conversations"), ("blocks", "message_id", "messages"), ("retrieval_chunks", "block_id", "blocks")]
    return [f"{c}.{k}" for c, k, p in links if c in tables and p in tables and audit.orphans(tables[c], tables[p], k, "id").limit(1).count()]


def append_missing(target: DataFrame | None, batch: DataFrame, key: str) -> DataFrame:
    """The rows of a batch that the target lacks, each key once: appending them twice changes nothing."""
    once = batch.dropDuplicates([key])
    return once if target is None else once.join(target.select(key), key, "left_anti")
