"""Rebuilding conversations from message rows with keyed streaming state.

Messages stream in by conversation and block of ordinals, so that a conversation of any length is
spread over many blocks; a state holds the blocks of one hash bucket, which saves the cost of a
state for each short conversation.  It buffers a block's messages, each id once, however late or
out of order they come within the watermark; when the watermark passes the block's last event by
the idle time, the block is closed: its turns and a summary with a verdict are emitted and its rows
are dropped, so the state holds what is open and no more.  A block that goes on after it was closed
is emitted again, and its parts are put together afterwards.  Block summaries are then joined in
order, and only conversations that can be read as such remain.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import parallelism, shared_dir, ship

BLOCK = 2_048  # ordinals of one conversation that share a state
_EDGE = r"[\s\p{Z}\u200B-\u200D\u2060\uFEFF]"
ROLES = {"user": "user human", "assistant": "assistant ai bot model", "system": "system", "tool": "tool"}  # fixed values
BUCKET_BYTES = 256_000  # bytes of the archive's files for each hash bucket
SLICE_BYTES, LEAST_SLICES = 8 << 30, 4  # bytes of the archive's files that are streamed at once, and fewest slices
IDLE_MS = 7 * 86_400_000  # a block is closed so long after its last event
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
STATE = T.StructType([T.StructField("blocks", T.ArrayType(T.StringType()))])
OUT = (
    "conversation_id string, block long, kind string, ordinal long, id string, role string, text string, n long, lo long, hi long, broken boolean, unreadable boolean, "
    "filled long, users long, skipped boolean, first string, last string, readable boolean, seen long, rows string, closed_at timestamp"
)
_COLS = [c.split()[0] for c in OUT.split(", ")]


def blank(c: Column) -> Column:
    """Null, empty, or only white space, non-breaking or zero-width spaces."""
    return c.isNull() | c.rlike(f"^{_EDGE}*$")


def role_of(c: Column) -> Column:
    """user, assistant, system or tool of a role in any usual spelling; null if unreadable."""
    x = F.lower(F.regexp_replace(c, f"^{_EDGE}+|{_EDGE}+$", ""))
    table = F.create_map(*[F.lit(v) for role, words in ROLES.items() for w in words.split() for v in (w, role)])
    return F.element_at(table, x)


def moment(c: Column) -> Column:
    """A time in ISO notation (with or without zone) or in seconds or milliseconds since 1970; else null."""
    n = c.try_cast("double")
    n = F.when(n.between(1e8, 1e14), n)
    return F.coalesce(F.when(n > 1e11, F.timestamp_millis(n.cast("long"))).when(n > 1e8, F.timestamp_seconds(n)), c.try_cast("timestamp"))


def prepare(messages: DataFrame, with_text: bool, buckets: int = 256) -> DataFrame:
    """Rows as the state machine takes them; rows without a conversation are dropped.

    A time that is missing or outside 1970 to 2099 says nothing about when the row belongs: event_time is null.
    """
    text = F.col("raw_text") if with_text else F.lit(None).cast("string")
    rows = messages.where("conversation_id is not null").select(
        "conversation_id",
        F.coalesce(F.floor((F.col("ordinal") - 1) / BLOCK), F.lit(-1)).cast("long").alias("block"),
        F.coalesce("id", F.lit("")).alias("id"),
        F.col("ordinal").cast("long").alias("ordinal"),
        role_of(F.col("role")).alias("role"),
        blank(F.col("raw_text")).alias("blank"),
        text.alias("text"),
        F.when(moment(F.col("time_utc")).between("1970-01-02", "2099-01-01"), moment(F.col("time_utc"))).alias("event_time"),
    )
    return rows.withColumn("bucket", F.pmod(F.xxhash64("conversation_id", "block"), F.lit(buckets)).cast("int"))


def timed(rows: DataFrame) -> DataFrame:
    """rows with a time each: one that has none takes the last of its conversation, or 1970.  Only such rows are shuffled for it."""
    known = rows.where("event_time is not null").groupBy("conversation_id").agg(F.max("event_time").alias("_t"))
    bare = rows.where("event_time is null").join(known, "conversation_id", "left")
    bare = bare.withColumn("event_time", F.coalesce("_t", F.timestamp_seconds(F.lit(86_400)))).select(*rows.columns)
    return rows.where("event_time is not null").unionByName(bare)


def summary(rows: dict[int, list], broken: bool) -> dict:
    """What a block's messages {ordinal: [id, role, blank, ...]} say about their conversation.

    readable: they are by themselves a whole conversation that can be read.
    """
    first = last = None
    users = filled = 0
    skipped = False
    for o in sorted(rows):
        _, role, empty = rows[o][:3]
        if empty:
            continue
        filled += 1
        if role in ("user", "assistant"):
            if role == "user":
                users += 1
                skipped |= last == "user"
            first, last = first or role, role
    n, lo, hi = len(rows), min(rows, default=None), max(rows, default=None)
    odd = any(not r[1] for r in rows.values())
    fine = not (broken or odd or skipped) and lo == 1 and hi == n and users > 0 and last != "user"
    return {"n": n, "lo": lo, "hi": hi, "broken": broken, "unreadable": odd, "filled": filled, "users": users, "skipped": skipped, "first": first, "last": last, "readable": fine}


def _table(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({c: [r.get(c) for r in rows] for c in _COLS})


def _take(block: dict, o: int, row: list) -> None:
    """Put a message into a block.  Of rows of one ordinal the smallest stays, in whatever order they
    come; an ordinal held by two messages breaks the conversation."""
    old = block["r"].setdefault(o, row)
    block["x"] |= old[0] != row[0]
    if row < old:
        block["r"][o] = row


def machine(idle_ms: int, with_text: bool):
    """The state function of one bucket of (conversation, block)."""

    def close(blocks: dict, due: list, mark: int) -> pd.DataFrame:
        out = []
        for key in due:
            b = blocks.pop(key)
            where = {"conversation_id": key[0], "block": key[1], "closed_at": pd.Timestamp(mark, unit="ms")}
            out.append(where | {"kind": "block", "seen": b["s"], "rows": json.dumps([[o, *r[:3]] for o, r in b["r"].items()])} | summary(b["r"], b["x"]))
            if with_text:
                out += [where | {"kind": "turn", "ordinal": o, "id": r[0], "role": r[1] or None, "text": r[3]} for o, r in b["r"].items() if not r[2]]
        return _table(out)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blocks: dict[tuple[str, int], dict] = {}
        for text in state.get[0] if state.exists else ():
            conv, block, b = json.loads(text)
            b["r"] = {int(o): r for o, r in b["r"].items()}
            blocks[conv, block] = b
        for p in batches:
            times = p["event_time"].astype("datetime64[ms]").astype("int64").tolist()
            for conv, block, o, i, role, empty, text, t in zip(p["conversation_id"], p["block"].tolist(), p["ordinal"].tolist(), p["id"], p["role"], p["blank"].tolist(), p["text"], times):
                b = blocks.setdefault((conv, block), {"t": 0, "x": False, "s": 0, "r": {}})
                b["t"] = max(b["t"], t)
                b["s"] += 1
                if o is None or o != o:
                    b["x"] = True
                else:
                    _take(b, int(o), [i, role or "", bool(empty), text or ""])
        mark = state.getCurrentWatermarkMs()
        due = [k for k, b in blocks.items() if state.hasTimedOut and b["t"] + idle_ms <= mark]
        if due:
            yield close(blocks, due, mark)
        if not blocks:
            state.remove()
            return
        state.update(([json.dumps([conv, block, b]) for (conv, block), b in blocks.items()],))
        state.setTimeoutTimestamp(max(min(b["t"] for b in blocks.values()) + idle_ms, mark + 1))

    return step


def stream(messages: DataFrame, delay: str = "1 hour", idle_ms: int = IDLE_MS, with_text: bool = True) -> DataFrame:
    """Closed blocks of a stream of message rows (prepared, with times): one row of kind block, and the turns that aren't blank.

    delay is how late a row may come by event time; a block is closed idle_ms after its last event.
    """
    ship(messages.sparkSession)
    return messages.withWatermark("event_time", delay).groupBy("bucket").applyInPandasWithState(machine(idle_ms, with_text), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay(spark: SparkSession, path: str, with_text: bool = True, slices: int | None = None, delay: str = "1 hour", idle_ms: int = IDLE_MS, progress: list | None = None) -> DataFrame:
    """The closed blocks of a whole archive of message rows at path.

    The archive is cut into slices by event time and streamed slice by slice, so that the watermark
    moves on and conversations are closed while later ones still come; the state (in RocksDB) holds
    those that are open.  A last control row, far in the future, closes what is left.  Nothing is
    lost: the rows that the blocks took are counted against the archive's.  Slices, state, progress
    and results lie in the shared folder; a lost executor only repeats its tasks.  progress, if
    given, gets what Spark reports of each batch.
    """
    own = f"{shared_dir(spark)}/conversations-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(sc._jsc.hadoopConfiguration())
    size = fs.getContentSummary(hadoop(path)).getLength()
    buckets = max(parallelism(spark), size // BUCKET_BYTES)
    slices = slices or max(LEAST_SLICES, size // SLICE_BYTES)
    rows = timed(prepare(spark.read.parquet(path), with_text, buckets))
    rows.repartitionByRange(slices, "event_time", "conversation_id").write.parquet(f"{own}/slices")
    end = rows.limit(0).unionByName(spark.createDataFrame([("", -2, "", True, -1)], "conversation_id string, block long, id string, blank boolean, bucket int").withColumn("event_time", F.lit("2200-06-01").cast("timestamp")), allowMissingColumns=True)
    end.coalesce(1).write.parquet(f"{own}/end")
    fs = hadoop(own).getFileSystem(sc._jsc.hadoopConfiguration())
    files = lambda d: sorted(f.getPath().toString() for f in fs.listStatus(hadoop(f"{own}/{d}")) if f.getPath().getName().endswith(".parquet"))
    for f in files("end"):
        fs.rename(hadoop(f), hadoop(f"{own}/slices/{hadoop(f).getName().replace('part-', 'part-z')}"))
    for k, f in enumerate(files("slices")):  # files are streamed in the order of their times
        fs.setTimes(hadoop(f), 1_600_000_000_000 + 1_000 * k, -1)
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{own}/slices")
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    try:
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        q = stream(src, delay, idle_ms, with_text).writeStream.format("parquet").option("path", f"{own}/out").option("checkpointLocation", f"{own}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if progress is not None:
        progress += q.recentProgress
    out = spark.read.schema(OUT).parquet(f"{own}/out").where("block <> -2")
    taken = out.where("kind = 'block'").agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    if (there := spark.read.schema(rows.schema).parquet(f"{own}/slices").where("block <> -2").count()) != taken:
        raise RuntimeError(f"{there - taken} of {there} rows came later than the watermark: files weren't streamed in the order of their times")
    return out


def blocks(closed: DataFrame) -> DataFrame:
    """One row for each block of closed ones; the parts of a block that was closed more than once are put together."""
    ship(closed.sparkSession)
    b = closed.where("kind = 'block'").repartition("conversation_id")
    b = b.withColumn("_parts", F.count("*").over(Window.partitionBy("conversation_id", "block")))

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        block = {"x": bool(p["broken"].any()), "r": {}}
        for text in p["rows"]:
            for o, *row in json.loads(text):
                _take(block, o, row)
        return _table([{"conversation_id": p["conversation_id"].iloc[0], "block": p["block"].iloc[0], "kind": "block", "seen": p["seen"].sum()} | summary(block["r"], block["x"])])

    again = b.where("_parts > 1").drop("_parts").groupBy("conversation_id", "block").applyInPandas(whole, OUT)
    return b.where("_parts = 1").drop("_parts").unionByName(again)


def verdicts(closed: DataFrame) -> DataFrame:
    """(conversation_id, readable, messages): whether each conversation of closed blocks can be read.

    That of a conversation of one block is the state's own.  It can be read if its ordinals are exactly 1..n, each once, every role is readable, some message and
    some user message is not blank, and every such user message is answered before the next.
    """
    b = blocks(closed)
    w = Window.partitionBy("conversation_id").orderBy("block")
    b = b.withColumn("open", F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    b = b.withColumn("end", F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    b = b.withColumn("gap", (F.col("open") == "user") & (F.col("first") == "user"))
    g = b.groupBy("conversation_id").agg(
        F.count("*").alias("blocks"), F.max("readable").alias("readable"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("filled").alias("filled"), F.sum("users").alias("users"),
        F.max(F.col("broken") | F.col("unreadable") | F.col("skipped") | F.coalesce("gap", F.lit(False)) | F.coalesce(F.col("end") == "user", F.lit(False))).alias("bad"),
    )
    ok = ~F.col("bad") & F.coalesce(F.col("lo") == 1, F.lit(False)) & F.coalesce(F.col("hi") == F.col("n"), F.lit(False)) & (F.col("filled") > 0) & (F.col("users") > 0)
    return g.select("conversation_id", F.when(F.col("blocks") == 1, F.col("readable")).otherwise(ok).alias("readable"), F.col("n").alias("messages"))


def rebuilt(closed: DataFrame) -> DataFrame:
    """(conversation_id, turn, ordinal, role, text): the turns of the readable conversations, blank messages left out."""
    good = verdicts(closed).where("readable").select("conversation_id")
    turns = closed.where("kind = 'turn' and role in ('user', 'assistant')").join(good, "conversation_id", "left_semi")
    w = Window.partitionBy("conversation_id").orderBy("ordinal", "id", "role", "text")
    once = turns.withColumn("_before", F.lag("ordinal").over(w)).where("_before is null or _before <> ordinal")  # a row that came again after its block was closed
    return once.select("conversation_id", F.row_number().over(w).alias("turn"), "ordinal", "role", "text")


def unreadable(conversations: DataFrame, closed: DataFrame, key: str = "id") -> DataFrame:
    """(conversation_id): the conversations that can't be read, also those without a message row."""
    good = verdicts(closed).where("readable").select(F.col("conversation_id").alias(key))
    return conversations.select(key).where(F.col(key).isNotNull()).distinct().join(good, key, "left_anti").select(F.col(key).alias("conversation_id"))
