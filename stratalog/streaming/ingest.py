"""Incremental import: new message files are diffed against what is there and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import content_hash


def revisions(messages: DataFrame) -> DataFrame:
    """messages with revision: a hash of what each says."""
    return messages.withColumn("revision", content_hash("message", F.col("id"), F.lower(F.trim("role")), F.coalesce("raw_text", F.lit(""))))


def ingest(spark: SparkSession, landing: str, store: str, progress: str, schema: str) -> StreamingQuery:
    """Stream message files from a landing folder into a Parquet store, each revision of a message once.

    Every micro-batch appends only the (id, revision) pairs that the store lacks, into a folder named
    by the batch, so that a batch that is run again after a failure overwrites itself.
    """
    src = revisions(spark.readStream.schema(schema).parquet(landing))

    def append(batch: DataFrame, n: int) -> None:
        new = batch.dropDuplicates(["id", "revision"])
        own = batch.sparkSession
        path = own.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(own.sparkContext._jsc.hadoopConfiguration()).exists(path):
            # only the two columns of the stored rows are read, and only of the ids that came
            ids = new.select("id").distinct()
            old = own.read.schema(f"{new.select('id', 'revision').schema.simpleString()[7:-1].replace(':', ' ')}, batch long").parquet(store).where(F.col("batch") != n).select("id", "revision")
            new = new.join(old.join(ids, "id", "left_semi"), ["id", "revision"], "left_anti")
        new.write.mode("overwrite").parquet(f"{store}/batch={n}")

    return src.writeStream.foreachBatch(append).option("checkpointLocation", progress).trigger(availableNow=True).start()
