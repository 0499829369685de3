"""Session settings, the shared checkpoint folder, and shipping the package to executors."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "stratalog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for; conf overrides any of them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | conf
    return b.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent and one machine runs everything (tests) a temporary folder takes
    its place; a cluster without the setting is an error, as its executors would share nothing.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc._jsc.sc().getCheckpointDir().isDefined():
            return sc._jsc.sc().getCheckpointDir().get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="stratalog-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from then on (a reliable checkpoint).

    Garbage is collected first on the driver, as the shuffle files of earlier results that nothing
    refers to any more are deleted only then.
    """
    shared_dir(df.sparkSession)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder and read from there: columns that aren't used aren't read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # so that the shuffle files of df are deleted
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give this package's modules to the executors' Python, once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_stratalog_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stratalog-py-"), "stratalog.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.join("stratalog", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._stratalog_shipped = True


def parallelism(spark: SparkSession) -> int:
    """Tasks that run at once or shuffle partitions, whichever is more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
