"""Session and shared-storage helpers."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "strataline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine assumes; an active session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # written intermediates go when nothing refers to them
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a temporary one where it is unset and the master is local.

    A session that spans machines without that setting is an error, as no folder of one machine would do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master) and not os.environ.get("STRATALINE_SHARED"):
            raise ValueError("spark.checkpoint.dir isn't set; on a cluster it must name a folder that every executor sees")
        path = os.environ.get("STRATALINE_SHARED") or tempfile.mkdtemp(prefix="strataline-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder, so that neither a lost executor nor a long lineage costs a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the files of shuffles removed that nothing refers to any more, which otherwise waits for the driver's next garbage collection."""
    for _ in range(3):  # the plan goes at first, then what it held; the session lets go of objects with some delay
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
