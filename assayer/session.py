"""The settings the engine expects of a session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that a query's result or its plan at scale depends on; memory and partition counts belong to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "assayer", **conf: str) -> SparkSession:
    """A session with DEFAULTS; ``conf`` overrides them (keys with dots go in as ``**{"spark.x.y": "1"}``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions and order, written to the checkpoint folder: computed once, and safe from lost executors.

    Where no folder is set, a local master gets a temporary one, and a cluster an error, as its executors couldn't see it.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="assayer-"))
    return df.checkpoint()
