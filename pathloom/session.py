"""Session builder and the few cluster settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings updates "
    "window_features labelled_windows split_targets edges snapshots_index mix_targets"
).split()


def build_session(master: str | None = None, app: str = "pathloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` overrides any default."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a directory. Columns are pruned and filters pushed down by the parquet scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of reliable checkpoints: the cluster's own setting where there is one.

    Only where neither the setting nor a directory exists (as in tests on one machine) a temporary
    folder is made.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="pathloom-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from a reliable checkpoint: lineage is cut, lost executors do no harm."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
