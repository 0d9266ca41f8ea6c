"""Settings of the running session that operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def durable(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them back, so that lost executors cost nothing.

    The folder is the session's spark.checkpoint.dir. Where it is unset, a temporary one is made if the session runs on
    this machine only; on a cluster, where executors could not share it, that is an error.
    """
    spark: SparkSession = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)
