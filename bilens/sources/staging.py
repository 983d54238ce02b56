"""Tables kept between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a new local folder where it is unset and Spark runs locally."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = named or "file://" + tempfile.mkdtemp(prefix="bilens-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named or current


def pinned(df: DataFrame) -> DataFrame:
    """``df`` computed once, so that everything built on it sees the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
