"""Lineage cuts in the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


#: Spark's setting by which the shuffle files of a finished execution go at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the cluster's spark.checkpoint.dir (a local folder where none is set); its shuffle files are deleted."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named if named is not None else tempfile.mkdtemp(prefix="statloom-"))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new plan, which heeds the setting
    finally:
        spark.conf.set(_CLEANUP, before)
