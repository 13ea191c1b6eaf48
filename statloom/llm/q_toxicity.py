from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import read
from statloom.llm.toxicity import Model, fit, score


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def model_for(spark: SparkSession, sf_dir: str) -> Model:
    """Learned from labelled documents that are not held out."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    return fit(read(spark, sf_dir, "documents"), labels)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(read(spark, sf_dir, "documents"), model_for(spark, sf_dir), keep=["doc_id"], matches=False)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("tx_score").alias("score"), (F.col("tx_score") >= 0.5).cast("int").alias("predicted"))
