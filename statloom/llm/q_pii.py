from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import read
from statloom.llm.pii import KINDS, extract


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_found"), (F.size("base") + F.size("found")).cast("long").alias("n_spans"))
