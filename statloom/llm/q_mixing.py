from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import read
from statloom.llm.mixing import mix, quality_weights


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), quality=quality_weights(read(spark, sf_dir, "labels")), keep=["doc_id"])
    return mixed.select(F.col("mx_row.doc_id").alias("doc_id"), F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"), (F.col("mx_size") * F.col("mx_copies")).alias("taken"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(concat('17:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS h
  FROM documents),
q AS (SELECT doc_id, avg(CASE WHEN quality = 1 THEN 2.0 WHEN quality = 0 THEN 0.5 END) AS w FROM labels GROUP BY doc_id),
k AS (
  SELECT d.*, -ln((CAST(CAST('0x' || substr(h, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / coalesce(q.w, 1.0) AS key
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s),
w AS (SELECT *, CAST([3, 1, 2][r % 3 + 1] AS DOUBLE) AS w, source_size * 2.0 AS cap FROM r),
l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w),
f AS (SELECT lev AS free FROM l WHERE cap >= lev * w ORDER BY cap / w, r LIMIT 1),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, coalesce((SELECT free FROM f) * w, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
o AS (
  SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, h) - size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2.0 < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""
