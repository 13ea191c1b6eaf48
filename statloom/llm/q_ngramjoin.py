from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import read
from statloom.llm.ngramjoin import joined


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of documents at a 5-word Jaccard similarity of 0.8 or more, and its component."""
    found = joined(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_links", F.col("component").alias("component_id"), F.col("first").alias("kept"))


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [array_to_string(w, ' ')] END AS s
  FROM w WHERE len(w) > 0),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, min(a.n) AS na, min(b.n) AS nb
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE i >= 0.8 * (na + nb - i)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.root AS component_id, c.root = d.doc_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.a JOIN c ON d.doc_id = c.node
"""
