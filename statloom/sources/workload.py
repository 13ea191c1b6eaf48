"""Workloads: range queries, conditional queries, their exact answers; readers and writers of queries."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.rdc import sample_matrix
from statloom.operators.predicates import exact_counts


def range_queries(df: DataFrame, columns: list[str], n: int = 100, seed: int = 17, sample: int = 10_000) -> list[dict[str, tuple[float, float]]]:
    """n boxes over 1 to 3 of the columns each, with ends among observed values of a bounded sample."""
    rng = np.random.default_rng(seed)
    x = sample_matrix(df, columns, sample, seed)
    out = []
    for _ in range(n):
        box = {}
        for i in rng.choice(len(columns), rng.integers(1, min(3, len(columns)) + 1), replace=False):
            a, b = np.sort(rng.choice(x[~np.isnan(x[:, i]), i], 2))
            box[columns[i]] = (float(a), float(b))
        out.append(box)
    return out


def query_frame(spark: SparkSession, boxes: list[dict[str, tuple[float, float]]], columns: list[str]) -> DataFrame:
    """query_id, <c>_lo, <c>_hi; null where a box says nothing."""
    rows = [(i, *(v for c in columns for v in b.get(c, (None, None)))) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, ", ".join(["query_id long", *(f"{c}_lo double, {c}_hi double" for c in columns)]))


def with_truth(df: DataFrame, boxes: list[dict[str, tuple[float, float]]]) -> DataFrame:
    """(query_id, truth), counted on the table."""
    return df.sparkSession.createDataFrame(list(enumerate(exact_counts(df, boxes))), "query_id long, truth long")


def evidence_queries(df: DataFrame, columns: list[str], n_query: int = 3, seed: int = 17, values: int = 50) -> tuple[dict[str, float], list[dict[str, float]], DataFrame]:
    """Evidence from an observed row, all combinations of values of up to n_query other columns, and their exact conditional
    probabilities (query_id, truth) = count(evidence and query) / count(evidence)."""
    rng = np.random.default_rng(seed)
    d = len(columns)
    plain = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    row = plain.orderBy(F.xxhash64(F.lit(seed), *columns), *columns).first()  # the same row however the table is stored
    given = sorted(rng.choice(d, int(rng.integers(2, max(3, d // 2))), replace=False).tolist())
    evidence = {columns[i]: row[columns[i]] for i in given}
    asked = [columns[i] for i in range(d) if i not in given][:n_query]
    axes = [[float(r[0]) for r in df.select(F.col(c).cast("double")).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(values).collect()] for c in asked]
    queries = [dict(zip(asked, v, strict=True)) for v in itertools.product(*axes)]
    return evidence, queries, conditional_truth(df, evidence, queries)


def conditional_truth(df: DataFrame, evidence: dict[str, float], queries: list[dict[str, float]]) -> DataFrame:
    """(query_id, truth): the share of each query's values among the rows of the evidence. All queries have the same columns."""
    asked = list(queries[0])
    cond = F.lit(True)
    for c, v in evidence.items():
        cond = cond & (F.col(c) == v)
    held = df.where(cond).groupBy(*[F.col(c).cast("double").alias(c) for c in asked]).agg(F.count("*").alias("n"))
    total = df.where(cond).count()
    frame = df.sparkSession.createDataFrame([(i, *q.values()) for i, q in enumerate(queries)], ", ".join(["query_id long", *(f"{c} double" for c in asked)]))
    return frame.join(held, asked, "left").select("query_id", (F.coalesce("n", F.lit(0)) / total).alias("truth"))


def read_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Parquet, ORC, JSON lines, or CSV with or without a header line (csv, csv_plain)."""
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind == "csv_plain":
        return spark.read.csv(path, header=False, inferSchema=True)
    return spark.read.format(kind).load(path)


def read_npy_queries(spark: SparkSession, lower: str, upper: str, columns: list[str]) -> DataFrame:
    """Query bounds from two .npy files of shape [queries, columns], read through Spark; infinite ends allowed."""
    import io

    load = lambda p: np.load(io.BytesIO(bytes(spark.read.format("binaryFile").load(p).first()["content"])))
    lo, hi = load(lower), load(upper)
    return query_frame(spark, [{c: (float(a), float(b)) for c, a, b in zip(columns, x, y, strict=True)} for x, y in zip(lo, hi, strict=True)], columns)
