"""Columns made ready for clustering and for leaves: count transforms, one-hot columns, reduced axes, kernel densities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.families import fit_multivariate


def count_columns(df: DataFrame, columns: list[str], how: str) -> DataFrame:
    """df with columns of counts replaced: `log1p`, `sqrt`, or `tfidf`.

    tfidf: a row's share of a column among the row's counts, times ln((1 + rows) / (1 + rows that have it)) + 1, each row of length 1.
    """
    if how in ("log1p", "sqrt"):
        f = F.log1p if how == "log1p" else F.sqrt
        return df.withColumns({c: f(F.col(c).cast("double")) for c in columns})
    if how != "tfidf":
        raise ValueError(how)
    got = df.agg(F.count("*").alias("n"), *[F.count(F.when(F.col(c) > 0, 1)).alias(f"_{c}") for c in columns]).first()
    whole = sum((F.col(c) for c in columns), F.lit(0.0))
    raw = {c: F.when(whole > 0, F.col(c) / whole).otherwise(0.0) * (math.log((1 + got["n"]) / (1 + got[f"_{c}"])) + 1) for c in columns}
    length = F.sqrt(sum((v * v for v in raw.values()), F.lit(0.0)))
    return df.withColumns({c: F.when(length > 0, v / length).otherwise(0.0) for c, v in raw.items()})


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """df with a 0/1 column `column=value` for each of values instead of column."""
    return df.select(*[c for c in df.columns if c != column], *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}={v}") for v in values])


def reduced_axes(df: DataFrame, columns: list[str], share: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Means, and the fewest principal axes (as columns) that hold `share` of the variance; from one aggregation."""
    d, mean = len(columns), np.zeros(len(columns))
    cov = np.zeros((d, d))
    for r in fit_multivariate(df, columns).collect():  # a row for each pair of columns
        i, j = columns.index(r.i), columns.index(r.j)
        mean[i], mean[j] = r.mean_i, r.mean_j
        cov[i, j] = cov[j, i] = r["cov"]
    values, axes = np.linalg.eigh(cov)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    kept = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share - 1e-12)) + 1
    axes = axes[:, :kept]
    return mean, axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)


def reduced_cells(df: DataFrame, columns: list[str], share: float = 0.9, bins: int = 20) -> DataFrame:
    """A joint histogram over principal axes: (cell array<int>, n, pdf, and each column's mean in the cell).

    A cell stands for its rows by their mean, so that a box on the columns themselves can be answered: box_of_reduced()."""
    mean, axes = reduced_axes(df, columns, share)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    score = [sum(((F.col(c) - float(m)) * float(axes[i, k]) for i, (c, m) in enumerate(zip(columns, mean, strict=True))), F.lit(0.0)) for k in range(axes.shape[1])]
    made = rows.select(*columns, *[s.alias(f"_{k}") for k, s in enumerate(score)])
    ends = made.agg(*[f(f"_{k}").alias(f"{n}{k}") for k in range(len(score)) for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n")).first()
    at = [F.least(F.floor((F.col(f"_{k}") - ends[f"lo{k}"]) / ((ends[f"hi{k}"] - ends[f"lo{k}"]) or 1.0) * bins), F.lit(bins - 1)).cast("int") for k in range(len(score))] if ends.n else [F.lit(0) for _ in score]
    return made.groupBy(F.array(*at).alias("cell")).agg(F.count("*").alias("n"), (F.count("*") / max(1, ends.n)).alias("pdf"), *[F.avg(c).alias(c) for c in columns])


def box_of_reduced(cells: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """(p): the mass of cells whose mean lies in a closed box."""
    inside = F.lit(True)
    for c, (lo, hi) in box.items():
        inside = inside & F.col(c).between(lo, hi)
    return cells.agg(F.coalesce(F.sum(F.when(inside, F.col("pdf"))), F.lit(0.0)).alias("p"))


def kernel_bins(df: DataFrame, column: str, bins: int = 60, fine: int = 512) -> DataFrame:
    """(bin, lo, hi, n, pdf): equal-width bins with the mass of a Gaussian kernel density, by Silverman's width.

    The density is that of `fine` equal cells counted in one aggregation, so that the driver holds `fine` numbers at most."""
    v = F.col(column).cast("double")
    known = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    s = known.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n"), F.stddev_pop("v").alias("sd")).first()
    spark = df.sparkSession
    schema = "bin int, lo double, hi double, n long, pdf double"
    if not s.n:
        return spark.createDataFrame([], schema)
    if s.a == s.b:
        return spark.createDataFrame([(0, s.a, s.b, s.n, 1.0)], schema)
    step = (s.b - s.a) / fine
    counts = np.zeros(fine)
    for r in known.groupBy(F.least(F.floor((F.col("v") - s.a) / step), F.lit(fine - 1)).cast("int").alias("c")).count().collect():  # at most `fine` rows
        counts[r.c] = r["count"]
    width = 1.06 * s.sd * s.n ** (-1 / 5)
    mid, edges = s.a + (np.arange(fine) + 0.5) * step, np.linspace(s.a, s.b, bins + 1)
    cdf = 0.5 * (1 + np.frompyfunc(math.erf, 1, 1)((edges[:, None] - mid[None]) / (width * math.sqrt(2))).astype(float))
    mass = np.diff(cdf @ counts)
    held = np.diff(np.r_[0.0, np.interp(edges[1:], s.a + np.arange(1, fine + 1) * step, np.cumsum(counts))])
    return spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1]), int(round(held[i])), float(mass[i] / mass.sum())) for i in range(bins)], schema)
