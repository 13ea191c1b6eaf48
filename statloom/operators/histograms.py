"""Leaves: histograms and other summaries of one or several columns, as DataFrames of bins.

1-d bins: (lo, hi, n, pdf, cdf). A value v of a bin satisfies lo < v <= hi. Ends of discrete bins are midpoints between
neighbouring values, PAD beyond the first and last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.prefix import running_sum, value_counts
from statloom.sources.shared import cut

#: Fixed value: how far the outermost bins reach beyond the data.
PAD = 0.1
#: Corners that a completed grid may have.
GRID = 50_000_000


def histogram(df: DataFrame, column: str, alpha: float = 1.0) -> DataFrame:
    """One bin per distinct value, smoothed by alpha: (lo, hi, v, n, pdf, cdf, non_null).

    Values are range-partitioned once. A value's neighbours are in its own partition, but for the outermost, whose neighbours
    come with the partitions' totals, one row each.
    """
    spark = df.sparkSession
    counts = value_counts(df, column)
    parts = cut(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "v").withColumn("_part", F.spark_partition_id()))  # its ranges must not be drawn twice
    totals = parts.groupBy("_part").agg(F.sum("n").alias("_s"), F.count("*").alias("_k"), F.min("v").alias("_first"), F.max("v").alias("_last"))
    order = Window.orderBy("_part")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k"),
        F.sum("_s").over(whole).alias("_n"), F.sum("_k").over(whole).alias("_bins"), F.lag("_last").over(order).alias("_last"), F.lead("_first").over(order).alias("_first"),
    )
    own = Window.partitionBy("_part").orderBy("v")
    near = parts.select("*", F.lag("v").over(own).alias("_pv"), F.lead("v").over(own).alias("_nv"), F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"), F.row_number().over(own).alias("_r"))
    bins = near.join(F.broadcast(totals), "_part").crossJoin(F.broadcast(df.agg(F.count("*").alias("_all"))))  # a row for each partition, and one row
    pv, nv, v, alpha = F.coalesce("_pv", "_last"), F.coalesce("_nv", "_first"), F.col("v"), F.lit(alpha)
    lo, hi = F.coalesce(pv + (v - pv) / 2, v - PAD), F.coalesce(v + (nv - v) / 2, v + PAD)
    total = F.col("_n") + F.col("_bins") * alpha
    return bins.select(lo.alias("lo"), hi.alias("hi"), "v", "n", ((F.col("n") + alpha) / total).alias("pdf"), ((F.col("_s") + F.col("_c") + (F.col("_k") + F.col("_r")) * alpha) / total).alias("cdf"), (F.col("_n") / F.col("_all")).alias("non_null"))


def width_bins(df: DataFrame, column: str, bins: int | None = None, alpha: float = 0.0) -> DataFrame:
    """Equal-width bins of a real column; their number by the Freedman-Diaconis rule if not given: (bin, lo, hi, n, pdf)."""
    v = F.col(column).cast("double")
    vals = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    s = vals.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n"))
    if not bins:
        from statloom.operators.rows import quantiles

        q = quantiles(vals, "v", [0.25, 0.75])
        width = 2 * F.lit(float(q[1][1] - q[1][0]) if q else 0.0) / F.pow("n", F.lit(1 / 3))
    number = F.lit(bins) if bins else F.when((width > 0) & (F.col("b") > F.col("a")), F.ceil((F.col("b") - F.col("a")) / width)).otherwise(1)
    s = s.select("a", "b", "n", F.greatest(number, F.lit(1)).cast("int").alias("k"))
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * F.col("k")), F.col("k") - 1)).otherwise(0).cast("int")
    counted = vals.crossJoin(F.broadcast(s)).select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("c"))  # s is one row
    grid = s.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    step = (F.col("b") - F.col("a")) / F.col("k")
    c = F.coalesce("c", F.lit(0))
    return grid.join(counted, "bin", "left").select("bin", (F.col("a") + F.col("bin") * step).alias("lo"), (F.col("a") + (F.col("bin") + 1) * step).alias("hi"), c.alias("n"), ((c + alpha) / (F.col("n") + alpha * F.col("k"))).alias("pdf"))


def densities(bins: DataFrame) -> DataFrame:
    """(lo, hi, v, density): each bin's mass by its width, and the value that stands for it."""
    return bins.select("lo", "hi", "v", (F.col("pdf") / (F.col("hi") - F.col("lo"))).alias("density"))


def conditional_histogram(df: DataFrame, column: str, condition: str, cuts: list[float], alpha: float = 1.0) -> DataFrame:
    """Conditional leaf: (part, v, n, pdf), the smoothed distribution of column within each range of condition; part i ends with cuts[i]."""
    part = sum(((F.col(condition) > c).cast("int") for c in cuts), F.lit(0))
    n = df.where(F.col(column).isNotNull() & F.col(condition).isNotNull()).groupBy(part.alias("part"), F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = n.groupBy("part").agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))  # one row for each range
    return n.join(F.broadcast(total), "part").select("part", "v", "n", ((F.col("n") + alpha) / (F.col("_n") + alpha * F.col("_k"))).alias("pdf"))


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sparse n-d histogram of rows without nulls: the columns as doubles, n, pdf."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    counts = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(*columns, "n", (F.col("n") / F.col("_t")).alias("pdf"))  # total is one row


def cumulated_cells(cells_df: DataFrame, columns: list[str]) -> DataFrame:
    """Inclusive n-d prefix sums over the cells that there are, completed to the grid of the observed values.

    The grid of all corners is the result's size; it may have GRID corners at most. Each axis is sent to all tasks as one array."""
    axes = cells_df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])
    size = cells_df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    if math.prod(size) > GRID:
        raise ValueError(f"the grid has more than {GRID} corners")
    grid = axes.select(*columns)
    for c in columns:
        grid = grid.withColumn(c, F.explode(c))
    out = grid.join(cells_df.select(*columns, "pdf"), columns, "left").withColumn("cdf", F.coalesce("pdf", F.lit(0.0)))
    for c in columns:
        rest = [x for x in columns if x != c]
        out = out.withColumn("cdf", F.sum("cdf").over(Window.partitionBy(*rest).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(*columns, "cdf")


def common_and_depth_bins(df: DataFrame, column: str, n_common: int, n_bins: int) -> DataFrame:
    """The n_common most frequent values each alone, the rest in bins of about equal counts: (kind, bin, lo, hi, n)."""
    counts = value_counts(df, column)
    common = counts.orderBy(F.desc("n"), "v").limit(n_common)
    rest = running_sum(counts.join(common.select("v"), "v", "left_anti"), "v", F.col("n"), "c")
    number = F.least(F.floor((F.col("c") - F.col("n")) * n_bins / F.col("c_total")), F.lit(n_bins - 1)).cast("int")
    deep = rest.withColumn("bin", number).groupBy("bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n"))
    single = common.withColumn("bin", (F.row_number().over(Window.orderBy(F.desc("n"), "v")) - 1).cast("int"))  # n_common rows
    return single.select(F.lit("common").alias("kind"), "bin", F.col("v").alias("lo"), F.col("v").alias("hi"), "n").union(deep.select(F.lit("depth"), "bin", "lo", "hi", "n"))


def piecewise(bins: DataFrame, pad: float = 1e-8, uniform: float = 0.1) -> DataFrame:
    """A piecewise-linear density through the middles of bins (lo, hi, n): segments (x0, x1, y0, y1) of area 1.

    The ends fall to 0 pad beyond the outermost middles; a share `uniform` of the mass is spread evenly over the range.
    """
    mid = bins.where("n > 0").select(((F.col("lo") + F.col("hi")) / 2).alias("x"), (F.col("n") / (F.col("hi") - F.col("lo"))).alias("y"))
    ends = mid.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    points = mid.union(ends.select(F.col("a") - pad, F.lit(0.0))).union(ends.select(F.col("b") + pad, F.lit(0.0)))
    ranked = running_sum(points, "x", F.lit(1), "r").select("r", "x", "y")
    seg = ranked.alias("p").join(ranked.alias("q"), F.col("q.r") == F.col("p.r") + 1).select(F.col("p.x").alias("x0"), F.col("q.x").alias("x1"), F.col("p.y").alias("y0"), F.col("q.y").alias("y1"))
    area = seg.agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y0") + F.col("y1")) / 2).alias("_area"), (F.max("x1") - F.min("x0")).alias("_range"))
    scaled = lambda y: (1 - uniform) * F.col(y) / F.col("_area") + uniform / F.col("_range")
    return seg.crossJoin(F.broadcast(area)).select("x0", "x1", scaled("y0").alias("y0"), scaled("y1").alias("y1"))  # one row


def exact_leaf(df: DataFrame, column: str) -> DataFrame:
    """Exact-value leaf: (v, p, cum), p among all rows, nulls included in the total."""
    counts = running_sum(value_counts(df, column), "v", F.col("n"), "c")
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select("v", (F.col("n") / F.col("_all")).alias("p"), (F.col("c") / F.col("_all")).alias("cum"))


def exact_stats(df: DataFrame, column: str) -> DataFrame:
    """(p_null, mean, inv_mean, sq_mean, inv_sq_mean) of the non-null values; inverses are null if 0 occurs."""
    v = F.col(column).cast("double")
    safe = F.when(F.max((v == 0).cast("int")) == 0, F.lit(1))
    return df.agg((1 - F.count(v) / F.count("*")).alias("p_null"), F.avg(v).alias("mean"), (safe * F.avg(F.when(v != 0, 1 / v))).alias("inv_mean"), F.avg(v * v).alias("sq_mean"), (safe * F.avg(F.when(v != 0, 1 / (v * v)))).alias("inv_sq_mean"))


def joint_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """The joint distribution of binary columns: one row for each of the 2**d combinations."""
    seen = cells(df, columns)
    if 2 ** len(columns) > GRID:
        raise ValueError(f"the grid has more than {GRID} corners")
    grid = df.sparkSession.range(2 ** len(columns))  # one row for each combination, which is the result's size
    grid = grid.select(*[F.shiftright("id", i).bitwiseAND(F.lit(1)).cast("double").alias(c) for i, c in enumerate(columns)])
    return grid.join(seen, columns, "left").select(*columns, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("pdf", F.lit(0.0)).alias("pdf"))


def moment_of_bins(pdf: Column, lo: Column, hi: Column, k: int) -> Column:
    """E[x^k] of bins of uniform density."""
    return F.sum(pdf * (F.pow(hi, F.lit(k + 1)) - F.pow(lo, F.lit(k + 1))) / ((k + 1) * (hi - lo)))
