"""Predicates over leaves: each takes a table of bins (or exact values) and a table of queries, one row per query.

Query batches and bins are joined by range. The side that is small by count is sent to all tasks; if neither is, the queries are
sent in runs of bounded size, so that no plan pairs two large sides by shuffling them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a side that a join may send to every task.
MOST = 100_000


def _meet(queries: DataFrame, bins: DataFrame, on: Column, most: int = MOST) -> DataFrame:
    """queries.join(bins, on) for a condition that isn't an equality."""
    if queries.limit(most + 1).count() <= most:
        return bins.join(F.broadcast(queries), on)
    if bins.limit(most + 1).count() <= most:
        return queries.join(F.broadcast(bins), on)
    runs = -(-2 * queries.count() // most)  # of about half the bound, by a hash of the query
    run = F.pmod(F.xxhash64("query_id"), F.lit(runs))
    return reduce(DataFrame.unionByName, [bins.join(F.broadcast(queries.where(run == i)), on) for i in range(runs)])


def _complete(queries: DataFrame, found: DataFrame, column: str, missing: float = 0.0) -> DataFrame:
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce(column, F.lit(missing)).alias(column))


def point_probability(bins: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query_id, x) -> p of the bin that holds x, times the non-null share; a null x is marginalised to 1."""
    hit = _meet(queries, bins, (F.col("x") > F.col("lo")) & (F.col("x") <= F.col("hi"))).select("query_id", (F.col("pdf") * F.col("non_null")).alias("p"))
    none = queries.where("x is null").select("query_id", F.lit(1.0).alias("p"))
    return _complete(queries, hit.union(none), "p")


def range_probability(bins: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query_id, lo, hi), closed, infinite ends allowed -> p: the mass of all bins that the range meets."""
    q = queries.select("query_id", F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
    hit = _meet(q, bins, (F.col("qhi") > F.col("lo")) & (F.col("qlo") <= F.col("hi")) & (F.col("qlo") <= F.col("qhi")))
    return _complete(queries, hit.groupBy("query_id").agg(F.least(F.sum(F.col("pdf") * F.col("non_null")), F.lit(1.0)).alias("p")), "p")


def interval_probability(leaf: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact-value leaf; queries (query_id, intervals array<struct<lo,hi,lo_inc,hi_inc>>), a union of disjoint intervals -> p."""
    q = queries.select("query_id", F.explode("intervals").alias("i"))
    low = (F.col("v") > F.col("i.lo")) | ((F.col("v") == F.col("i.lo")) & F.col("i.lo_inc"))
    high = (F.col("v") < F.col("i.hi")) | ((F.col("v") == F.col("i.hi")) & F.col("i.hi_inc"))
    hit = _meet(q, leaf, low & high).groupBy("query_id").agg(F.sum("p").alias("p"))
    return _complete(queries, hit, "p")


def in_list_probability(leaf: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact-value leaf; queries (query_id, values array<double>) -> p and log_p of v IN (values), repeats counted once."""
    q = queries.select("query_id", F.explode(F.array_distinct("values")).alias("v"))
    hit = q.join(leaf, "v").groupBy("query_id").agg(F.sum("p").alias("p"))
    return _complete(queries, hit, "p").withColumn("log_p", F.when(F.col("p") > 0, F.log("p")))


def not_null_probability(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.count(column) / F.count("*")).alias("p"))


def range_expectation(leaf: DataFrame, queries: DataFrame, power: int = 1) -> DataFrame:
    """E[v^power * 1(lo <= v <= hi)] over all rows; power may be negative, then v = 0 is left out."""
    q = queries.select("query_id", F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
    hit = _meet(q, leaf, F.col("v").between(F.col("qlo"), F.col("qhi")) & ((F.col("v") != 0) | F.lit(power > 0)))
    return _complete(queries, hit.groupBy("query_id").agg(F.sum(F.col("p") * F.pow("v", F.lit(power))).alias("e")), "e")


def distinct_in_range(leaf: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, v) for each distinct value with positive mass in the range."""
    q = queries.select("query_id", F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
    return _meet(q, leaf.where("p > 0"), F.col("v").between(F.col("qlo"), F.col("qhi"))).select("query_id", "v")


def box_probability(cells: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """n-d cells; queries (query_id, <c>_lo, <c>_hi for each column) -> p: the mass of cells inside the box."""
    inside = F.lit(True)
    for c in columns:
        inside = inside & F.col(c).between(F.col(f"{c}_lo"), F.col(f"{c}_hi"))
    hit = _meet(queries, cells, inside).groupBy("query_id").agg(F.sum("pdf").alias("p"))
    return _complete(queries, hit, "p")


def box_probability_by_corners(cumulated: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """The same from n-d prefix sums, as the signed sum over the 2**d corners of the box."""
    q = queries
    corners = None
    for mask in range(1 << len(columns)):
        sign, at = 1, F.lit(True)
        for k, c in enumerate(columns):
            low = mask >> k & 1
            sign *= -1 if low else 1
            at = at & (F.col(c) < F.col(f"{c}_lo") if low else F.col(c) <= F.col(f"{c}_hi"))
        part = _meet(q, cumulated, at).groupBy("query_id").agg((F.max("cdf") * sign).alias("s"))  # prefix sums grow along every axis
        corners = part if corners is None else corners.union(part)
    return _complete(queries, corners.groupBy("query_id").agg(F.sum("s").alias("p")), "p")


def piecewise_range_probability(segments: DataFrame, queries: DataFrame) -> DataFrame:
    """Area under a piecewise-linear density between lo and hi."""
    q = queries.select("query_id", F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
    a, b = F.greatest("qlo", "x0"), F.least("qhi", "x1")
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    at = lambda x: F.col("y0") + slope * (x - F.col("x0"))
    hit = _meet(q, segments, (F.col("qhi") > F.col("x0")) & (F.col("qlo") < F.col("x1"))).groupBy("query_id").agg(F.sum((b - a) * (at(a) + at(b)) / 2).alias("p"))
    return _complete(queries, hit, "p")


def piecewise_density(segments: DataFrame, queries: DataFrame) -> DataFrame:
    """Density at x by linear interpolation; 0 outside."""
    y = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    hit = _meet(queries, segments, (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))).select("query_id", y.alias("y"))
    return _complete(queries, hit, "y")


def exact_counts(df: DataFrame, boxes: list[dict[str, tuple[float, float]]], at_once: int = 200) -> list[int]:
    """True cardinality of closed boxes (column -> (lo, hi)), one aggregation for each at_once boxes."""
    out: list[int] = []
    for i in range(0, len(boxes), at_once):
        sums = []
        for k, box in enumerate(boxes[i : i + at_once]):
            inside = F.lit(True)
            for c, (lo, hi) in box.items():
                inside = inside & F.col(c).between(float(lo), float(hi))
            sums.append(F.coalesce(F.sum(inside.cast("long")), F.lit(0)).alias(f"c{k}"))
        out += [int(x) for x in df.agg(*sums).first()]
    return out
