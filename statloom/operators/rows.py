"""Row partitioning: operators that split a table into clusters or value ranges. Each adds an int column `part`."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.links import star_edges
from statloom.functions.prefix import running_sum, value_counts
from statloom.sources.shared import cut

#: Clusters, seed, rows of the sample on which a clustering is fitted.
CLUSTERS, SEED, FIT_ROWS = 2, 17, 200_000


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df)


def _bounded(df: DataFrame, rows: int, seed: int) -> DataFrame:
    n = df.count()
    return df if n <= rows else df.sample(False, rows / n, seed)


def kmeans_split(df: DataFrame, columns: list[str], k: int = CLUSTERS, seed: int = SEED, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, list[np.ndarray]]:
    """k-means, fitted on about fit_rows rows, applied to all; and the centres."""
    from pyspark.ml.clustering import KMeans

    v = _vectors(df, columns)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="part").fit(_bounded(v, fit_rows, seed))
    return model.transform(v).drop("_v"), [np.asarray(c) for c in model.clusterCenters()]


def kmeans(x: np.ndarray, k: int = CLUSTERS, seed: int = SEED, rounds: int = 50) -> list[np.ndarray]:
    """Centres of k clusters of the rows of x, a bounded sample; fewer if it has fewer different rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None, :]
    while len(centres) < k:
        far = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        if far.sum() <= 0:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        at = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.stack([x[at == i].mean(axis=0) if (at == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(new, centres, rtol=1e-9, atol=1e-12):
            break
        centres = new
    return list(centres)


def gmm_split(df: DataFrame, columns: list[str], k: int = CLUSTERS, seed: int = SEED, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, list[np.ndarray]]:
    """Gaussian mixture with full covariances; and the means."""
    from pyspark.ml.clustering import GaussianMixture

    v = _vectors(df, columns)
    model = GaussianMixture(k=k, seed=seed, featuresCol="_v", predictionCol="part", probabilityCol="_p").fit(_bounded(v, fit_rows, seed))
    return model.transform(v).drop("_v", "_p"), [np.asarray(g.mean.toArray()) for g in model.gaussians]


def nearest_centre(df: DataFrame, columns: list[str], centres: list[np.ndarray]) -> DataFrame:
    """Assigns each row to its nearest centre, ties to the first; centres that get no row keep their number."""
    far = [F.struct(sum(((F.col(c) - float(x)) ** 2 for c, x in zip(columns, m, strict=True)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(centres)]
    return df.withColumn("part", F.array_min(F.array(*far))["i"])


def grid_split(df: DataFrame, columns: list[str], cuts: int = 2) -> DataFrame:
    """Equal-width grid: each column's range in `cuts` parts; `part` numbers the cells, the first column varying fastest."""
    ends = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    part = F.lit(0)
    for i, c in enumerate(columns):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        at = F.least(F.floor((F.col(c) - lo) / (hi - lo) * cuts), F.lit(cuts - 1)) if lo is not None and lo < hi else F.lit(0)
        part = part + at * cuts**i
    return df.withColumn("part", part.cast("int"))


def rectangles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(part, <c>_lo, <c>_hi, n): the box that bounds each cluster of a split; with it a cluster can be told by ranges of its columns."""
    return df.groupBy("part").agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n"))


def rectangle_split(df: DataFrame, columns: list[str], k: int = CLUSTERS, seed: int = SEED) -> DataFrame:
    """k-means clusters approximated by boxes: a row goes to the first box that holds it, and every row is in its own cluster's."""
    parted, _ = kmeans_split(df, columns, k, seed)
    part = F.lit(None).cast("int")
    for r in sorted(rectangles(parted, columns).collect(), key=lambda r: -r.part):  # k rows
        inside = F.lit(True)
        for c in columns:
            inside = inside & F.col(c).between(r[f"{c}_lo"], r[f"{c}_hi"])
        part = F.when(inside, F.lit(r.part)).otherwise(part)
    return parted.withColumn("part", part)


def rdc_split(df: DataFrame, columns: list[str], discrete: list[bool], k: int = CLUSTERS, seed: int = SEED, fit_rows: int = FIT_ROWS) -> DataFrame:
    """k-means in the feature space of the dependence coefficient. Ranks and centres come from a bounded sample; all rows are mapped."""
    from collections.abc import Iterator

    import pandas as pd

    from statloom.functions.rdc import projection, sample_matrix

    x = sample_matrix(df, columns, min(fit_rows, 50_000), seed)
    if not len(x):
        return df.withColumn("part", F.lit(0))
    maps = [projection(x[:, i], discrete[i], np.random.default_rng([seed, i])) for i in range(len(columns))]
    centres = np.stack(kmeans(np.concatenate([f(x[:, i]) for i, f in enumerate(maps)], axis=1), k, seed))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = np.concatenate([f(b[c].to_numpy(float, na_value=np.nan)) for c, f in zip(columns, maps, strict=True)], axis=1) if len(b) else np.zeros((0, centres.shape[1]))
            yield b.assign(part=((y[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1).astype("int32"))

    return df.mapInPandas(assign, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "part int"]))


def median_split(df: DataFrame, column: str) -> tuple[DataFrame, list[tuple[float, float]]]:
    """One part per value for up to two values, else at the median; with the tight range of each part."""
    c = F.col(column)
    s = quantiles(df, column, [0.5])
    if s is None:
        return df.withColumn("part", F.lit(0)), []
    lo, (m,), distinct = s
    upper = (c != lo) if distinct <= 2 else (c > m) if m == lo else (c >= m)
    out = df.withColumn("part", upper.cast("int"))
    ranges = {r.part: (float(r.lo), float(r.hi)) for r in out.where("part is not null").groupBy("part").agg(F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}  # two rows
    return out, [ranges[i] for i in sorted(ranges)]


def equal_frequency_cuts(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n): values in order, a bin ends with the value at which its share of all rows is reached."""
    summed = running_sum(value_counts(df, column), "v", F.col("n"), "c")
    bin_ = F.least(F.floor((F.col("c") - F.col("n")) * bins / F.col("c_total")), F.lit(bins - 1)).cast("int")
    return summed.withColumn("bin", bin_).groupBy("bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n"))


def best_cut(x: np.ndarray, scope: list[int], column: int, discrete: list[bool], cuts: int = 15, least_rows: int = 10) -> float | None:
    """On a sample, the cut of a column for which dependence inside the two sides is least (sum of mean RDC)."""
    from statloom.functions.rdc import rdc_matrix

    best = None
    for c in np.unique(np.quantile(x[:, column][~np.isnan(x[:, column])], np.linspace(0, 1, cuts + 2)[1:-1])):
        sides = [x[x[:, column] <= c], x[x[:, column] > c]]
        if min(map(len, sides)) < least_rows:
            continue
        score = sum(float(np.mean(rdc_matrix(s[:, [*scope, column]], [discrete[i] for i in [*scope, column]])[-1, :-1])) for s in sides)
        if best is None or score < best[0]:
            best = (score, float(c))
    return best[1] if best else None


def split_attribute(rdc: np.ndarray, scope: list[int], condition: list[int], use: str = "max") -> int:
    """The condition attribute that depends least on the scope; ties to the first."""
    f = {"max": np.max, "mean": np.mean, "median": np.median}[use]
    return min(condition, key=lambda c: (float(f(rdc[c, scope])), condition.index(c)))


def interval_entropies(df: DataFrame, column: str, most: int = 1200) -> DataFrame:
    """(i, j, h): entropy in bits of the distribution over the consecutive values i..j-1, renormalised, of a discrete column of at most
    `most` values.

    From prefix sums of n and n log n: one row of arrays, from which every pair (i, j) follows without a join.
    """
    counts = value_counts(df, column)
    k = counts.limit(most + 1).count()
    if k > most:
        raise ValueError(f"{column} has more than {most} values")
    row = counts.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("x"))  # at most `most` pairs
    spans = row.select("x", F.explode(F.sequence(F.lit(0), F.size("x") - 1)).alias("i")).where(F.size("x") > 0)
    part = spans.select("i", F.slice("x", F.col("i") + 1, F.size("x")).alias("x"))
    first = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("e"), F.array().cast("array<double>").alias("h"))

    def step(s, y):
        n, e = s["n"] + y["n"], s["e"] + y["n"] * F.log2(y["n"])
        return F.struct(n.alias("n"), e.alias("e"), F.concat(s["h"], F.array(F.log2(n) - e / n)).alias("h"))

    sums = part.select("i", F.posexplode(F.aggregate("x", first, step)["h"]).alias("k", "h"))
    return sums.select(F.col("i").cast("int").alias("i"), (F.col("i") + F.col("k") + 1).cast("int").alias("j"), "h")


def binary_conditioning_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, score): mean Bernoulli log-likelihood of the rest after splitting on each binary column, one pass.

    A side's p = (ones + .1) / (n + .2) for each other column; score = sum over sides of n_side (ll_side + log share) / n.
    """
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("side")) for c in columns])).alias("s"), *columns)
    sides = flat.groupBy("s.column", "s.side").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"_{c}") for c in columns])
    total = df.count()
    ll = F.lit(0.0)
    for c in columns:
        p = (F.col(f"_{c}") + 0.1) / (F.col("n") + 0.2)
        own = (F.col(f"_{c}") * F.log(p) + (F.col("n") - F.col(f"_{c}")) * F.log(1 - p)) / F.col("n")
        ll = ll + F.when(F.col("column") != c, own).otherwise(0.0)
    return sides.groupBy("column").agg((F.sum(F.col("n") * (ll + F.log(F.col("n") / total))) / total).alias("score"))


def conditioning_column(x: np.ndarray) -> int:
    """On a sample of binary columns, the one whose two values explain the others best: the scores of binary_conditioning_scores()."""
    n, best = len(x), (-np.inf, 0)
    for c in range(x.shape[1]):
        score = 0.0
        for v in (0, 1):
            side = x[x[:, c] == v]
            if len(side):
                ones = np.nansum(np.delete(side, c, 1), axis=0)
                p = (ones + 0.1) / (len(side) + 0.2)
                score += ((ones * np.log(p) + (len(side) - ones) * np.log(1 - p)).sum() + len(side) * np.log(len(side) / n)) / n
        if 0 < np.nanmean(x[:, c]) < 1 and score > best[0]:
            best = (score, c)
    return best[1]


#: Links that one task contracts.
PART = 1_000_000


def density_split(df: DataFrame, columns: list[str], eps: float = 2.0, least: int = 10) -> DataFrame:
    """DBSCAN: (row id, part) with part the least core row of its cluster, null for noise. df needs a unique long column `row`.

    A grid's cells are so small that all rows of one are neighbours. So a cell of `least` rows is core as a whole and needs no
    comparison; other rows count their neighbours in the cells around. Core rows of a cell are one group, and groups are joined
    by connected components. A row near cores of several clusters goes to the least. Rows with a null or a value that is not
    finite have no neighbours.
    """
    side = eps / math.sqrt(len(columns))  # any two rows of a cell are neighbours
    finite = reduce(Column.__and__, [F.abs(F.col(c).cast("double")) < float("inf") for c in columns])
    at = cut(df.where(finite).select("row", *columns, *[F.floor(F.col(c) / side).cast("long").alias(f"_g{i}") for i, c in enumerate(columns)]))
    keys = [f"_g{i}" for i in range(len(columns))]
    cells = at.groupBy(*keys).agg(F.count("*").alias("n"))
    reach = math.ceil(math.sqrt(len(columns)))
    # dense cells are core as a whole; rows of other cells, few in each, are compared with the rows of cells in reach
    around = at.join(cells, keys)
    dense, rest = around.where(F.col("n") >= least), around.where(F.col("n") < least)
    far = sum(((F.col(f"p.{c}") - F.col(f"q.{c}")) ** 2 for c in columns), F.lit(0.0)) <= eps * eps
    near = _around(rest.drop("n"), keys, reach).alias("p").join(at.alias("q"), keys).where(far).groupBy("p.row").agg(F.count("*").alias("k"))
    core = cut(dense.select("row", *keys, *columns).union(rest.join(near.where(F.col("k") >= least).select("row"), "row", "left_semi").select("row", *keys, *columns)))
    # core rows of a cell are one group; groups are joined where two of their points are near. On a line, a cell's ends decide
    if len(columns) == 1:
        ends = core.groupBy(*keys).agg(F.min("row").alias("group"), F.array_distinct(F.array(F.min(columns[0]), F.max(columns[0]))).alias("_ends")).withColumn(columns[0], F.explode("_ends"))
    else:
        ends = core.groupBy(*keys, *columns).agg(F.min("row").alias("row")).join(core.groupBy(*keys).agg(F.min("row").alias("group")), keys)
    ends = cut(ends.select("group", *columns, *keys))
    moved = _around(ends.withColumnRenamed("group", "other"), keys, reach)
    links = cut(ends.alias("p").join(moved.alias("q"), keys).where(F.col("p.group") < F.col("q.other")).where(far).select(F.col("p.group").alias("a"), F.col("q.other").alias("b")).distinct())
    label = _labels(ends.select("group", *keys).distinct(), links)
    inner = core.join(label, keys).select("row", "part")
    edge = at.join(core.select("row"), "row", "left_anti").alias("p").join(moved.alias("q"), keys).where(far)
    edge = edge.join(label.select("group", "part"), F.col("q.other") == F.col("group")).groupBy("p.row").agg(F.min("part").alias("part"))
    return df.select("row").join(inner.union(edge), "row", "left").select("row", "part")


def _labels(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (group, ...) with part, the least group that links (a, b) reach. Tasks contract their links; what few of them hold is settled then."""
    parts = max(1, -(-links.count() // PART))
    stars = cut(links.repartition(parts, "a").mapInArrow(_stars, "a long, b long"))
    if parts == 1:
        return cut(groups.join(stars, F.col("group") == F.col("a"), "left").select(*groups.columns, F.coalesce("b", "group").alias("part")))
    label = cut(groups.select(F.col("group").alias("g"), F.col("group").alias("part")))
    both = cut(stars.union(stars.select("b", "a")))
    while True:  # the least label among neighbours, then that label's own; each round is cut
        low = both.join(label, F.col("b") == F.col("g")).groupBy("a").agg(F.min("part").alias("m"))
        new = label.join(low, F.col("g") == F.col("a"), "left").select("g", F.least("part", "m").alias("part"))
        up = new.select(F.col("g").alias("u"), F.col("part").alias("top"))
        new = cut(new.join(up, F.col("part") == F.col("u"), "left").select("g", F.coalesce("top", "part").alias("part")))
        if not new.join(label.withColumnRenamed("part", "old"), "g").where("part <> old").limit(1).count():
            break
        label = new
    return groups.join(label, F.col("group") == F.col("g")).drop("g")


def _stars(batches):
    held = list(batches)
    if held:
        node, root = star_edges(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("a", "b")))
        yield pa.RecordBatch.from_pydict({"a": pa.array(node, pa.int64()), "b": pa.array(root, pa.int64())})


def _around(df: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Each row once for every cell of a grid (keys) up to reach steps from its own."""
    for k in keys:
        df = df.withColumn(k, F.explode(F.sequence(F.col(k) - reach, F.col(k) + reach)))
    return df


def quantiles(df: DataFrame, column: str, shares: list[float]) -> tuple[float, list[float], int] | None:
    """The least value, exact quantiles (linear between neighbours), and the number of different values.

    From running sums over ranges of the counted values: a task holds a range, and the driver receives two values for each quantile.
    """
    summed = running_sum(value_counts(df, column), "v", F.col("n"), "c")
    ends = summed.agg(F.max("c_total").alias("n"), F.min("v").alias("lo"), F.count("*").alias("k")).first()
    if not ends.n:
        return None
    at = [q * (ends.n - 1) for q in shares]
    spots = sorted({int(np.floor(a)) for a in at} | {int(np.ceil(a)) for a in at})
    holds = F.filter(F.array(*map(F.lit, spots)), lambda p: (F.col("c") > p) & (F.col("c") - F.col("n") <= p))
    value = {p: r.v for r in summed.select("v", holds.alias("spots")).where(F.size("spots") > 0).collect() for p in r.spots}  # at most one row for each spot
    return ends.lo, [value[int(np.floor(a))] + (a - np.floor(a)) * (value[int(np.ceil(a))] - value[int(np.floor(a))]) for a in at], ends.k


def part_shares(df: DataFrame) -> DataFrame:
    """(part, n, share) of a split."""
    n = df.groupBy("part").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count("*").alias("_t")))).select("part", "n", (F.col("n") / F.col("_t")).alias("share"))  # one row
