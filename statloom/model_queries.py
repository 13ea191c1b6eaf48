"""More queries, one for each operator that the first module has none for: fixed models and leaves whose answers SQL can repeat."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators import columns as C
from statloom.operators import families as P
from statloom.operators import histograms as H
from statloom.operators import prepare as T
from statloom.operators import ranges as I
from statloom.operators import rows as R
from statloom.plans import nodes as N
from statloom.plans.export import as_column, as_text, from_text
from statloom.plans.learn import Params, joint_leaf, learn_binary
from statloom.plans.learn import histogram_leaf as leaf
from statloom.plans.model import Model, error_percentiles, q_errors
from statloom.plans.shapes import Parametric, TreeLeaf, parametric, piecewise
from statloom.plans.strategies import split_functions
from statloom.queries import _DERIVED, _EXACT, _FLAGS, _HIST, _flags, _product, derived, query, read
from statloom.sources.context import MetaType, schema_context
from statloom.sources.toy import toy
from statloom.sources.workload import conditional_truth, query_frame, with_truth
from statloom.streaming.maintain import update

PLAIN = Params(alpha=0.0)


def lines(spark, sf) -> DataFrame:
    """Quantity and line number of each line item, keyed."""
    return read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("row"), F.col("l_quantity").alias("q"), F.col("l_linenumber").cast("double").alias("k"))


def one(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- sources


@query("schema_context", """WITH v AS (SELECT 'part' AS t, 'p_partkey' AS name, CAST(p_partkey AS DOUBLE) AS v, TRUE AS whole FROM part UNION ALL SELECT 'part', 'p_size', p_size, TRUE FROM part UNION ALL SELECT 'part', 'p_retailprice', p_retailprice, FALSE FROM part
UNION ALL SELECT 'supplier', 's_suppkey', s_suppkey, TRUE FROM supplier UNION ALL SELECT 'supplier', 's_nationkey', s_nationkey, TRUE FROM supplier UNION ALL SELECT 'supplier', 's_acctbal', s_acctbal, FALSE FROM supplier),
p AS (SELECT t, name, min(v) AS lo, max(v) AS hi, count(DISTINCT v) AS ndv, bool_and(whole) AS whole FROM v GROUP BY 1, 2)
SELECT t AS "table", name, CASE WHEN whole AND ndv <= 1200 THEN 'DISCRETE' ELSE 'REAL' END AS meta, lo, hi, ndv, ndv <= 1200 AS groupable FROM p""")
def schema_context_(spark, sf):
    return schema_context({"part": read(spark, sf, "part"), "supplier": read(spark, sf, "supplier")})


@query("toy_tables", "SELECT name, CAST(1000 AS BIGINT) AS n, CAST(0 AS BIGINT) AS broken FROM (VALUES ('strong_corr_cat'), ('medium_corr_cat'), ('sweep_total')) t(name)")
def toy_tables(spark, sf):
    """Rows of synthetic tables, and those that break a relation which their rules state."""
    holds = {"strong_corr_cat": "a3 = a1 + a2 and a2 - a1 in (0, 1) and a7 = a1 + 10 and a8 = a1 + a4 + a5 + a7", "medium_corr_cat": "a3 = a1 + a2 and a2 - a1 in (0, 1) and a4 - a3 between 0 and 2 and a1 between 0 and 9", "sweep_total": "a2 = a1 + 1 and a3 = a1 + a2 and a4 = 2 * a1 + 1 and a8 = a2 * a2"}
    parts = [toy(spark, name, 1000).agg(F.count("*").alias("n"), F.count(F.when(~F.expr(rule), 1)).alias("broken")).select(F.lit(name).alias("name"), "n", "broken") for name, rule in holds.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("conditional_workload", f"WITH {_DERIVED}, e AS (SELECT * FROM d WHERE a = 3 AND d = 1) SELECT CAST(row_number() OVER (ORDER BY b, c) - 1 AS BIGINT) AS query_id, (SELECT count(*) FROM e WHERE e.b = q.b AND e.c = q.c) * 1.0 / (SELECT count(*) FROM e) AS truth FROM (SELECT b, c FROM (VALUES (3.0), (4.0)) x(b), (VALUES (3.0), (5.0), (12.0), (99.0)) y(c)) q")
def conditional_workload(spark, sf):
    queries = [{"b": b, "c": c} for b in (3.0, 4.0) for c in (3.0, 5.0, 12.0, 99.0)]
    return conditional_truth(derived(spark, sf), {"a": 3.0, "d": 1.0}, queries)


# --- row splits and preparation


@query("split_by_name", "WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS m FROM lineitem) SELECT CAST(l_quantity >= m AS INTEGER) AS part, count(*) AS n, count(*) * 1.0 / (SELECT count(*) FROM lineitem) AS share FROM lineitem, m GROUP BY 1")
def split_by_name(spark, sf):
    _, rows = split_functions("rdc", "grid_naive")
    return R.part_shares(rows(read(spark, sf, "lineitem"), ["l_quantity"]))


@query("grid_split", "WITH s AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part) SELECT CAST(least(floor((p_size - a) * 1.0 / (b - a) * 3), 2) + 3 * least(floor((p_retailprice - c) / (d - c) * 3), 2) AS INTEGER) AS part, count(*) AS n, count(*) * 1.0 / (SELECT count(*) FROM part) AS share FROM part, s GROUP BY 1")
def grid_split(spark, sf):
    return R.part_shares(R.grid_split(read(spark, sf, "part"), ["p_size", "p_retailprice"], 3))


@query("rectangles", "WITH s AS (SELECT p_size, p_retailprice, CASE WHEN (p_size - 10.0) * (p_size - 10.0) + (p_retailprice - 1000.0) * (p_retailprice - 1000.0) <= (p_size - 40.0) * (p_size - 40.0) + (p_retailprice - 1500.0) * (p_retailprice - 1500.0) THEN 0 ELSE 1 END AS part FROM part) SELECT part, CAST(min(p_size) AS DOUBLE) AS p_size_lo, CAST(max(p_size) AS DOUBLE) AS p_size_hi, min(p_retailprice) AS p_retailprice_lo, max(p_retailprice) AS p_retailprice_hi, count(*) AS n FROM s GROUP BY part")
def rectangles(spark, sf):
    return R.rectangles(R.nearest_centre(read(spark, sf, "part"), ["p_size", "p_retailprice"], [np.array([10.0, 1000.0]), np.array([40.0, 1500.0])]), ["p_size", "p_retailprice"])


@query("rectangle_split", "SELECT CAST(0 AS BIGINT) AS outside, CAST(2 AS BIGINT) AS parts")
def rectangle_split(spark, sf):
    """Rows that lie outside the box of their part, and the number of parts."""
    parted = R.rectangle_split(read(spark, sf, "part"), ["p_size", "p_retailprice"])
    return parted.agg(F.count(F.when(F.col("part").isNull(), 1)).alias("outside"), F.count_distinct("part").alias("parts"))


@query("rdc_split")
def rdc_split(spark, sf):
    return R.part_shares(R.rdc_split(derived(spark, sf), ["a", "c"], [True, False]))


@query("condition_clusters")
def condition_clusters(spark, sf):
    """Clusters of the condition columns, with the boxes that tell them."""
    return R.rectangles(R.kmeans_split(derived(spark, sf), ["d", "e"])[0], ["d", "e"])


@query("searched_cut")
def searched_cut(spark, sf):
    """The cut of a that leaves b and c least dependent on it, searched on a sample."""
    from statloom.functions.rdc import sample_matrix

    x = sample_matrix(derived(spark, sf), ["b", "c", "a"], 20_000)
    return one(spark, [(float(R.best_cut(x, [0, 1], 2, [True] * 3)),)], "cut double")


@query("count_transforms", "SELECT l_orderkey * 10 + l_linenumber AS row, ln(1 + l_quantity) AS q, ln(1.0 + l_linenumber) AS k FROM lineitem")
def count_transforms(spark, sf):
    return T.count_columns(lines(spark, sf), ["q", "k"], "log1p")


@query("root_transforms", "SELECT l_orderkey * 10 + l_linenumber AS row, sqrt(l_quantity) AS q, sqrt(l_linenumber) AS k FROM lineitem")
def root_transforms(spark, sf):
    return T.count_columns(lines(spark, sf), ["q", "k"], "sqrt")


@query("tfidf", """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS row, l_quantity % 3 AS x, CAST(l_linenumber % 2 AS DOUBLE) AS y FROM lineitem),
i AS (SELECT ln((1.0 + count(*)) / (1 + count(*) FILTER (x > 0))) + 1 AS ix, ln((1.0 + count(*)) / (1 + count(*) FILTER (y > 0))) + 1 AS iy FROM r),
w AS (SELECT row, CASE WHEN x + y > 0 THEN x / (x + y) ELSE 0 END * ix AS x, CASE WHEN x + y > 0 THEN y / (x + y) ELSE 0 END * iy AS y FROM r, i)
SELECT row, CASE WHEN x + y > 0 THEN x / sqrt(x * x + y * y) ELSE 0 END AS x, CASE WHEN x + y > 0 THEN y / sqrt(x * x + y * y) ELSE 0 END AS y FROM w""")
def tfidf(spark, sf):
    return T.count_columns(lines(spark, sf).select("row", (F.col("q") % 3).alias("x"), (F.col("k") % 2).alias("y")), ["x", "y"], "tfidf")


@query("one_hot", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS \"o_orderstatus=F\", CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus=O\" FROM orders")
def one_hot(spark, sf):
    return T.one_hot(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"])


# --- leaves


@query("histogram_density", f"WITH {_HIST} SELECT lo, hi, v, pdf / (hi - lo) AS density FROM h")
def histogram_density(spark, sf):
    return H.densities(H.histogram(read(spark, sf, "lineitem"), "l_quantity"))


@query("conditional_histogram", "WITH c AS (SELECT CAST(l_linenumber > 2 AS INTEGER) + CAST(l_linenumber > 5 AS INTEGER) AS part, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT part, v, n, (n + 1.0) / (sum(n) OVER (PARTITION BY part) + count(*) OVER (PARTITION BY part)) AS pdf FROM c")
def conditional_histogram(spark, sf):
    return H.conditional_histogram(read(spark, sf, "lineitem"), "l_quantity", "l_linenumber", [2, 5])


@query("kernel_histogram")
def kernel_histogram(spark, sf):
    return T.kernel_bins(read(spark, sf, "customer"), "c_acctbal")


@query("reduced_cells", "SELECT TRUE AS whole, TRUE AS boxed")
def reduced_cells(spark, sf):
    """Whether cells over principal axes hold all of the mass, and answer a box nearly as the rows do."""
    t = derived(spark, sf)
    cells = T.reduced_cells(t, ["a", "b", "c"])
    box = {"a": (2.0, 6.0), "c": (4.0, 11.0)}
    mass, p = cells.agg(F.sum("pdf")).first()[0], T.box_of_reduced(cells, box).first().p
    true = t.agg(F.avg((F.col("a").between(2, 6) & F.col("c").between(4, 11)).cast("double"))).first()[0]
    return one(spark, [(abs(mass - 1) < 1e-9, abs(p - true) < 0.1)], "whole boolean, boxed boolean")


@query("mle_counts", """WITH s AS (SELECT avg(l_linenumber) AS m, var_pop(l_linenumber) AS v FROM lineitem), b AS (SELECT avg(toxic) AS m FROM labels)
SELECT 'poisson' AS family, m AS a, CAST(NULL AS DOUBLE) AS b FROM s UNION ALL SELECT 'geometric', 1 / m, NULL FROM s UNION ALL SELECT 'negative_binomial', m * m / (v - m), m / v FROM s WHERE v > m UNION ALL SELECT 'bernoulli', m, NULL FROM b""")
def mle_counts(spark, sf):
    counts = P.fit(read(spark, sf, "lineitem"), "l_linenumber").where("family in ('poisson', 'geometric', 'negative_binomial')")
    return counts.union(P.fit(read(spark, sf, "labels"), "toxic").where("family = 'bernoulli'"))


@query("mle_overdispersed", "WITH s AS (SELECT avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem) SELECT 'negative_binomial' AS family, m * m / (v - m) AS a, m / v AS b FROM s WHERE v > m")
def mle_overdispersed(spark, sf):
    return P.fit(read(spark, sf, "lineitem"), "l_quantity").where("family = 'negative_binomial'")


@query("mle_hypergeometric", "SELECT CAST(50 AS DOUBLE) AS a, least(CAST(50 AS DOUBLE), floor(avg(l_linenumber) / 10 * 51)) AS b, CAST(10 AS DOUBLE) AS c FROM lineitem")
def mle_hypergeometric(spark, sf):
    return P.fit_hypergeometric(read(spark, sf, "lineitem"), "l_linenumber", 50, 10)


@query("log_densities", """SELECT event_id, value AS x, -ln(value) - ln(0.5 * sqrt(2 * pi())) - pow(ln(value) - 3, 2) / 0.5 AS lognormal, ln(0.02) - 0.02 * value AS exponential,
2 * ln(0.05) - lgamma(2) + ln(value) - 0.05 * value AS gamma, CASE WHEN value BETWEEN 10 AND 200 THEN -ln(190) END AS uniform FROM events""")
def log_densities(spark, sf):
    """The formulas at any value: as in the SQL, the logarithm of 0 is -infinity, that of less NaN, and only the uniform density has an end."""
    x, ln = F.col("value"), F.coalesce("_ln", F.log("value"))  # of 0, NaN and infinity as Spark has it
    e = read(spark, sf, "events").select("event_id", "value").withColumn("_ln", P.c_log(x))
    made = {f: P.log_density(f, x, a, b, ln=ln, square=P.c_square) for f, a, b in (("lognormal", 3.0, 0.5), ("exponential", 0.02, None), ("gamma", 2.0, 0.05), ("uniform", 10.0, 200.0))}
    nan = F.lit(float("nan"))
    made |= {"lognormal": F.when(x > 0, made["lognormal"]).otherwise(nan), "exponential": F.when(x >= 0, made["exponential"]).otherwise(math.log(0.02) - 0.02 * x)}
    made |= {"gamma": F.when(x >= 0, made["gamma"]).otherwise(nan), "uniform": F.when(x.between(10, 200), made["uniform"])}
    return e.select("event_id", x.alias("x"), *[F.when(x.isNotNull(), c).alias(f) for f, c in made.items()])


@query("log_masses", """SELECT l_orderkey * 10 + l_linenumber AS row, l_quantity * ln(20.0) - 20 - lgamma(l_quantity + 1) AS poisson, (l_quantity - 1) * ln(0.95) + ln(0.05) AS geometric,
lgamma(l_quantity + 3) - lgamma(l_quantity + 1) - lgamma(3) + 3 * ln(0.1) + l_quantity * ln(0.9) AS negative_binomial,
CASE WHEN l_quantity <= 20 THEN lgamma(41) - lgamma(l_quantity + 1) - lgamma(41 - l_quantity) + lgamma(61) - lgamma(21 - l_quantity) - lgamma(41 + l_quantity) - lgamma(101) + lgamma(21) + lgamma(81) END AS hypergeometric,
CASE WHEN l_linenumber = 1 THEN ln(0.3) END AS bernoulli FROM lineitem""")
def log_masses(spark, sf):
    x = F.col("q")
    made = {f: P.log_density(f, v, a, b, c) for f, v, a, b, c in (("poisson", x, 20.0, None, 0.0), ("geometric", x, 0.05, None, 0.0), ("negative_binomial", x, 3.0, 0.1, 0.0), ("hypergeometric", x, 100.0, 40.0, 20.0), ("bernoulli", F.col("k"), 0.3, None, 0.0))}
    return lines(spark, sf).select("row", *[F.when(m != float("-inf"), m).alias(f) for f, m in made.items()])


_FAMILIES = [("gaussian", 3.0, 2.0, 0.0), ("lognormal", 0.5, 0.4, 0.0), ("exponential", 0.2, 0.0, 0.0), ("gamma", 3.0, 0.5, 0.0), ("uniform", 1.0, 5.0, 0.0), ("poisson", 4.5, 0.0, 0.0), ("geometric", 0.25, 0.0, 0.0), ("bernoulli", 0.3, 0.0, 0.0), ("negative_binomial", 4.0, 0.4, 0.0), ("hypergeometric", 50.0, 20.0, 10.0)]
_FAMILY_ROWS = "(VALUES ('gaussian', 3.0, 13.0, 3.0), ('lognormal', exp(0.58), exp(1.32), exp(0.34)), ('exponential', 5.0, 50.0, 0.0), ('gamma', 6.0, 48.0, 4.0), ('uniform', 3.0, 31.0 / 3, 3.0), ('poisson', 4.5, 24.75, 4.0), ('geometric', 4.0, 28.0, 1.0), ('bernoulli', 0.3, 0.3, 0.0), ('negative_binomial', 6.0, 51.0, 4.0), ('hypergeometric', 4.0, 16.0 + 96.0 / 49, 4.0)) t(family, m1, m2, mode)"


@query("family_moments", f"SELECT family, CAST(m1 AS DOUBLE) AS m1, CAST(m2 AS DOUBLE) AS m2, CAST(mode AS DOUBLE) AS mode FROM {_FAMILY_ROWS}")
def family_moments(spark, sf):
    return one(spark, [(f, P.moment(f, 1, a, b, c), P.moment(f, 2, a, b, c), P.mode(f, a, b, c)) for f, a, b, c in _FAMILIES], "family string, m1 double, m2 double, mode double")


@query("parametric_leaves", f"SELECT family, TRUE AS whole, TRUE AS moments, TRUE AS sampled FROM {_FAMILY_ROWS}")
def parametric_leaves(spark, sf):
    """Whether a leaf of each family has mass 1, partial expectations that add up to its moments, and draws that have them."""
    out = []
    for f, a, b, c in _FAMILIES:
        n = Parametric(["x"], family=f, a=a, b=b, c=c)
        ends = np.array([-np.inf]), np.array([np.inf])
        m1, m2 = P.moment(f, 1, a, b, c), P.moment(f, 2, a, b, c)
        x = n.draw(40_000, np.random.default_rng(5))
        spread = math.sqrt(m2 - m1 * m1)
        out.append((f, bool(abs(n.range_mass(*ends)[0] - 1) < 1e-9), bool(abs(n.partial(*ends, 1)[0] - m1) < 1e-3 * max(1, m1) and abs(n.partial(*ends, 2)[0] - m2) < 1e-2 * max(1, m2)), bool(abs(x.mean() - m1) < 0.05 * spread)))
    return one(spark, out, "family string, whole boolean, moments boolean, sampled boolean")


@query("parametric_model", """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d, avg(l_linenumber) AS r FROM lineitem)
SELECT l_orderkey * 10 + l_linenumber AS row, -pow(l_quantity - m, 2) / (2 * d * d) - ln(d * sqrt(2 * pi())) + l_linenumber * ln(r) - r - lgamma(l_linenumber + 1) AS ll FROM lineitem, s""")
def parametric_model(spark, sf):
    """A model of a Gaussian and a Poisson leaf, fitted."""
    t = lines(spark, sf)
    return Model(N.assign_ids(parametric(t, "q", "gaussian") * parametric(t, "k", "poisson")), t.count(), spark).log_likelihood(t, "row")


def _knots(spark, sf):
    return piecewise(H.piecewise(H.width_bins(read(spark, sf, "customer"), "c_acctbal", 20)), "x")


_ACCT = "s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer), b AS (SELECT CAST(least(floor((c_acctbal - a) / (b - a) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM customer, s GROUP BY 1), m AS (SELECT a + (bin + 0.5) * ((b - a) / 20) AS x, n / ((b - a) / 20) AS y FROM b, s), pt AS (SELECT * FROM m UNION ALL SELECT min(x) - 1e-8, 0 FROM m UNION ALL SELECT max(x) + 1e-8, 0 FROM m), sg AS (SELECT x AS x0, lead(x) OVER (ORDER BY x) AS x1, y AS y0, lead(y) OVER (ORDER BY x) AS y1 FROM pt), ar AS (SELECT sum((x1 - x0) * (y0 + y1) / 2) AS area, max(x1) - min(x0) AS rg FROM sg WHERE x1 IS NOT NULL), pw AS (SELECT x0, x1, 0.9 * y0 / area + 0.1 / rg AS y0, 0.9 * y1 / area + 0.1 / rg AS y1 FROM sg, ar WHERE x1 IS NOT NULL)"


@query("piecewise_shape", f"WITH {_ACCT} SELECT sum((x1 - x0) * (x0 * (2 * y0 + y1) + x1 * (y0 + 2 * y1)) / 6) AS mean, (SELECT x0 FROM pw ORDER BY y0 DESC LIMIT 1) AS mode FROM pw")
def piecewise_shape(spark, sf):
    """Mean and mode of a piecewise-linear leaf."""
    n = _knots(spark, sf)
    return one(spark, [(n.moment(1), n.mode())], "mean double, mode double")


@query("piecewise_density", f"WITH {_ACCT} SELECT c_custkey, coalesce((SELECT max(y0 + (y1 - y0) * (c_acctbal - x0) / (x1 - x0)) FROM pw WHERE c_acctbal >= x0 AND c_acctbal < x1), 0) AS y FROM customer")
def piecewise_density(spark, sf):
    """The density of a piecewise-linear leaf at every customer's balance, from the model and from its SQL text alike."""
    node = N.assign_ids(_knots(spark, sf))
    return read(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x")).select("c_custkey", as_column(node).alias("y"))


@query("piecewise_samples", "SELECT TRUE AS inside, TRUE AS close")
def piecewise_samples(spark, sf):
    """Whether draws from two ranges lie in them, each as often as its mass says."""
    n = _knots(spark, sf)
    ranges = [(0.0, 1000.0), (5000.0, 9000.0)]
    x = n.draw(40_000, np.random.default_rng(3), ranges)
    mass = [float(n.range_mass(np.array([lo]), np.array([hi]))[0]) for lo, hi in ranges]
    share = ((x >= 0) & (x <= 1000)).mean()
    return one(spark, [(bool((((x >= 0) & (x <= 1000)) | ((x >= 5000) & (x <= 9000))).all()), bool(abs(share - mass[0] / sum(mass)) < 0.01))], "inside boolean, close boolean")


@query("multivariate_gaussian", """WITH s AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b, var_samp(p_size) AS v, var_samp(p_retailprice) AS w, covar_samp(p_size, p_retailprice) AS c FROM part)
SELECT p_partkey, -0.5 * (w * pow(p_size - a, 2) - 2 * c * (p_size - a) * (p_retailprice - b) + v * pow(p_retailprice - b, 2)) / (v * w - c * c) - 0.5 * ln(v * w - c * c) - ln(2 * pi()) AS ll FROM part, s""")
def multivariate_gaussian(spark, sf):
    from statloom.plans.shapes import Gaussians

    t = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
    return Model(N.assign_ids(Gaussians.fit(t, ["s", "r"])), t.count(), spark).log_likelihood(t, "p_partkey")


# --- predicates


@query("exact_point", f"WITH {_EXACT} SELECT CAST(query_id AS BIGINT) AS query_id, coalesce((SELECT p FROM e WHERE v = x), 0) AS p FROM (VALUES (0, 7.0::DOUBLE), (1, 7.5), (2, 50.0)) q(query_id, x)")
def exact_point(spark, sf):
    """Exact-value leaf at points: intervals of one value."""
    from statloom.operators.predicates import interval_probability

    q = one(spark, [(0, [(7.0, 7.0, True, True)]), (1, [(7.5, 7.5, True, True)]), (2, [(50.0, 50.0, True, True)])], "query_id long, intervals array<struct<lo:double,hi:double,lo_inc:boolean,hi_inc:boolean>>")
    return interval_probability(H.exact_leaf(read(spark, sf, "lineitem"), "l_quantity"), q)


_CONDITIONS = [
    {"q": I.NumericRange((I.Interval(5, 10, False, True), I.Interval(8, 12), I.Interval(20, 20)))},
    {"q": I.NumericRange((I.Interval(5, 10),)).meet(I.NumericRange((I.Interval(8, 30, False),)))},
    {"q": I.NumericRange((I.Interval(3, 3, True, False),))},
    {"q": I.NominalRange(frozenset({1.0, 2.0, 77.0})), "k": I.NumericRange((I.Interval(-math.inf, 3),))},
]


@query("range_objects", "SELECT CAST(i AS BIGINT) AS query_id, impossible, (SELECT count(*) FROM lineitem WHERE CASE i WHEN 0 THEN (l_quantity > 5 AND l_quantity <= 12) OR l_quantity = 20 WHEN 1 THEN l_quantity > 8 AND l_quantity <= 10 WHEN 2 THEN FALSE ELSE l_quantity IN (1, 2, 77) AND l_linenumber <= 3 END) AS n FROM (VALUES (0, FALSE), (1, FALSE), (2, TRUE), (3, FALSE)) t(i, impossible)")
def range_objects(spark, sf):
    """Unions, meets and impossible predicates, counted."""
    n = lines(spark, sf).agg(*[F.count(F.when(I.holds(c), 1)).alias(str(i)) for i, c in enumerate(_CONDITIONS)]).first()
    return one(spark, [(i, any(r.is_impossible() for r in c.values()), n[i]) for i, c in enumerate(_CONDITIONS)], "query_id long, impossible boolean, n long")


@query("flat_ranges", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'q', CAST(2 AS BIGINT), FALSE), (1, 'q', 1, FALSE), (2, 'q', 0, FALSE), (3, 'q', 3, TRUE), (3, 'k', 1, FALSE)) t(query_id, \"column\", n, inverted)")
def flat_ranges(spark, sf):
    return I.flat(spark, [{c: I.NominalRange(r.values) if isinstance(r, I.NominalRange) else r for c, r in x.items()} for x in _CONDITIONS], frozenset()).select("query_id", "column", F.size("intervals").cast("long").alias("n"), (F.col("column").eqNullSafe("q") & (F.col("query_id") == 3)).alias("inverted"))


# --- fixed models


def _joint(spark, sf) -> Model:
    t = lines(spark, sf)
    n = t.count()
    return Model(N.assign_ids(joint_leaf(t, ["q", "k"], dict.fromkeys(["q", "k"], MetaType.DISCRETE), PLAIN, n)), n, spark)


_JOINT_Q = [{"q": (10.0, 20.0), "k": (1.0, 3.0)}, {"q": (50.0, 50.0)}, {"k": (2.0, 2.0), "q": (3.0, 3.0)}]
_JOINT_SQL = "(VALUES (CAST(0 AS BIGINT), 10, 20, 1, 3), (1, 50, 50, 1, 7), (2, 3, 3, 2, 2)) t(query_id, a, b, c, d)"


@query("joint_leaf", f"SELECT query_id, (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN a AND b AND l_linenumber BETWEEN c AND d) * 1.0 / (SELECT count(*) FROM lineitem) AS selectivity, CAST((SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN a AND b AND l_linenumber BETWEEN c AND d) AS DOUBLE) AS cardinality FROM {_JOINT_SQL}")
def joint_leaf_(spark, sf):
    return _joint(spark, sf).probability(query_frame(spark, _JOINT_Q, ["q", "k"]))


@query("joint_point", "SELECT l_orderkey * 10 + l_linenumber AS row, ln(count(*) OVER (PARTITION BY l_quantity, l_linenumber) * 1.0 / count(*) OVER ()) AS ll FROM lineitem")
def joint_point(spark, sf):
    return _joint(spark, sf).log_likelihood(lines(spark, sf), "row")


@query("joint_expectation", f"SELECT query_id, coalesce((SELECT sum(l_quantity * l_linenumber) FROM lineitem WHERE l_quantity BETWEEN a AND b AND l_linenumber BETWEEN c AND d), 0) / (SELECT count(*) FROM lineitem) AS e, (SELECT avg(l_quantity * l_linenumber) FROM lineitem WHERE l_quantity BETWEEN a AND b AND l_linenumber BETWEEN c AND d) AS conditional FROM {_JOINT_SQL}")
def joint_expectation(spark, sf):
    return _joint(spark, sf).expectation(query_frame(spark, _JOINT_Q, ["q", "k"]), {"q": 1, "k": 1})


@query("marginalised_likelihood", "SELECT l_orderkey * 10 + l_linenumber AS row, CASE WHEN l_linenumber > 3 THEN ln(count(*) OVER (PARTITION BY l_linenumber) * 1.0 / count(*) OVER ()) ELSE ln(count(*) OVER (PARTITION BY l_quantity, l_linenumber) * 1.0 / count(*) OVER ()) END AS ll FROM lineitem")
def marginalised_likelihood(spark, sf):
    """Of rows that lack the quantity where the line number is over 3."""
    return _joint(spark, sf).log_likelihood(lines(spark, sf).withColumn("q", F.when(F.col("k") <= 3, F.col("q"))), "row")


@query("conditional_likelihood", "SELECT l_orderkey * 10 + l_linenumber AS row, ln(count(*) OVER (PARTITION BY l_quantity, l_linenumber) * 1.0 / count(*) OVER (PARTITION BY l_linenumber)) AS ll FROM lineitem")
def conditional_likelihood(spark, sf):
    return _joint(spark, sf).log_likelihood(lines(spark, sf), "row", given=["k"])


def _factorized(spark, sf) -> Model:
    """The line number, and the quantity given whether that is over 3."""
    t = lines(spark, sf)
    n = t.count()
    sides = [t.where("k <= 3"), t.where("k > 3")]
    pieces = [leaf(s, "q", MetaType.DISCRETE, PLAIN, s.count()) for s in sides]
    split = N.Split(["q"], pieces, boxes=[{"k": (-math.inf, 3.0)}, {"k": (4.0, math.inf)}], weights=np.array([p.rows / n for p in pieces]), rows=float(n))
    return Model(N.assign_ids(split.given(leaf(t, "k", MetaType.DISCRETE, PLAIN, n))), n, spark)


_FACT = "g AS (SELECT l_linenumber > 3 AS side, count(*) AS n FROM lineitem GROUP BY 1)"


@query("factorized_probability", f"""WITH {_FACT}, p AS (SELECT query_id, sum((SELECT count(*) FROM lineitem WHERE (l_linenumber > 3) = side AND l_linenumber BETWEEN c AND d) * 1.0 / (SELECT count(*) FROM lineitem)
* (SELECT count(*) FROM lineitem WHERE (l_linenumber > 3) = side AND l_quantity BETWEEN a AND b) / n) AS selectivity FROM g, (VALUES (CAST(0 AS BIGINT), 10, 20, 1, 5), (1, 1, 50, 4, 4), (2, 7, 7, 1, 7)) t(query_id, a, b, c, d) GROUP BY 1)
SELECT query_id, selectivity, selectivity * (SELECT count(*) FROM lineitem) AS cardinality FROM p""")
def factorized_probability(spark, sf):
    return _factorized(spark, sf).probability(query_frame(spark, [{"q": (10.0, 20.0), "k": (1.0, 5.0)}, {"k": (4.0, 4.0)}, {"q": (7.0, 7.0)}], ["q", "k"]))


@query("factorized_likelihood", "SELECT l_orderkey * 10 + l_linenumber AS row, ln(count(*) OVER (PARTITION BY l_linenumber) * 1.0 / count(*) OVER ()) + ln(count(*) OVER (PARTITION BY l_linenumber > 3, l_quantity) * 1.0 / count(*) OVER (PARTITION BY l_linenumber > 3)) AS ll FROM lineitem")
def factorized_likelihood(spark, sf):
    return _factorized(spark, sf).log_likelihood(lines(spark, sf), "row")


@query("factorized_moments", "SELECT 'q' AS attribute, avg(l_quantity) AS mean, var_pop(l_quantity) AS variance FROM lineitem UNION ALL SELECT 'k', avg(l_linenumber), var_pop(l_linenumber) FROM lineitem")
def factorized_moments(spark, sf):
    root = _factorized(spark, sf).root
    mean, var = N.moments(root, 1), N.variance(root)
    return one(spark, [(c, float(mean[c]), float(var[c])) for c in mean], "attribute string, mean double, variance double")


@query("factorized_expectation", f"WITH {_FACT} SELECT CAST(0 AS BIGINT) AS query_id, sum((SELECT count(*) FROM lineitem WHERE (l_linenumber > 3) = side AND l_linenumber <= 5) * 1.0 / (SELECT count(*) FROM lineitem) * (SELECT sum(l_quantity) FROM lineitem WHERE (l_linenumber > 3) = side AND l_quantity BETWEEN 10 AND 20) / n) AS e, sum((SELECT count(*) FROM lineitem WHERE (l_linenumber > 3) = side AND l_linenumber <= 5) * 1.0 * (SELECT sum(l_quantity) FROM lineitem WHERE (l_linenumber > 3) = side AND l_quantity BETWEEN 10 AND 20) / n) / sum((SELECT count(*) FROM lineitem WHERE (l_linenumber > 3) = side AND l_linenumber <= 5) * 1.0 * (SELECT count(*) FROM lineitem WHERE (l_linenumber > 3) = side AND l_quantity BETWEEN 10 AND 20) / n) AS conditional FROM g")
def factorized_expectation(spark, sf):
    return _factorized(spark, sf).expectation(query_frame(spark, [{"q": (10.0, 20.0), "k": (-math.inf, 5.0)}], ["q", "k"]), {"q": 1})


@query("conditioned_model", "SELECT CAST(i AS BIGINT) AS query_id, (SELECT count(*) FROM lineitem WHERE l_linenumber > 3 AND l_quantity BETWEEN a AND b) * 1.0 / (SELECT count(*) FROM lineitem WHERE l_linenumber > 3) AS selectivity, (SELECT ln(count(*) FILTER (l_linenumber = 5) * 1.0 / count(*)) FROM lineitem) AS log_evidence FROM (VALUES (0, 1, 10), (1, 33, 33)) t(i, a, b)")
def conditioned_model(spark, sf):
    m, ll = _factorized(spark, sf).given(k=5.0)
    return m.probability(query_frame(spark, [{"q": (1.0, 10.0)}, {"q": (33.0, 33.0)}], ["q"])).select("query_id", "selectivity", F.lit(float(ll)).alias("log_evidence"))


@query("marginal_model", "SELECT CAST(0 AS BIGINT) AS query_id, count(*) FILTER (l_quantity BETWEEN 10 AND 20) * 1.0 / count(*) AS selectivity, CAST(count(*) FILTER (l_quantity BETWEEN 10 AND 20) AS DOUBLE) AS cardinality FROM lineitem")
def marginal_model(spark, sf):
    return _joint(spark, sf).marginal(["q"]).probability(query_frame(spark, [{"q": (10.0, 20.0)}], ["q"]))


@query("conditional_moments", "SELECT CAST(k AS DOUBLE) AS k, (SELECT avg(l_quantity) FROM lineitem WHERE (l_linenumber > 3) = (k > 3)) AS mean, (SELECT avg(l_quantity * l_quantity) FROM lineitem WHERE (l_linenumber > 3) = (k > 3)) AS square FROM (VALUES (1), (3), (4), (7)) t(k)")
def conditional_moments(spark, sf):
    """Moments of the quantity given each of several rows of evidence."""
    m, out = _factorized(spark, sf), []
    for k in (1.0, 3.0, 4.0, 7.0):
        given, _ = m.given(k=k)
        out.append((k, float(N.moments(given.root, 1)["q"]), float(N.moments(given.root, 2)["q"])))
    return one(spark, out, "k double, mean double, square double")


def _mixture(spark, sf) -> Model:
    """Made by hand with the nodes' own algebra: 0.3 of the rows of small quantity, 0.7 of all."""
    t = lines(spark, sf)
    low = t.where("q <= 20")
    part = lambda df, n: leaf(df, "q", MetaType.DISCRETE, PLAIN, n) * leaf(df, "k", MetaType.DISCRETE, PLAIN, n)
    n = t.count()
    return Model(N.assign_ids(0.3 * part(low, low.count()) + 0.7 * part(t, n)), n, spark)


_MIX = "(SELECT CAST(0 AS BIGINT) AS query_id, 0.3 * avg(CAST(l_quantity BETWEEN 10 AND 20 AS INTEGER)) FILTER (l_quantity <= 20) * avg(CAST(l_linenumber <= 3 AS INTEGER)) FILTER (l_quantity <= 20) + 0.7 * avg(CAST(l_quantity BETWEEN 10 AND 20 AS INTEGER)) * avg(CAST(l_linenumber <= 3 AS INTEGER)) AS selectivity, count(*) AS n FROM lineitem)"
_MIX_Q = [{"q": (10.0, 20.0), "k": (1.0, 3.0)}]


@query("mixture_by_algebra", f"SELECT query_id, selectivity, selectivity * n AS cardinality FROM {_MIX}")
def mixture_by_algebra(spark, sf):
    return _mixture(spark, sf).probability(query_frame(spark, _MIX_Q, ["q", "k"]))


@query("transformed_model", f"SELECT query_id, selectivity, selectivity * n AS cardinality, 4 AS leaves FROM {_MIX}")
def transformed_model(spark, sf):
    """Copied, nested, pruned, compressed, with rebuilt scopes, a limited fan-out: the same answers."""
    m = _mixture(spark, sf)
    twice = N.Sum(["q", "k"], [N.copy(m.root), N.copy(m.root)], weights=np.array([0.5, 0.5]))
    leaves = sum(isinstance(n, N.Leaf) for n in N.compress(N.copy(twice)).walk())
    root = N.assign_ids(N.rebuild_scopes(N.limit_fan_out(N.prune(N.compress(twice)), 2)))
    return Model(root, m.rows, spark).probability(query_frame(spark, _MIX_Q, ["q", "k"])).select("*", F.lit(leaves).alias("leaves"))


@query("structure_stats", "SELECT * FROM (VALUES ('nodes', CAST(7 AS BIGINT)), ('edges', 6), ('sum', 1), ('product', 2), ('leaf', 4), ('layers', 3), ('height', 3), ('depth_sum', 10)) t(what, n)")
def structure_stats(spark, sf):
    """Counts of a model's parts; its height from the generic bottom-up driver, the sum of depths from the top-down one."""
    root = _mixture(spark, sf).root
    s = N.stats(root)
    height = N.bottom_up(root, {N.Node: lambda n, below: 1 + max(below, default=0)})
    depth = N.top_down(root, {N.Node: lambda n, given: [min(given) + 1] * len(n.children)}, 0)
    out = [(k, int(s[k])) for k in ("nodes", "edges", "sum", "product", "leaf", "layers")] + [("height", int(height)), ("depth_sum", sum(min(g) for g in depth.values()))]
    return one(spark, out, "what string, n long")


@query("validation", "SELECT * FROM (VALUES ('good', CAST(0 AS BIGINT)), ('weights', 1), ('scope', 1)) t(what, faults)")
def validation(spark, sf):
    good = _mixture(spark, sf).root
    heavy, scope = N.copy(good), N.copy(good)
    heavy.weights = heavy.weights * 2
    scope.children[0].children.pop()
    return one(spark, [(k, len(N.validate(N.assign_ids(n)))) for k, n in (("good", good), ("weights", heavy), ("scope", scope))], "what string, faults long")


@query("text_round_trip", f"SELECT query_id, selectivity, selectivity * n AS cardinality FROM {_MIX}")
def text_round_trip(spark, sf):
    """A model read back from its text."""
    m = _mixture(spark, sf)
    return Model(from_text(as_text(m.root)), m.rows, spark).probability(query_frame(spark, _MIX_Q, ["q", "k"]))


@query("sql_export", "SELECT l_orderkey * 10 + l_linenumber AS row, count(*) OVER (PARTITION BY l_linenumber) * 1.0 / count(*) OVER () * count(*) OVER (PARTITION BY l_linenumber > 3, l_quantity) / count(*) OVER (PARTITION BY l_linenumber > 3) AS likelihood FROM lineitem")
def sql_export(spark, sf):
    """A model as an SQL expression over the rows' own columns, compiled by the engine."""
    return lines(spark, sf).select("row", as_column(_factorized(spark, sf).root).alias("likelihood"))


class _Even(N.Leaf):
    """A kind of leaf that the evaluation is taught: even numbers up to 50, equally likely."""

    kind = "even"


N.register(_Even, probability=lambda n, lo, hi, m: np.array([sum(a <= v <= b for v in range(2, 51, 2)) / 25 for a, b in zip(lo.get("q", np.full(m, -np.inf)), hi.get("q", np.full(m, np.inf)), strict=True)]), likelihood=lambda n, x, m: np.where((x["q"] % 2 == 0) & (x["q"] >= 2) & (x["q"] <= 50), 1 / 25, 0.0), moments=lambda n, k: {"q": sum(v**k for v in range(2, 51, 2)) / 25})


@query("registered_kind", "SELECT CAST(0 AS BIGINT) AS query_id, 6.0 / 25 * count(*) FILTER (l_linenumber <= 3) / count(*) AS selectivity, CAST(26 AS DOUBLE) AS mean, CAST(ln(1.0 / 25) AS DOUBLE) AS ll FROM lineitem")
def registered_kind(spark, sf):
    t = lines(spark, sf)
    root = N.assign_ids(_Even(["q"], lo=[], hi=[], pdf=[]) * leaf(t, "k", MetaType.DISCRETE, PLAIN, t.count()))
    lo, hi = {"q": np.array([10.0]), "k": np.array([1.0])}, {"q": np.array([20.0]), "k": np.array([3.0])}
    return one(spark, [(0, float(N.probability(root, lo, hi, 1)[0]), float(N.moments(root, 1)["q"]), float(N.log_likelihood(root, {"q": np.array([4.0])}, 1)[0]))], "query_id long, selectivity double, mean double, ll double")


@query("product_gradients", """WITH h AS (SELECT l_quantity AS v, count(*) * 1.0 / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1), k AS (SELECT l_linenumber AS v, count(*) * 1.0 / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1),
g AS (SELECT v, p, (coalesce(lead(p) OVER o, p) - coalesce(lag(p) OVER o, p)) / (coalesce(lead(v) OVER o, v) - coalesce(lag(v) OVER o, v)) AS s FROM h WINDOW o AS (ORDER BY v)),
j AS (SELECT v, p, (coalesce(lead(p) OVER o, p) - coalesce(lag(p) OVER o, p)) / (coalesce(lead(v) OVER o, v) - coalesce(lag(v) OVER o, v)) AS s FROM k WINDOW o AS (ORDER BY v))
SELECT l_orderkey * 10 + l_linenumber AS row, g.s * j.p AS q, j.s * g.p AS k FROM lineitem JOIN g ON g.v = l_quantity JOIN j ON j.v = l_linenumber""")
def product_gradients(spark, sf):
    return _product(spark, sf).gradients(lines(spark, sf), "row")


@query("sampled_shares", "SELECT 'q' AS attribute, TRUE AS close UNION ALL SELECT 'k', TRUE")
def sampled_shares(spark, sf):
    """Whether 20,000 draws from a model have its means within a twentieth of the spread."""
    m = _factorized(spark, sf)
    x = N.complete(m.root, {}, 20_000, np.random.default_rng(11))
    mean, var = N.moments(m.root, 1), N.variance(m.root)
    return one(spark, [(c, bool(abs(x[c].mean() - mean[c]) < 0.05 * math.sqrt(var[c]))) for c in ("q", "k")], "attribute string, close boolean")


@query("em_gaussians", """WITH r AS (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1),
e AS (SELECT x, n, 0.5 * exp(-pow(x - 10, 2) / 50) / (5 * sqrt(2 * pi())) AS a, 0.5 * exp(-pow(x - 40, 2) / 50) / (5 * sqrt(2 * pi())) AS b FROM r), w AS (SELECT x, n * a / (a + b) AS w, n * b / (a + b) AS u FROM e)
SELECT 0 AS child, sum(w) / sum(w + u) AS weight, sum(w * x) / sum(w) AS mean, sqrt(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2)) AS deviation FROM w UNION ALL SELECT 1, sum(u) / sum(w + u), sum(u * x) / sum(u), sqrt(sum(u * x * x) / sum(u) - pow(sum(u * x) / sum(u), 2)) FROM w""")
def em_gaussians(spark, sf):
    """One step of expectation maximisation on a mixture of two Gaussian leaves: weights, means and deviations."""
    root = 0.5 * Parametric(["q"], family="gaussian", a=10.0, b=5.0) + 0.5 * Parametric(["q"], family="gaussian", a=40.0, b=5.0)
    m = Model(N.assign_ids(root), 0, spark).em(lines(spark, sf), 1)
    return one(spark, [(i, float(w), float(c.a), float(c.b)) for i, (w, c) in enumerate(zip(m.root.weights, m.root.children, strict=True))], "child int, weight double, mean double, deviation double")


# --- trees over binary columns

_CHAIN = f"""{_FLAGS}, c AS (SELECT count(*) + 0.04 AS n, sum(r) + 0.02 AS r, sum(o) + 0.02 AS o, sum(q) + 0.02 AS q, sum(r * o) + 0.01 AS ro, sum(o * q) + 0.01 AS oq FROM f),
v AS (SELECT * FROM (VALUES (0), (1)) a(r), (VALUES (0), (1)) b(o), (VALUES (0), (1)) d(q)),
t AS (SELECT v.r, v.o, v.q, CASE WHEN v.r = 1 THEN c.r ELSE n - c.r END / n AS pr, CASE v.r * 2 + v.o WHEN 3 THEN ro WHEN 2 THEN c.r - ro WHEN 1 THEN c.o - ro ELSE n - c.r - c.o + ro END / CASE WHEN v.r = 1 THEN c.r ELSE n - c.r END AS po,
CASE v.o * 2 + v.q WHEN 3 THEN oq WHEN 2 THEN c.o - oq WHEN 1 THEN c.q - oq ELSE n - c.o - c.q + oq END / CASE WHEN v.o = 1 THEN c.o ELSE n - c.o END AS pq FROM v, c), j AS (SELECT r, o, q, pr * po * pq AS p FROM t)"""


def _chain(spark, sf) -> TreeLeaf:
    names = ["r", "o", "q"]
    return TreeLeaf(names, tree=C.ChowLiuTree.fit(_flags(spark, sf), names, parent=[-1, 0, 1]))


@query("tree_likelihood", f"WITH {_CHAIN} SELECT CAST(i AS BIGINT) AS row, (SELECT ln(sum(p)) FROM j WHERE coalesce(j.r = x.r, TRUE) AND coalesce(j.o = x.o, TRUE) AND coalesce(j.q = x.q, TRUE)) AS ll FROM (VALUES (0, 1, 0, 1), (1, NULL, 1, 0), (2, 0, NULL, 1), (3, 1, NULL, NULL)) x(i, r, o, q)")
def tree_likelihood(spark, sf):
    """Of rows with unknown cells, which are summed out along the tree."""
    rows = one(spark, [(0, 1.0, 0.0, 1.0), (1, None, 1.0, 0.0), (2, 0.0, None, 1.0), (3, 1.0, None, None)], "row long, r double, o double, q double")
    return Model(N.assign_ids(_chain(spark, sf)), 1, spark).log_likelihood(rows, "row")


@query("tree_probability", f"WITH {_CHAIN} SELECT CAST(0 AS BIGINT) AS query_id, sum(p) FILTER (r = 1 AND q = 0) AS p, sum(p) FILTER (r = 1) AS r, sum(p) FILTER (o = 1) AS o, sum(p) FILTER (q = 1) AS q FROM j")
def tree_probability(spark, sf):
    """The mass of a box, and the expectation of each column."""
    n = _chain(spark, sf)
    p = N.probability(n, {"r": np.array([1.0]), "q": np.array([0.0])}, {"r": np.array([1.0]), "q": np.array([0.0])}, 1)
    e = N.moments(n, 1)
    return one(spark, [(0, float(p[0]), *(float(e[c]) for c in ("r", "o", "q")))], "query_id long, p double, r double, o double, q double")


@query("tree_completion", f"WITH {_CHAIN} SELECT CAST(i AS BIGINT) AS row, CAST((SELECT r FROM j WHERE coalesce(j.r = x.r, TRUE) AND coalesce(j.q = x.q, TRUE) ORDER BY p DESC LIMIT 1) AS DOUBLE) AS r, CAST((SELECT o FROM j WHERE coalesce(j.r = x.r, TRUE) AND coalesce(j.q = x.q, TRUE) ORDER BY p DESC LIMIT 1) AS DOUBLE) AS o, CAST((SELECT q FROM j WHERE coalesce(j.r = x.r, TRUE) AND coalesce(j.q = x.q, TRUE) ORDER BY p DESC LIMIT 1) AS DOUBLE) AS q FROM (VALUES (0, 1, NULL), (1, NULL, 0), (2, 0, 1)) x(i, r, q)")
def tree_completion(spark, sf):
    rows = one(spark, [(0, 1.0, None, None), (1, None, None, 0.0), (2, 0.0, None, 1.0)], "row long, r double, o double, q double")
    return Model(N.assign_ids(_chain(spark, sf)), 1, spark).complete(rows, "row")


@query("tree_samples", "SELECT TRUE AS close")
def tree_samples(spark, sf):
    n = _chain(spark, sf)
    x = N.complete(n, {"o": np.ones(20_000)}, 20_000, np.random.default_rng(2))
    both = N.probability(n, {"o": np.array([1.0]), "r": np.array([1.0])}, {"o": np.array([1.0]), "r": np.array([1.0])}, 1)[0] / N.moments(n, 1)["o"]
    return one(spark, [(bool(abs(x["r"].mean() - both) < 0.02 and (x["o"] == 1).all()),)], "close boolean")


@query("binary_learner", "SELECT TRUE AS whole, TRUE AS close")
def binary_learner(spark, sf):
    """A model learned of binary columns: mass 1, and the joint distribution within a hundredth."""
    t = _flags(spark, sf)
    root = learn_binary(t, ["r", "o", "q"], Params(rows="mle", min_row_ratio=100))
    total, off = 0.0, 0.0
    n = t.count()
    seen = {(x.r, x.o, x.q): x["count"] / n for x in t.groupBy("r", "o", "q").count().collect()}  # 8 rows
    for r in (0, 1):
        for o in (0, 1):
            for q in (0, 1):
                at = {"r": np.array([float(r)]), "o": np.array([float(o)]), "q": np.array([float(q)])}
                p = float(N.probability(root, at, at, 1)[0])
                total, off = total + p, max(off, abs(p - seen.get((r, o, q), 0.0)))
    return one(spark, [(abs(total - 1) < 1e-6, off < 0.01)], "whole boolean, close boolean")


# --- maintenance


def _halves(spark, sf):
    t = lines(spark, sf)
    return t.where("row % 2 = 0"), t.where("row % 2 = 1"), t.where("row % 7 = 0")


@query("joint_update", f"SELECT query_id, (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN a AND b AND l_linenumber BETWEEN c AND d) * 1.0 / (SELECT count(*) FROM lineitem) AS selectivity, CAST((SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN a AND b AND l_linenumber BETWEEN c AND d) AS DOUBLE) AS cardinality FROM {_JOINT_SQL}")
def joint_update(spark, sf):
    """A joint leaf of half of the rows, the rest inserted, some inserted twice and deleted again."""
    half, rest, some = _halves(spark, sf)
    n = half.count()
    m = Model(N.assign_ids(joint_leaf(half, ["q", "k"], dict.fromkeys(["q", "k"], MetaType.DISCRETE), PLAIN, n)), n, spark)
    return update(update(update(m, rest), some), some, -1).probability(query_frame(spark, _JOINT_Q, ["q", "k"]))


@query("routed_update", f"""WITH {_FACT}, p AS (SELECT CAST(0 AS BIGINT) AS query_id, sum((SELECT count(*) FROM lineitem WHERE (l_linenumber > 3) = side AND l_linenumber <= 5) * 1.0 / (SELECT count(*) FROM lineitem) * (SELECT count(*) FROM lineitem WHERE (l_linenumber > 3) = side AND l_quantity BETWEEN 10 AND 20) / n) AS selectivity FROM g)
SELECT query_id, selectivity, selectivity * (SELECT count(*) FROM lineitem) AS cardinality FROM p""")
def routed_update(spark, sf):
    """A factorized model of half of the rows; the rest is routed by the ranges of its split."""
    half, rest, some = _halves(spark, sf)
    n = half.count()
    pieces = [leaf(s, "q", MetaType.DISCRETE, PLAIN, s.count()) for s in (half.where("k <= 3"), half.where("k > 3"))]
    split = N.Split(["q"], pieces, boxes=[{"k": (-math.inf, 3.0)}, {"k": (4.0, math.inf)}], weights=np.array([p.rows / n for p in pieces]), rows=float(n))
    m = Model(N.assign_ids(split.given(leaf(half, "k", MetaType.DISCRETE, PLAIN, n))), n, spark)
    return update(update(update(m, rest), some), some, -1).probability(query_frame(spark, [{"q": (10.0, 20.0), "k": (-math.inf, 5.0)}], ["q", "k"]))


@query("centre_update", "WITH s AS (SELECT l_quantity, pow(l_quantity - 10, 2) + pow(l_linenumber - 4, 2) <= pow(l_quantity - 40, 2) + pow(l_linenumber - 4, 2) AS a FROM lineitem) SELECT 0 AS child, count(*) FILTER (a) * 1.0 / count(*) AS weight, avg(l_quantity) FILTER (a) AS mean FROM s UNION ALL SELECT 1, count(*) FILTER (NOT a) * 1.0 / count(*), avg(l_quantity) FILTER (NOT a) FROM s")
def centre_update(spark, sf):
    """A mixture of two clusters of half of the rows; the rest is routed to the nearest centre."""
    half, rest, some = _halves(spark, sf)
    centres = [np.array([10.0, 4.0]), np.array([40.0, 4.0])]
    parts = R.nearest_centre(half, ["q", "k"], centres)
    kids = []
    for i in (0, 1):
        p = parts.where(F.col("part") == i)
        n = p.count()
        kids.append(leaf(p, "q", MetaType.DISCRETE, PLAIN, n) * leaf(p, "k", MetaType.DISCRETE, PLAIN, n))
    n = half.count()
    root = N.Sum(["q", "k"], kids, weights=np.array([c.children[0].rows / n for c in kids]), centres=centres, rows=float(n))
    m = update(update(update(Model(N.assign_ids(root), n, spark), rest), some), some, -1)
    return one(spark, [(i, float(w), float(N.moments(c, 1)["q"])) for i, (w, c) in enumerate(zip(m.root.weights, m.root.children, strict=True))], "child int, weight double, mean double")


# --- workloads


@query("q_error_percentiles", "WITH q AS (SELECT * FROM (VALUES (0, 10, 20, 1, 3), (1, 5, 30, 2, 4), (2, 1, 50, 1, 1), (3, 40, 50, 5, 7), (4, 1, 9, 1, 7)) t(i, a, b, c, d)), n AS (SELECT count(*) AS n FROM lineitem), e AS (SELECT greatest((SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN a AND b) * 1.0 / n * (SELECT count(*) FROM lineitem WHERE l_linenumber BETWEEN c AND d), 1) AS e, greatest((SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN a AND b AND l_linenumber BETWEEN c AND d), 1.0) AS t FROM q, n), r AS (SELECT greatest(e, t) / least(e, t) AS r FROM e) SELECT quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.9) AS p90, quantile_cont(r, 0.95) AS p95, quantile_cont(r, 0.99) AS p99, max(r) AS worst FROM r")
def q_error_percentiles(spark, sf):
    boxes = [{"q": (a, b), "k": (c, d)} for a, b, c, d in ((10.0, 20.0, 1.0, 3.0), (5.0, 30.0, 2.0, 4.0), (1.0, 50.0, 1.0, 1.0), (40.0, 50.0, 5.0, 7.0), (1.0, 9.0, 1.0, 7.0))]
    return error_percentiles(q_errors(_product(spark, sf).probability(query_frame(spark, boxes, ["q", "k"])), with_truth(lines(spark, sf), boxes)))
