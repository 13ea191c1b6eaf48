"""The queries over the driver's tables, one for each operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.prefix import ecdf
from statloom.functions.rdc import rdc_matrix, sample_matrix
from statloom.operators import columns as C
from statloom.operators import families as P
from statloom.operators import histograms as H
from statloom.operators import predicates as Q
from statloom.operators import rows as R
from statloom.plans import nodes as N
from statloom.plans.learn import Params
from statloom.plans.learn import histogram_leaf as leaf
from statloom.plans.model import Model, q_errors
from statloom.sources.context import Context, MetaType, domains, encode_strings
from statloom.sources.workload import query_frame, range_queries, with_truth
from statloom.streaming.maintain import update

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def ranges(spark: SparkSession) -> DataFrame:
    """Ranges inside, across, outside the domain, points, one inverted, open ends."""
    inf = float("inf")
    return spark.createDataFrame([(0, 1.0, 50.0), (1, 10.0, 20.0), (2, 10.2, 10.4), (3, -inf, 5.0), (4, 45.0, inf), (5, 60.0, 70.0), (6, 20.0, 10.0), (7, 7.0, 7.0)], "query_id long, lo double, hi double")


_RANGES = "(VALUES (0, 1.0::DOUBLE, 50.0::DOUBLE), (1, 10.0, 20.0), (2, 10.2, 10.4), (3, '-inf'::DOUBLE, 5.0), (4, 45.0, 'inf'::DOUBLE), (5, 60.0, 70.0), (6, 20.0, 10.0), (7, 7.0, 7.0)) q(query_id, qlo, qhi)"
_HIST = """c AS (SELECT CAST(l_quantity AS DOUBLE) AS v, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1),
h AS (SELECT coalesce(lag(v) OVER o + (v - lag(v) OVER o) / 2, v - 0.1) AS lo, coalesce(v + (lead(v) OVER o - v) / 2, v + 0.1) AS hi, v, n,
        (n + 1.0) / (sum(n) OVER () + count(*) OVER ()) AS pdf,
        sum(n + 1.0) OVER (ORDER BY v) / (sum(n) OVER () + count(*) OVER ()) AS cdf,
        CAST(sum(n) OVER () AS DOUBLE) / (SELECT count(*) FROM lineitem) AS non_null
      FROM c WINDOW o AS (ORDER BY v))"""


@query("context_domains", "SELECT attr_id, name, min(v) AS lo, max(v) AS hi, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(v) AS BIGINT) AS n_null, CAST(count(DISTINCT v) AS BIGINT) AS ndv FROM (SELECT 0 AS attr_id, 'l_quantity' AS name, CAST(l_quantity AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 1, 'l_extendedprice', CAST(l_extendedprice AS DOUBLE) FROM lineitem UNION ALL SELECT 2, 'l_discount', CAST(l_discount AS DOUBLE) FROM lineitem) GROUP BY 1, 2")
def context_domains(spark, sf):
    return domains(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("string_codes", "SELECT code, l_returnflag AS value, count(*) AS n FROM (SELECT l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code FROM lineitem) GROUP BY 1, 2")
def string_codes(spark, sf):
    coded, _ = encode_strings(read(spark, sf, "lineitem"), "l_returnflag", "code")
    return coded.groupBy("code", F.col("l_returnflag").alias("value")).agg(F.count("*").alias("n"))


@query("copula_ecdf", "SELECT DISTINCT CAST(l_extendedprice AS DOUBLE) AS v, cume_dist() OVER (ORDER BY l_extendedprice) AS u FROM lineitem WHERE l_extendedprice IS NOT NULL")
def copula_ecdf(spark, sf):
    return ecdf(read(spark, sf, "lineitem"), "l_extendedprice")


@query("histogram_leaf", f"WITH {_HIST} SELECT * FROM h")
def histogram_leaf(spark, sf):
    return H.histogram(read(spark, sf, "lineitem"), "l_quantity")


@query("histogram_range", f"WITH {_HIST} SELECT CAST(query_id AS BIGINT) AS query_id, least(coalesce(sum(pdf * non_null), 0.0), 1.0) AS p FROM {_RANGES} LEFT JOIN h ON qhi > lo AND qlo <= hi AND qlo <= qhi GROUP BY 1")
def histogram_range(spark, sf):
    return Q.range_probability(H.histogram(read(spark, sf, "lineitem"), "l_quantity"), ranges(spark))


@query("histogram_point", f"WITH {_HIST} SELECT CAST(query_id AS BIGINT) AS query_id, CASE WHEN x IS NULL THEN 1.0 ELSE coalesce(pdf * non_null, 0.0) END AS p FROM (VALUES (0, 7.0::DOUBLE), (1, 7.4), (2, 99.0), (3, NULL)) q(query_id, x) LEFT JOIN h ON x > lo AND x <= hi")
def histogram_point(spark, sf):
    q = spark.createDataFrame([(0, 7.0), (1, 7.4), (2, 99.0), (3, None)], "query_id long, x double")
    return Q.point_probability(H.histogram(read(spark, sf, "lineitem"), "l_quantity"), q)


@query("histogram_auto", """WITH v AS (SELECT CAST(o_totalprice AS DOUBLE) AS v FROM orders WHERE o_totalprice IS NOT NULL),
s AS (SELECT min(v) AS a, max(v) AS b, count(*) AS n, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM v),
k AS (SELECT a, b, n, CAST(greatest(ceil((b - a) / (2 * iqr / pow(n, 1.0 / 3))), 1) AS INTEGER) AS k FROM s),
g AS (SELECT *, CAST(unnest(range(k)) AS INTEGER) AS bin FROM k),
c AS (SELECT CAST(least(floor((v - a) / (b - a) * k), k - 1) AS INTEGER) AS bin, count(*) AS c FROM v, k GROUP BY 1)
SELECT g.bin, a + g.bin * ((b - a) / k) AS lo, a + (g.bin + 1) * ((b - a) / k) AS hi, coalesce(c, 0) AS n, CAST(coalesce(c, 0) AS DOUBLE) / n AS pdf FROM g LEFT JOIN c ON g.bin = c.bin""")
def histogram_auto(spark, sf):
    return H.width_bins(read(spark, sf, "orders"), "o_totalprice")


@query("joint_histogram", "SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity, count(*) AS n, count(*) * 1.0 / (SELECT count(*) FROM lineitem WHERE l_linenumber IS NOT NULL AND l_quantity IS NOT NULL) AS pdf FROM lineitem WHERE l_linenumber IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1, 2")
def joint_histogram(spark, sf):
    return H.cells(read(spark, sf, "lineitem"), ["l_linenumber", "l_quantity"])


def _boxes(spark):
    return spark.createDataFrame([(0, 1.0, 3.0, 10.0, 20.0), (1, 2.0, 2.0, 1.0, 50.0), (2, 8.0, 9.0, 1.0, 50.0)], "query_id long, l_linenumber_lo double, l_linenumber_hi double, l_quantity_lo double, l_quantity_hi double")


_BOX_SQL = "SELECT CAST(q AS BIGINT) AS query_id, (SELECT count(*) FROM lineitem WHERE l_linenumber BETWEEN a AND b AND l_quantity BETWEEN c AND d) * 1.0 / (SELECT count(*) FROM lineitem) AS p FROM (VALUES (0, 1, 3, 10, 20), (1, 2, 2, 1, 50), (2, 8, 9, 1, 50)) t(q, a, b, c, d)"


@query("joint_box", _BOX_SQL)
def joint_box(spark, sf):
    columns = ["l_linenumber", "l_quantity"]
    return Q.box_probability(H.cells(read(spark, sf, "lineitem"), columns), _boxes(spark), columns)


@query("joint_box_by_corners", _BOX_SQL)
def joint_box_by_corners(spark, sf):
    columns = ["l_linenumber", "l_quantity"]
    return Q.box_probability_by_corners(H.cumulated_cells(H.cells(read(spark, sf, "lineitem"), columns), columns), _boxes(spark), columns)


@query("common_values", """WITH c AS (SELECT CAST(p_size AS DOUBLE) AS v, count(*) AS n FROM part WHERE p_size IS NOT NULL GROUP BY 1),
m AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS r FROM c),
d AS (SELECT v, n, CAST(least(floor((sum(n) OVER (ORDER BY v) - n) * 8 / sum(n) OVER ()), 7) AS INTEGER) AS bin FROM m WHERE r > 5)
SELECT 'common' AS kind, CAST(r - 1 AS INTEGER) AS bin, v AS lo, v AS hi, n FROM m WHERE r <= 5
UNION ALL SELECT 'depth', bin, min(v), max(v), CAST(sum(n) AS BIGINT) FROM d GROUP BY bin""")
def common_values(spark, sf):
    return H.common_and_depth_bins(read(spark, sf, "part"), "p_size", 5, 8)


_EXACT = "e AS (SELECT CAST(l_quantity AS DOUBLE) AS v, count(*) * 1.0 / (SELECT count(*) FROM lineitem) AS p FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1)"


@query("exact_leaf", f"WITH {_EXACT} SELECT v, p, sum(p) OVER (ORDER BY v) AS cum FROM e")
def exact_leaf(spark, sf):
    return H.exact_leaf(read(spark, sf, "lineitem"), "l_quantity")


@query("exact_stats", "SELECT 1 - count(l_quantity) * 1.0 / count(*) AS p_null, avg(l_quantity) AS mean, avg(1.0 / l_quantity) AS inv_mean, avg(l_quantity * l_quantity) AS sq_mean, avg(1.0 / (l_quantity * l_quantity)) AS inv_sq_mean FROM lineitem")
def exact_stats(spark, sf):
    return H.exact_stats(read(spark, sf, "lineitem"), "l_quantity")


@query("interval_probability", f"WITH {_EXACT} SELECT CAST(query_id AS BIGINT) AS query_id, coalesce((SELECT sum(p) FROM e WHERE CASE query_id WHEN 0 THEN (v > 5 AND v <= 10) OR (v >= 20 AND v < 22) WHEN 1 THEN v >= 50 ELSE v > 50 END), 0) AS p FROM (VALUES (0), (1), (2)) q(query_id)")
def interval_probability(spark, sf):
    inf = float("inf")
    q = spark.createDataFrame([(0, [(5.0, 10.0, False, True), (20.0, 22.0, True, False)]), (1, [(50.0, inf, True, False)]), (2, [(50.0, inf, False, False)])], "query_id long, intervals array<struct<lo:double,hi:double,lo_inc:boolean,hi_inc:boolean>>")
    return Q.interval_probability(H.exact_leaf(read(spark, sf, "lineitem"), "l_quantity"), q)


@query("in_list", f"WITH {_EXACT}, r AS (SELECT CAST(query_id AS BIGINT) AS query_id, coalesce((SELECT sum(p) FROM e WHERE list_contains(vs, v)), 0) AS p FROM (VALUES (0, [1.0, 2.0, 2.0, 77.0]::DOUBLE[]), (1, [99.0]::DOUBLE[])) q(query_id, vs)) SELECT query_id, p, CASE WHEN p > 0 THEN ln(p) END AS log_p FROM r")
def in_list(spark, sf):
    q = spark.createDataFrame([(0, [1.0, 2.0, 2.0, 77.0]), (1, [99.0])], "query_id long, values array<double>")
    return Q.in_list_probability(H.exact_leaf(read(spark, sf, "lineitem"), "l_quantity"), q)


@query("not_null", "SELECT count(l_quantity) * 1.0 / count(*) AS p FROM lineitem")
def not_null(spark, sf):
    return Q.not_null_probability(read(spark, sf, "lineitem"), "l_quantity")


@query("range_expectation", f"WITH {_EXACT} SELECT CAST(query_id AS BIGINT) AS query_id, coalesce(sum(p * v), 0.0) AS e FROM {_RANGES} LEFT JOIN e ON v BETWEEN qlo AND qhi GROUP BY 1")
def range_expectation(spark, sf):
    return Q.range_expectation(H.exact_leaf(read(spark, sf, "lineitem"), "l_quantity"), ranges(spark))


@query("range_expectation_inverse", f"WITH {_EXACT} SELECT CAST(query_id AS BIGINT) AS query_id, coalesce(sum(p / v), 0.0) AS e FROM {_RANGES} LEFT JOIN e ON v BETWEEN qlo AND qhi AND v <> 0 GROUP BY 1")
def range_expectation_inverse(spark, sf):
    return Q.range_expectation(H.exact_leaf(read(spark, sf, "lineitem"), "l_quantity"), ranges(spark), power=-1)


@query("distinct_in_range", f"WITH {_EXACT} SELECT CAST(query_id AS BIGINT) AS query_id, v FROM {_RANGES} JOIN e ON v BETWEEN qlo AND qhi")
def distinct_in_range(spark, sf):
    return Q.distinct_in_range(H.exact_leaf(read(spark, sf, "lineitem"), "l_quantity"), ranges(spark))


_ACCT = "s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer), b AS (SELECT CAST(least(floor((c_acctbal - a) / (b - a) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM customer, s GROUP BY 1), m AS (SELECT a + (bin + 0.5) * ((b - a) / 20) AS x, n / ((b - a) / 20) AS y FROM b, s), pt AS (SELECT * FROM m UNION ALL SELECT min(x) - 1e-8, 0 FROM m UNION ALL SELECT max(x) + 1e-8, 0 FROM m), sg AS (SELECT x AS x0, lead(x) OVER (ORDER BY x) AS x1, y AS y0, lead(y) OVER (ORDER BY x) AS y1 FROM pt), ar AS (SELECT sum((x1 - x0) * (y0 + y1) / 2) AS area, max(x1) - min(x0) AS rg FROM sg WHERE x1 IS NOT NULL), pw AS (SELECT x0, x1, 0.9 * y0 / area + 0.1 / rg AS y0, 0.9 * y1 / area + 0.1 / rg AS y1 FROM sg, ar WHERE x1 IS NOT NULL)"


@query("piecewise_range", f"WITH {_ACCT} SELECT CAST(query_id AS BIGINT) AS query_id, coalesce(sum((least(qhi, x1) - greatest(qlo, x0)) * ((y0 + (y1 - y0) / (x1 - x0) * (greatest(qlo, x0) - x0)) + (y0 + (y1 - y0) / (x1 - x0) * (least(qhi, x1) - x0))) / 2), 0.0) AS p FROM (VALUES (0, 0.0::DOUBLE, 1000.0::DOUBLE), (1, -900.0, 9000.0)) q(query_id, qlo, qhi) LEFT JOIN pw ON qhi > x0 AND qlo < x1 GROUP BY 1")
def piecewise_range(spark, sf):
    q = spark.createDataFrame([(0, 0.0, 1000.0), (1, -900.0, 9000.0)], "query_id long, lo double, hi double")
    return Q.piecewise_range_probability(H.piecewise(H.width_bins(read(spark, sf, "customer"), "c_acctbal", 20)), q)


@query("binary_joint", "SELECT q::DOUBLE AS quality, t::DOUBLE AS toxic, (SELECT count(*) FROM labels WHERE quality = q AND toxic = t) AS n, (SELECT count(*) FROM labels WHERE quality = q AND toxic = t) * 1.0 / (SELECT count(*) FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) AS pdf FROM (VALUES (0), (1)) a(q), (VALUES (0), (1)) b(t)")
def binary_joint(spark, sf):
    return H.joint_table(read(spark, sf, "labels"), ["quality", "toxic"])


@query("binary_conditioning", """WITH s AS (SELECT 'quality' AS c, quality AS side, count(*) AS n, sum(toxic) AS o FROM labels GROUP BY quality UNION ALL SELECT 'toxic', toxic, count(*), sum(quality) FROM labels GROUP BY toxic),
p AS (SELECT *, (o + 0.1) / (n + 0.2) AS p FROM s)
SELECT c AS column, sum(n * ((o * ln(p) + (n - o) * ln(1 - p)) / n + ln(n * 1.0 / (SELECT count(*) FROM labels)))) / (SELECT count(*) FROM labels) AS score FROM p GROUP BY c""")
def binary_conditioning(spark, sf):
    return R.binary_conditioning_scores(read(spark, sf, "labels"), ["quality", "toxic"])


@query("mle_families", """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi, avg(CASE WHEN value > 0 THEN ln(value) END) AS lm, stddev_pop(CASE WHEN value > 0 THEN ln(value) END) AS lsd FROM events),
g AS (SELECT *, ln(m) - lm AS gap FROM s), k AS (SELECT *, (3 - gap + sqrt((gap - 3) * (gap - 3) + 24 * gap)) / (12 * gap) AS shape FROM g)
SELECT 'gaussian' AS family, m AS a, sd AS b FROM k UNION ALL SELECT 'lognormal', lm, lsd FROM k WHERE lo > 0 UNION ALL SELECT 'exponential', 1 / m, NULL FROM k WHERE lo >= 0
UNION ALL SELECT 'gamma', shape, shape / m FROM k WHERE lo > 0 AND gap > 0 UNION ALL SELECT 'uniform', lo, hi FROM k""")
def mle_families(spark, sf):
    return P.fit(read(spark, sf, "events"), "value")


@query("mle_categorical", "SELECT o_orderstatus AS value, count(*) * 1.0 / (SELECT count(o_orderstatus) FROM orders) AS p FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def mle_categorical(spark, sf):
    return P.fit_categorical(read(spark, sf, "orders"), "o_orderstatus")


@query("mle_multivariate", "SELECT 'p_size' AS i, 'p_retailprice' AS j, avg(p_size) AS mean_i, avg(p_retailprice) AS mean_j, covar_samp(p_size, p_retailprice) AS cov FROM part UNION ALL SELECT 'p_size', 'p_size', avg(p_size), avg(p_size), var_samp(p_size) FROM part UNION ALL SELECT 'p_retailprice', 'p_retailprice', avg(p_retailprice), avg(p_retailprice), var_samp(p_retailprice) FROM part")
def mle_multivariate(spark, sf):
    return P.fit_multivariate(read(spark, sf, "part"), ["p_size", "p_retailprice"])


@query("gaussian_log_density", "WITH s AS (SELECT avg(value) AS a, stddev_pop(value) AS b FROM events) SELECT event_id, -((value - a) * (value - a)) / (2 * b * b) - ln(b * sqrt(2 * pi())) AS ll FROM events, s")
def gaussian_log_density(spark, sf):
    e = read(spark, sf, "events")
    s = e.agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("b")).first()
    return e.select("event_id", P.log_density("gaussian", F.col("value"), s.a, s.b).alias("ll"))


@query("equal_frequency", "WITH c AS (SELECT CAST(l_quantity AS DOUBLE) AS v, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT v, n, CAST(least(floor((sum(n) OVER (ORDER BY v) - n) * 4 / sum(n) OVER ()), 3) AS INTEGER) AS bin FROM c) SELECT bin, min(v) AS lo, max(v) AS hi, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY bin")
def equal_frequency(spark, sf):
    return R.equal_frequency_cuts(read(spark, sf, "lineitem"), "l_quantity", 4)


@query("median_split", "WITH m AS (SELECT quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem), s AS (SELECT CAST(l_extendedprice >= m AS INTEGER) AS part, l_extendedprice FROM lineitem, m) SELECT part, count(*) AS n, count(*) * 1.0 / (SELECT count(*) FROM lineitem) AS share FROM s GROUP BY part")
def median_split(spark, sf):
    return R.part_shares(R.median_split(read(spark, sf, "lineitem"), "l_extendedprice")[0])


@query("interval_entropy", "WITH c AS (SELECT l_linenumber AS v, count(*) AS n, CAST(row_number() OVER (ORDER BY l_linenumber) - 1 AS INTEGER) AS r FROM lineitem GROUP BY 1) SELECT a.r AS i, b.r + 1 AS j, log2(sum(c.n)) - sum(c.n * log2(c.n)) / sum(c.n) AS h FROM c a JOIN c b ON b.r >= a.r JOIN c ON c.r BETWEEN a.r AND b.r GROUP BY 1, 2")
def interval_entropy(spark, sf):
    return R.interval_entropies(read(spark, sf, "lineitem"), "l_linenumber")


@query("nearest_centre", "WITH s AS (SELECT CASE WHEN (p_size - 10.0) * (p_size - 10.0) + (p_retailprice - 1000.0) * (p_retailprice - 1000.0) <= (p_size - 40.0) * (p_size - 40.0) + (p_retailprice - 1500.0) * (p_retailprice - 1500.0) THEN 0 ELSE 1 END AS part FROM part) SELECT part, count(*) AS n, count(*) * 1.0 / (SELECT count(*) FROM part) AS share FROM s GROUP BY part")
def nearest_centre(spark, sf):
    return R.part_shares(R.nearest_centre(read(spark, sf, "part"), ["p_size", "p_retailprice"], [np.array([10.0, 1000.0]), np.array([40.0, 1500.0])]))


@query("kmeans_split")
def kmeans_split(spark, sf):
    return R.part_shares(R.kmeans_split(read(spark, sf, "part"), ["p_size", "p_retailprice"])[0])


@query("gmm_split")
def gmm_split(spark, sf):
    return R.part_shares(R.gmm_split(read(spark, sf, "part"), ["p_size", "p_retailprice"])[0])


@query("density_split", """WITH s AS (SELECT s_suppkey AS row, s_acctbal / 100 AS x FROM supplier), c AS (SELECT a.row, a.x FROM s a JOIN s b ON abs(a.x - b.x) <= 2 GROUP BY 1, 2 HAVING count(*) >= 3),
g AS (SELECT row, x, sum(CAST(coalesce(x - p > 2, FALSE) AS INTEGER)) OVER (ORDER BY x, row) AS g FROM (SELECT row, x, lag(x) OVER (ORDER BY x, row) AS p FROM c)), l AS (SELECT row, x, min(row) OVER (PARTITION BY g) AS part FROM g)
SELECT s.row, min(l.part) AS part FROM s LEFT JOIN l ON abs(s.x - l.x) <= 2 AND (s.row = l.row OR s.row NOT IN (SELECT row FROM l)) GROUP BY 1""")
def density_split(spark, sf):
    return R.density_split(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("row"), (F.col("s_acctbal") / 100).alias("x")), ["x"], 2.0, 3)


_FLAGS = "f AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS r, CAST(l_linestatus = 'O' AS INTEGER) AS o, CAST(l_quantity > 25 AS INTEGER) AS q FROM lineitem)"


def _flags(spark, sf):
    return read(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("r"), (F.col("l_linestatus") == "O").cast("int").alias("o"), (F.col("l_quantity") > 25).cast("int").alias("q"))


@query("cooccurrence", f"WITH {_FLAGS} SELECT 'r' AS i, 'r' AS j, CAST(sum(r) AS BIGINT) AS c, count(*) AS n FROM f UNION ALL SELECT 'r', 'o', CAST(sum(r * o) AS BIGINT), count(*) FROM f UNION ALL SELECT 'r', 'q', CAST(sum(r * q) AS BIGINT), count(*) FROM f UNION ALL SELECT 'o', 'o', CAST(sum(o) AS BIGINT), count(*) FROM f UNION ALL SELECT 'o', 'q', CAST(sum(o * q) AS BIGINT), count(*) FROM f UNION ALL SELECT 'q', 'q', CAST(sum(q) AS BIGINT), count(*) FROM f")
def cooccurrence(spark, sf):
    return C.cooccurrences(_flags(spark, sf), ["r", "o", "q"])


def _mi_sql(i: str, j: str) -> str:
    cell = {(1, 1): "c", (1, 0): "ci - c", (0, 1): "cj - c", (0, 0): "n - ci - cj + c"}
    p = {1: "(ci + 0.02) / (n + 0.04)", 0: "(1 - (ci + 0.02) / (n + 0.04))"}
    q = {1: "(cj + 0.02) / (n + 0.04)", 0: "(1 - (cj + 0.02) / (n + 0.04))"}
    terms = " + ".join(f"(({e}) + 0.01) / (n + 0.04) * ln((({e}) + 0.01) / (n + 0.04) / ({p[a]} * {q[b]}))" for (a, b), e in cell.items())
    return f"SELECT '{i}' AS i, '{j}' AS j, {terms} AS mi FROM (SELECT sum({i} * {j}) AS c, sum({i}) AS ci, sum({j}) AS cj, count(*) AS n FROM f)"


@query("mutual_information", f"WITH {_FLAGS} " + " UNION ALL ".join(_mi_sql(i, j) for i, j in (("r", "o"), ("r", "q"), ("o", "q"))))
def mutual_information(spark, sf):
    return C.mutual_information(_flags(spark, sf), ["r", "o", "q"])


_TREE_SQL = f"""WITH {_FLAGS}, c AS (SELECT count(*) + 0.04 AS n, sum(r) + 0.02 AS r, sum(o) + 0.02 AS o, sum(q) + 0.02 AS q, sum(r * o) + 0.01 AS ro, sum(r * q) + 0.01 AS rq, sum(o * q) + 0.01 AS oq FROM f),
b AS (SELECT * FROM (VALUES ('r', 'o'), ('r', 'q'), ('o', 'q')) p(i, j), (VALUES (0), (1)) x(u), (VALUES (0), (1)) y(v)),
k AS (SELECT i, j, u, v, n, CASE i WHEN 'r' THEN r ELSE o END AS a, CASE j WHEN 'o' THEN o ELSE q END AS d, CASE WHEN i = 'o' THEN oq WHEN j = 'o' THEN ro ELSE rq END AS e FROM b, c),
l AS (SELECT i, j, u, v, CASE u WHEN 1 THEN a ELSE n - a END / n AS pi, CASE v WHEN 1 THEN d ELSE n - d END / n AS pj, CASE u * 2 + v WHEN 3 THEN e WHEN 2 THEN a - e WHEN 1 THEN d - e ELSE n - a - d + e END / n AS p FROM k),
m AS (SELECT i, j, sum(p * ln(p / (pi * pj))) AS mi FROM l GROUP BY 1, 2),
w AS (SELECT max(mi) FILTER (i = 'r' AND j = 'o') AS ro, max(mi) FILTER (i = 'r' AND j = 'q') AS rq, max(mi) FILTER (i = 'o') AS oq FROM m),
g AS (SELECT CASE WHEN ro >= rq OR oq <= rq THEN CASE WHEN ro >= rq THEN 'r' WHEN oq > ro THEN 'q' ELSE 'r' END ELSE CASE WHEN oq > ro THEN 'q' ELSE 'r' END END AS o_parent, CASE WHEN ro >= rq THEN CASE WHEN oq > rq THEN 'o' ELSE 'r' END ELSE 'r' END AS q_parent FROM w)
SELECT 'r' AS child, CAST(NULL AS VARCHAR) AS parent, ln(CASE y.v WHEN 1 THEN r ELSE n - r END / n) AS log_factor, x.u AS parent_value, y.v AS value FROM c, (VALUES (0), (1)) x(u), (VALUES (0), (1)) y(v)
UNION ALL SELECT 'o', 'r', ln(p / pi), u, v FROM l, g WHERE i = 'r' AND j = 'o' AND o_parent = 'r' UNION ALL SELECT 'o', 'q', ln(p / pj), v, u FROM l, g WHERE i = 'o' AND o_parent = 'q'
UNION ALL SELECT 'q', 'r', ln(p / pi), u, v FROM l, g WHERE i = 'r' AND j = 'q' AND q_parent = 'r' UNION ALL SELECT 'q', 'o', ln(p / pi), u, v FROM l, g WHERE i = 'o' AND q_parent = 'o'"""


@query("chow_liu_tree", _TREE_SQL)
def chow_liu_tree(spark, sf):
    t = C.ChowLiuTree.fit(_flags(spark, sf), ["r", "o", "q"])
    return spark.createDataFrame([(c, t.columns[p] if p >= 0 else None, float(f[u, v]), u, v) for c, p, f in zip(t.columns, t.parent, t.log_factor, strict=True) for u in (0, 1) for v in (0, 1)], "child string, parent string, log_factor double, parent_value int, value int")


@query("stability_statistic", """WITH m AS (SELECT avg(l_quantity) AS m, var_pop(l_quantity) AS v, count(*) AS n FROM lineitem), g AS (SELECT l_extendedprice AS z, sum(l_quantity - m) AS r, count(*) AS k FROM lineitem, m GROUP BY 1),
c AS (SELECT sum(r) OVER (ORDER BY z) AS cr, sum(k) OVER (ORDER BY z) AS ck FROM g), t AS (SELECT cr, ck * 1.0 / n AS t, n, v, greatest(0.1 * n, 10) / n AS lo FROM c, m)
SELECT coalesce(max(cr * cr / (n * v) / (t * (1 - t))) FILTER (t >= lo AND t <= 1 - lo), 0) AS statistic, max(n) AS n FROM t""")
def stability_statistic(spark, sf):
    return C.stability_statistic(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


def derived(spark, sf, *more) -> DataFrame:
    """Columns of strong, middle and no dependence, after more of the table."""
    return read(spark, sf, "lineitem").select(*more, (F.col("l_quantity") % 10).alias("a"), (F.col("l_quantity") % 10 + F.pmod(F.col("l_partkey"), F.lit(10)).between(0, 0).cast("int")).alias("b"), (F.col("l_quantity") % 10 + F.pmod(F.col("l_partkey"), F.lit(10))).cast("double").alias("c"), F.col("l_linenumber").cast("double").alias("d"), (F.col("l_discount") * 100).alias("e"))


_DERIVED = "d AS (SELECT l_quantity % 10 AS a, l_quantity % 10 + CAST(l_partkey % 10 = 0 AS INTEGER) AS b, l_quantity % 10 + l_partkey % 10 AS c, l_linenumber AS d, l_discount * 100 AS e FROM lineitem)"
_META = dict.fromkeys("abcde", MetaType.DISCRETE)


@query("rdc_matrix")
def rdc(spark, sf):
    names = list("abcde")
    m = rdc_matrix(sample_matrix(derived(spark, sf), names), [True] * 5)
    return spark.createDataFrame([(names[i], names[j], float(m[i, j])) for i in range(5) for j in range(i)], "i string, j string, rdc double")


def fitted(spark, sf) -> Model:
    """A model of the derived columns, learned anew."""
    table = derived(spark, sf)
    return Model.fit(table, Context.of(table, list("abcde"), _META), Params())


@query("learned_structure")
def learned_structure(spark, sf):
    return spark.createDataFrame([(n.id, n.kind, list(n.scope), len(n.children)) for n in fitted(spark, sf).root.walk()], "id int, kind string, scope array<string>, children int")


@query("cardinalities")
def cardinalities(spark, sf):
    """The flagship: estimates of a range workload from the learned model, beside the exact counts."""
    table = derived(spark, sf)
    boxes = range_queries(table, list("abcde"), 60)
    return q_errors(fitted(spark, sf).probability(query_frame(spark, boxes, list("abcde"))), with_truth(table, boxes))


_TRUTH = [{"a": (2.0, 5.0)}, {"a": (2.0, 5.0), "d": (1.0, 2.0)}, {"a": (3.0, 3.0), "b": (3.0, 4.0), "c": (5.0, 9.0)}, {"e": (11.0, 20.0)}]


@query("exact_cardinalities", f"WITH {_DERIVED} SELECT CAST(0 AS BIGINT) AS query_id, count(*) AS truth FROM d WHERE a BETWEEN 2 AND 5 UNION ALL SELECT 1, count(*) FROM d WHERE a BETWEEN 2 AND 5 AND d BETWEEN 1 AND 2 UNION ALL SELECT 2, count(*) FROM d WHERE a = 3 AND b BETWEEN 3 AND 4 AND c BETWEEN 5 AND 9 UNION ALL SELECT 3, count(*) FROM d WHERE e BETWEEN 11 AND 20")
def exact_cardinalities(spark, sf):
    return with_truth(derived(spark, sf), _TRUTH)


def _product(spark, sf) -> Model:
    """A hand-made model whose answers SQL can repeat: independent quantity and line number."""
    t = read(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_linenumber").cast("double").alias("k"))
    n = t.count()
    p = Params(alpha=0.0)
    root = N.Product(["q", "k"], [leaf(t, "q", MetaType.DISCRETE, p, n), leaf(t, "k", MetaType.DISCRETE, p, n)])
    return Model(N.assign_ids(root), n, spark)


@query("model_probability", "WITH n AS (SELECT count(*) AS n FROM lineitem), r AS (SELECT CAST(i AS BIGINT) AS query_id, (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN a AND b) * 1.0 / n * (SELECT count(*) FROM lineitem WHERE l_linenumber BETWEEN c AND d) / n AS selectivity, n FROM (VALUES (0, 10, 20, 1, 3), (1, 50, 50, 1, 7)) q(i, a, b, c, d), n) SELECT query_id, selectivity, selectivity * n AS cardinality FROM r")
def model_probability(spark, sf):
    q = query_frame(spark, [{"q": (10.0, 20.0), "k": (1.0, 3.0)}, {"q": (50.0, 50.0), "k": (1.0, 7.0)}], ["q", "k"])
    return _product(spark, sf).probability(q)


@query("model_expectation", "SELECT CAST(0 AS BIGINT) AS query_id, (SELECT sum(l_quantity) FROM lineitem WHERE l_quantity BETWEEN 10 AND 20) / (SELECT count(*) FROM lineitem) * (SELECT count(*) FROM lineitem WHERE l_linenumber <= 3) / (SELECT count(*) FROM lineitem) AS e, (SELECT avg(l_quantity) FROM lineitem WHERE l_quantity BETWEEN 10 AND 20) AS conditional")
def model_expectation(spark, sf):
    return _product(spark, sf).expectation(query_frame(spark, [{"q": (10.0, 20.0), "k": (float("-inf"), 3.0)}], ["q", "k"]), {"q": 1})


@query("model_likelihood", "SELECT l_orderkey * 10 + l_linenumber AS row, ln(count(*) OVER (PARTITION BY l_quantity) * 1.0 / count(*) OVER ()) + ln(count(*) OVER (PARTITION BY l_linenumber) * 1.0 / count(*) OVER ()) AS ll FROM lineitem")
def model_likelihood(spark, sf):
    rows = read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("row"), F.col("l_quantity").alias("q"), F.col("l_linenumber").cast("double").alias("k"))
    return _product(spark, sf).log_likelihood(rows, "row")


@query("model_moments", "SELECT 'q' AS attribute, avg(l_quantity) AS mean, var_pop(l_quantity) AS variance FROM lineitem UNION ALL SELECT 'k', avg(l_linenumber), var_pop(l_linenumber) FROM lineitem")
def model_moments(spark, sf):
    root = _product(spark, sf).root
    mean, var = N.moments(root, 1), N.variance(root)
    return spark.createDataFrame([(c, float(mean[c]), float(var[c])) for c in mean], "attribute string, mean double, variance double")


@query("model_completion", "SELECT CAST(0 AS BIGINT) AS row, CAST(7 AS DOUBLE) AS q, (SELECT CAST(l_linenumber AS DOUBLE) FROM lineitem GROUP BY l_linenumber ORDER BY count(*) DESC, l_linenumber LIMIT 1) AS k UNION ALL SELECT 1, (SELECT l_quantity FROM lineitem GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 1), 2")
def model_completion(spark, sf):
    return _product(spark, sf).complete(spark.createDataFrame([(0, 7.0, None), (1, None, 2.0)], "row long, q double, k double"), "row")


@query("model_samples")
def model_samples(spark, sf):
    return _product(spark, sf).complete(spark.range(1000).select(F.col("id").alias("row"), F.lit(None).cast("double").alias("q"), F.lit(None).cast("double").alias("k")), "row", seed=17)


@query("model_conditioned")
def model_conditioned(spark, sf):
    m, ll = fitted(spark, sf).given(a=3.0)
    q = query_frame(spark, [{"b": (3.0, 3.0)}, {"b": (4.0, 4.0)}], ["b"])
    return m.probability(q).withColumn("log_evidence", F.lit(float(ll)))


@query("model_marginal")
def model_marginal(spark, sf):
    return fitted(spark, sf).marginal(["a", "c"]).probability(query_frame(spark, [{"a": (2.0, 5.0), "c": (5.0, 9.0)}], ["a", "c"]))


@query("model_gradients")
def model_gradients(spark, sf):
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("row")
    return fitted(spark, sf).gradients(derived(spark, sf, row), "row")


def _em_sql(rounds: int = 5) -> str:
    """That many rounds of weights, each from the one before."""
    smooth = "(count(*) + 1.0) / (sum(count(*)) OVER () + count(*) OVER ())"
    out = f"WITH a AS (SELECT p_size AS x, {smooth} AS p FROM part WHERE p_size <= 30 GROUP BY 1), b AS (SELECT p_size AS x, {smooth} AS p FROM part WHERE p_size > 20 GROUP BY 1), r AS (SELECT p_size AS x, count(*) AS n, coalesce(max(a.p), 0) AS a, coalesce(max(b.p), 0) AS b FROM part LEFT JOIN a ON a.x = p_size LEFT JOIN b ON b.x = p_size GROUP BY 1), w0 AS (SELECT 0.5 AS w)"
    for i in range(rounds):
        out += f", w{i + 1} AS (SELECT (sum(n * w * a / (w * a + (1 - w) * b)) + exp(-100)) / (sum(n) + 2 * exp(-100)) AS w FROM r, w{i})"
    return out + f" SELECT 0 AS child, w AS weight FROM w{rounds} UNION ALL SELECT 1, 1 - w FROM w{rounds}"


@query("model_em", _em_sql())
def model_em(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_size").cast("double").alias("x"))
    low, high = rows.where("x <= 30"), rows.where("x > 20")
    root = N.Sum(["x"], [leaf(low, "x", MetaType.DISCRETE, Params(), low.count()), leaf(high, "x", MetaType.DISCRETE, Params(), high.count())], weights=np.array([0.5, 0.5]))
    m = Model(N.assign_ids(root), rows.count(), spark).em(rows)
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(m.root.weights)], "child int, weight double")


@query("incremental_update", "SELECT CAST(0 AS BIGINT) AS query_id, (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 10 AND 20) * 1.0 / (SELECT count(*) FROM lineitem) AS selectivity, (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 10 AND 20) * 1.0 AS cardinality")
def incremental_update(spark, sf):
    """A model of half of the rows, then the other half inserted, some rows inserted twice and deleted again: as if built at once."""
    t = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("q"))
    half, rest, some = t.where("l_orderkey % 2 = 0"), t.where("l_orderkey % 2 = 1"), t.where("l_orderkey % 7 = 0")
    n = half.count()
    m = Model(N.assign_ids(leaf(half, "q", MetaType.DISCRETE, Params(alpha=0.0), n)), n, spark)
    m = update(update(update(m, rest), some), some, -1)
    return m.probability(query_frame(spark, [{"q": (10.0, 20.0)}], ["q"]))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return cardinalities(spark, sf)


from statloom import model_queries  # noqa: E402, F401  adds its queries to these
