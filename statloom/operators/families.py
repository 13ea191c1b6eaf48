"""Parametric leaves: maximum-likelihood fits by one aggregation, and densities, modes and moments as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES = ("gaussian", "lognormal", "exponential", "gamma", "poisson", "geometric", "bernoulli", "uniform", "negative_binomial")


def _row(family: str, a: Column, b: Column, ok: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), a.alias("a"), b.alias("b"), F.coalesce(ok, F.lit(False)).alias("ok"))


def fit(df: DataFrame, column: str) -> DataFrame:
    """(family, a, b) for every family that the data allow; textbook estimators.

    gaussian: mean, population deviation; lognormal: the same of logs; exponential: rate; gamma: shape (Minka's closed form)
    and rate; poisson: rate; geometric (from 1): p; bernoulli: p of 1; uniform: ends; negative binomial (failures before the
    a-th success): number of successes and p, by the mean and the variance, where that exceeds the mean.
    """
    v = F.col(column).cast("double")
    s = df.where(v.isNotNull()).agg(
        F.avg(v).alias("m"), F.stddev_pop(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.avg(F.when(v > 0, F.log(v))).alias("lm"), F.stddev_pop(F.when(v > 0, F.log(v))).alias("lsd"),
        F.max((v != F.floor(v)).cast("int")).alias("fractional"), F.avg((v == 1).cast("double")).alias("ones"),
    )
    gap = F.log("m") - F.col("lm")
    shape = (3 - gap + F.sqrt((gap - 3) * (gap - 3) + 24 * gap)) / (12 * gap)
    whole, positive = F.col("fractional") == 0, F.col("lo") > 0
    none = F.lit(None).cast("double")
    rows = [
        _row("gaussian", F.col("m"), F.col("sd"), F.lit(True)),
        _row("lognormal", F.col("lm"), F.col("lsd"), positive),
        _row("exponential", 1 / F.col("m"), none, (F.col("lo") >= 0) & (F.col("m") > 0)),
        _row("gamma", shape, shape / F.col("m"), positive & (gap > 0)),
        _row("poisson", F.col("m"), none, whole & (F.col("lo") >= 0)),
        _row("geometric", 1 / F.col("m"), none, whole & (F.col("lo") >= 1)),
        _row("bernoulli", F.col("ones"), none, whole & (F.col("lo") >= 0) & (F.col("hi") <= 1)),
        _row("uniform", F.col("lo"), F.col("hi"), F.col("hi") > F.col("lo")),
        _row("negative_binomial", F.col("m") * F.col("m") / (F.col("sd") * F.col("sd") - F.col("m")), F.col("m") / (F.col("sd") * F.col("sd")), whole & (F.col("lo") >= 0) & (F.col("m") > 0) & (F.col("sd") * F.col("sd") > F.col("m"))),
    ]
    return s.select(F.explode(F.array(*rows)).alias("r")).where("r.ok").select("r.family", "r.a", "r.b")


def fit_hypergeometric(df: DataFrame, column: str, population: int, draws: int) -> DataFrame:
    """(a, b, c): population, the likeliest number of marked ones in it, draws; of counts of marked ones among so many draws."""
    mean = df.agg(F.avg(column).alias("m"))
    return mean.select(F.lit(float(population)).alias("a"), F.least(F.lit(float(population)), F.floor(F.col("m") / draws * (population + 1)).cast("double")).alias("b"), F.lit(float(draws)).alias("c"))


def fit_categorical(df: DataFrame, column: str) -> DataFrame:
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count(column).alias("_t")))).select(F.col(column).alias("value"), (F.col("n") / F.col("_t")).alias("p"))  # one row


def fit_multivariate(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, mean_i, mean_j, cov): means and sample covariances of all pairs in one aggregation."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.col(f"m{i}").alias("mean_i"), F.col(f"m{j}").alias("mean_j"), F.col(f"c{i}_{j}").alias("cov")) for i, j in pairs])).alias("r")).select("r.*")


def _log_factorial(k: Column) -> Column:
    """log k! by the sum for small k and Stirling's series (error under 1e-12) beyond."""
    x = k + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return F.when(k < 20, small).otherwise(series)


def _log_gamma(x: Column) -> Column:
    """log of the gamma function, by Stirling's series 10 further on (error under 1e-12)."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return series - sum((F.log(x + i) for i in range(10)), F.lit(0.0))


def c_log(x: Column) -> Column:
    """The natural logarithm as C's library has it, by which databases go; Spark's own differs in the last bit of one in a hundred. Null where
    there is none."""

    def logs(v: pa.Array) -> pa.Array:
        return pa.array([math.log(k) if k is not None and k > 0 else None for k in v.to_pylist()], pa.float64())

    return F.arrow_udf(logs, "double")(x.cast("double"))


def c_square(x: Column) -> Column:
    """x to the power of 2, in the same way; its last bit is not always that of x * x."""

    def squares(v: pa.Array) -> pa.Array:
        return pa.array([math.pow(k, 2) if k is not None else None for k in v.to_pylist()], pa.float64())

    return F.arrow_udf(squares, "double")(x.cast("double"))


def log_density(family: str, x: Column, a: float, b: float | None = None, c: float = 0.0, ln: Column | None = None, square: Callable[[Column], Column] = lambda x: x * x) -> Column:
    """Log density or mass; -infinity outside the support, 0 (marginalised) for null. ln: x's logarithm, if it is known."""
    none, ln = F.lit(float("-inf")), F.log(x) if ln is None else ln
    if family == "gaussian":
        out = -((x - a) * (x - a)) / (2 * b * b) - math.log(b * math.sqrt(2 * math.pi))
    elif family == "lognormal":
        out = F.when(x > 0, -ln - math.log(b * math.sqrt(2 * math.pi)) - square(ln - a) / (2 * b * b)).otherwise(none)
    elif family == "exponential":
        out = F.when(x >= 0, math.log(a) - a * x).otherwise(none)
    elif family == "gamma":
        out = F.when(x > 0, a * math.log(b) - math.lgamma(a) + (a - 1) * ln - b * x).otherwise(none)
    elif family == "poisson":
        out = F.when((x >= 0) & (x == F.floor(x)), x * math.log(a) - a - _log_factorial(x)).otherwise(none)
    elif family == "geometric":
        out = F.when((x >= 1) & (x == F.floor(x)), (x - 1) * (math.log1p(-a) if a < 1 else -math.inf) + math.log(a)).otherwise(none)
    elif family == "bernoulli":
        out = F.when(x == 1, math.log(a) if a > 0 else -math.inf).when(x == 0, math.log1p(-a) if a < 1 else -math.inf).otherwise(none)
    elif family == "uniform":
        out = F.when(x.between(a, b), -math.log(b - a)).otherwise(none)
    elif family == "negative_binomial":
        k = x.cast("double")
        out = F.when((x >= 0) & (x == F.floor(x)), _log_gamma(k + a) - _log_gamma(k + 1) - math.lgamma(a) + a * math.log(b) + k * (math.log1p(-b) if b < 1 else -math.inf)).otherwise(none)
    elif family == "hypergeometric":
        k = x.cast("double")
        choose = lambda n, r: math.lgamma(n + 1) - _log_gamma(r + 1) - _log_gamma(n - r + 1)
        every = math.lgamma(a + 1) - math.lgamma(c + 1) - math.lgamma(a - c + 1)
        out = F.when((x >= max(0.0, c - (a - b))) & (x <= min(b, c)) & (x == F.floor(x)), choose(b, k) + math.lgamma(a - b + 1) - _log_gamma(c - k + 1) - _log_gamma(a - b - c + k + 1) - every).otherwise(none)
    else:
        raise ValueError(family)
    return F.when(x.isNull(), 0.0).otherwise(out)


def mode(family: str, a: float, b: float | None = None, c: float = 0.0) -> float:
    """Where the density or mass is greatest; the middle, if it is so everywhere."""
    return {
        "gaussian": lambda: a,
        "lognormal": lambda: math.exp(a - b * b),
        "exponential": lambda: 0.0,
        "gamma": lambda: max(0.0, (a - 1) / b),
        "poisson": lambda: float(math.floor(a)),
        "geometric": lambda: 1.0,
        "bernoulli": lambda: float(a >= 0.5),
        "uniform": lambda: (a + b) / 2,
        "negative_binomial": lambda: float(math.floor((a - 1) * (1 - b) / b)) if a > 1 else 0.0,
        "hypergeometric": lambda: float(math.floor((c + 1) * (b + 1) / (a + 2))),
    }[family]()


def moment(family: str, k: int, a: float, b: float | None = None, c: float = 0.0) -> float:
    """E[x^k] for k = 1 or 2."""
    mean, var = {
        "gaussian": lambda: (a, b * b),
        "lognormal": lambda: (math.exp(a + b * b / 2), (math.exp(b * b) - 1) * math.exp(2 * a + b * b)),
        "exponential": lambda: (1 / a, 1 / a**2),
        "gamma": lambda: (a / b, a / b**2),
        "poisson": lambda: (a, a),
        "geometric": lambda: (1 / a, (1 - a) / a**2),
        "bernoulli": lambda: (a, a * (1 - a)),
        "uniform": lambda: ((a + b) / 2, (b - a) ** 2 / 12),
        "negative_binomial": lambda: (a * (1 - b) / b, a * (1 - b) / b**2),
        "hypergeometric": lambda: (c * b / a, c * (b / a) * (1 - b / a) * (a - c) / max(a - 1, 1)),
    }[family]()
    if k not in (1, 2):
        raise ValueError("moments of order 1 and 2 only")
    return mean if k == 1 else var + mean * mean
