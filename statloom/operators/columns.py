"""Column partitioning: groups of dependent columns, pairwise information, Chow-Liu trees, a stability test."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.rdc import SAMPLE_ROWS, components, rdc_matrix, sample_matrix

#: Fixed value: smoothing of the tree's counts.
TREE_ALPHA = 0.01


def rdc_groups(df: DataFrame, columns: list[str], discrete: list[bool], threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> list[list[str]]:
    """Connected groups of columns whose pairwise coefficient reaches threshold."""
    m = rdc_matrix(sample_matrix(df, columns, rows), discrete)
    return [[columns[i] for i in g] for g in components(m >= threshold)]


def cooccurrences(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, c): how often binary columns i and j are both 1, all pairs in one aggregation; with the number of rows as n."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(columns[i]) * F.col(columns[j])), F.lit(0)).alias(f"c{i}_{j}") for i, j in pairs])
    return sums.select("n", F.explode(F.array(*[F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.col(f"c{i}_{j}").cast("long").alias("c")) for i, j in pairs])).alias("r")).select("r.i", "r.j", "r.c", "n")


def mutual_information(df: DataFrame, columns: list[str], alpha: float = TREE_ALPHA) -> DataFrame:
    """(i, j, mi) in nats of binary columns, from smoothed counts: p_i = (c_ii + 2a) / (n + 4a), p_ij = (c_ij + a) / (n + 4a)."""
    c = cooccurrences(df, columns)
    ones = c.where("i = j")
    both = c.where("i <> j").join(ones.select("i", F.col("c").alias("ci")), "i").join(ones.select(F.col("i").alias("j"), F.col("c").alias("cj")), "j")
    n = F.col("n") + 4 * alpha
    p1, q1 = (F.col("ci") + 2 * alpha) / n, (F.col("cj") + 2 * alpha) / n
    p11, p10, p01 = (F.col("c") + alpha) / n, (F.col("ci") - F.col("c") + alpha) / n, (F.col("cj") - F.col("c") + alpha) / n
    p00 = (F.col("n") - F.col("ci") - F.col("cj") + F.col("c") + alpha) / n
    mi = p11 * F.log(p11 / (p1 * q1)) + p10 * F.log(p10 / (p1 * (1 - q1))) + p01 * F.log(p01 / ((1 - p1) * q1)) + p00 * F.log(p00 / ((1 - p1) * (1 - q1)))
    return both.select("i", "j", mi.alias("mi"))


class ChowLiuTree:
    """A tree over binary columns. Its tables have d x 2 x 2 numbers, from one aggregation."""

    def __init__(self, columns: list[str], parent: list[int], order: list[int], log_factor: np.ndarray):
        self.columns, self.parent, self.order, self.log_factor = columns, parent, order, log_factor

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], alpha: float = TREE_ALPHA, parent: list[int] | None = None) -> ChowLiuTree:
        """The tree of greatest mutual information; or that of the given parents, of which each comes before its children."""
        d, given = len(columns), parent
        co, at = np.zeros((d, d)), {c: i for i, c in enumerate(columns)}
        n = 0
        for r in cooccurrences(df, columns).collect():  # d (d + 1) / 2 rows
            co[at[r.i], at[r.j]] = co[at[r.j], at[r.i]] = r.c
            n = r.n
        p = (np.diag(co) + 2 * alpha) / (n + 4 * alpha)
        joint = np.empty((d, d, 2, 2))
        one = np.diag(co)
        for (a, b), c in (((1, 1), co), ((1, 0), one[:, None] - co), ((0, 1), one[None, :] - co), ((0, 0), n - one[:, None] - one[None, :] + co)):
            joint[:, :, a, b] = (c + alpha) / (n + 4 * alpha)
        single = np.stack([1 - p, p], 1)
        mi = (joint * np.log(joint / (single[:, None, :, None] * single[None, :, None, :]))).sum((2, 3))
        parent, order, best = given or [-1] * d, list(range(d)) if given else [0], [(mi[0, j], 0) for j in range(d)]
        while len(order) < d:
            j = max((j for j in range(d) if j not in order), key=lambda j: (best[j][0], -j))
            parent[j] = best[j][1]
            order.append(j)
            best = [max(best[k], (mi[j, k], j), key=lambda x: x[0]) for k in range(d)]
        f = np.empty((d, 2, 2))
        for j in range(d):
            f[j] = np.log(single[j])[None, :] if parent[j] < 0 else np.log(joint[parent[j], j] / single[parent[j]][:, None])
        return cls(columns, parent, order, f)

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        """Of rows with NaN for unknown cells, which are summed out from the leaves of the tree to its root."""
        return self.log_mass(np.stack([self._evidence(x[:, j]) for j in range(x.shape[1])], 1))

    def log_mass(self, evidence: np.ndarray) -> np.ndarray:
        """Of sets of rows: evidence[i, j, v] is 0 where column j may be v, and hugely negative elsewhere."""
        msg = np.zeros(evidence.shape)
        out = np.zeros(len(evidence))
        for j in reversed(self.order):
            t = self.log_factor[j][None, :, :] + msg[:, j, None, :] + evidence[:, j][:, None, :]
            top = t.max(axis=2)
            up = top + np.log(np.exp(t - top[:, :, None]).sum(axis=2))
            if self.parent[j] < 0:
                out = up[:, 0]
            else:
                msg[:, self.parent[j]] += up
        return out

    def most_probable(self, x: np.ndarray) -> np.ndarray:
        """Rows with NaN filled by the jointly most probable values."""
        msg = np.zeros((len(x), len(self.columns), 2))
        pick = np.zeros((len(x), len(self.columns), 2), int)
        for j in reversed(self.order):
            t = self.log_factor[j][None, :, :] + msg[:, j, None, :] + self._evidence(x[:, j])[:, None, :]
            pick[:, j] = t.argmax(axis=2)
            if self.parent[j] >= 0:
                msg[:, self.parent[j]] += t.max(axis=2)
        return self._descend(x, lambda j, up: pick[np.arange(len(x)), j, up])

    def sample(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Rows with NaN filled by draws from the tree, given what is known."""
        msg = np.zeros((len(x), len(self.columns), 2))
        odds = np.zeros((len(x), len(self.columns), 2))
        for j in reversed(self.order):
            t = self.log_factor[j][None, :, :] + msg[:, j, None, :] + self._evidence(x[:, j])[:, None, :]
            top = t.max(axis=2, keepdims=True)
            e = np.exp(t - top)
            odds[:, j] = e[:, :, 1] / e.sum(axis=2)
            if self.parent[j] >= 0:
                msg[:, self.parent[j]] += top[:, :, 0] + np.log(e.sum(axis=2))
        return self._descend(x, lambda j, up: (rng.random(len(x)) < odds[np.arange(len(x)), j, up]).astype(int))

    def _descend(self, x: np.ndarray, value) -> np.ndarray:
        out = x.copy()
        for j in self.order:
            up = out[:, self.parent[j]].astype(int) if self.parent[j] >= 0 else np.zeros(len(x), int)
            out[:, j] = np.where(np.isnan(x[:, j]), value(j, up), x[:, j])
        return out

    @staticmethod
    def _evidence(v: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(v)[:, None], 0.0, np.where(v[:, None] == np.array([0.0, 1.0]), 0.0, -1e300))


def stability_statistic(df: DataFrame, y: str, z: str) -> DataFrame:
    """sup of cum^2 / (t (1 - t)) over t of the scaled residuals y - mean(y), rows in order of z (ties by y): how much the rate
    of y changes along z. (statistic, n). The running sum goes over ranges of z, so no task holds the whole column."""
    from statloom.functions.prefix import running_sum

    s = df.where(F.col(y).isNotNull() & F.col(z).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"))
    m = s.agg(F.avg("y").alias("m"), F.count("*").alias("n"), F.var_pop("y").alias("var")).first()
    if not m.n or not m.var:
        return df.sparkSession.createDataFrame([(0.0, m.n or 0)], "statistic double, n long")
    groups = s.groupBy("z").agg(F.sum(F.col("y") - m.m).alias("r"), F.count("*").alias("k"))
    cum = running_sum(running_sum(groups, "z", F.col("r"), "cr"), "z", F.col("k"), "ck")
    t = F.col("ck") / m.n
    lo = max(0.1 * m.n, 10) / m.n
    inside = cum.where((t >= lo) & (t <= 1 - lo))
    return inside.agg(F.coalesce(F.max(F.col("cr") * F.col("cr") / (m.n * m.var) / (t * (1 - t))), F.lit(0.0)).alias("statistic"), F.lit(m.n).cast("long").alias("n"))


def stability_p_value(statistic: float, trimmed: float = 0.1, terms: int = 1) -> float:
    """Tail of the supremum of the squared scaled Brownian bridge over [trimmed, 1 - trimmed] (DeLong's approximation)."""
    import math

    if statistic <= 0:
        return 1.0
    lam = (1 - trimmed) ** 2 / trimmed**2
    x = statistic
    p = math.sqrt(x / 2) * math.exp(-x / 2) / math.sqrt(math.pi) * ((1 - 1 / x) * math.log(lam) + 2 / x) * terms if x > 1 else 1.0
    return float(min(1.0, max(0.0, p)))


def stability_groups(df: DataFrame, columns: list[str], alpha: float = 0.3) -> list[list[str]]:
    """Groups of columns for which one's rate changes along the other (least p of both ways, Bonferroni)."""
    d = len(columns)
    p = np.ones((d, d))
    for i in range(d):
        for j in range(d):
            if i != j:
                r = stability_statistic(df, columns[i], columns[j]).first()
                p[i, j] = min(1.0, stability_p_value(r.statistic) * d * (d - 1) / 2)
    p = np.minimum(p, p.T)
    return [[columns[i] for i in g] for g in components(p <= alpha)]
