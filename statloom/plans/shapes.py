"""Kinds of leaves beside histograms: parametric families, piecewise-linear densities, Gaussian vectors, Chow-Liu trees.

A leaf of one column is a Leaf with methods of its own, so that it may stand anywhere in a model. Discrete families are tables
of their support (up to what a trillionth of the mass leaves out), so they answer as histograms do. Likelihoods of continuous
kinds are densities. Leaves of several columns are taught to the evaluation by register().
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators import families as P
from statloom.operators.columns import ChowLiuTree
from statloom.plans import nodes as N

DISCRETE = ("poisson", "geometric", "bernoulli", "negative_binomial", "hypergeometric")
#: A table of a discrete family's support has at most so many values.
SUPPORT = 200_000


def _erf(x: np.ndarray) -> np.ndarray:
    return np.asarray(np.frompyfunc(math.erf, 1, 1)(x), float)


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(np.frompyfunc(math.lgamma, 1, 1)(x), float)


def _gamma_cdf(x: np.ndarray, shape: float) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series below shape + 1, a continued fraction above."""
    x = np.maximum(np.asarray(x, float), 0.0)
    finite = np.where(np.isfinite(x), x, 0.0)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(shape * np.log(finite) - finite - math.lgamma(shape))
    term = total = np.full(x.shape, 1 / shape)
    for k in range(1, 2000):
        term = term * finite / (shape + k)
        total = total + term
        if np.all(term <= 1e-16 * total):
            break
    low = np.where(finite > 0, front * total, 0.0)
    y = np.maximum(finite, shape + 1)
    b = y + 1 - shape
    c, d = np.full(x.shape, 1e300), 1 / b
    h = d
    for k in range(1, 2000):
        a = -k * (k - shape)
        b = b + 2
        d = 1 / np.where(np.abs(a * d + b) < 1e-300, 1e-300, a * d + b)
        c = b + a / np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        high = 1 - np.exp(shape * np.log(y) - y - math.lgamma(shape)) * h
    return np.where(np.isinf(x), 1.0, np.clip(np.where(finite < shape + 1, low, high), 0, 1))


def _log_mass(family: str, k: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    lg = lambda v: _lgamma(np.asarray(v, float))
    choose = lambda n, r: lg(np.asarray(n, float) + 1) - lg(np.asarray(r, float) + 1) - lg(np.asarray(n, float) - r + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if family == "poisson":
            return k * np.log(a) - a - lg(k + 1) if a > 0 else np.where(k == 0, 0.0, -np.inf)
        if family == "geometric":
            return np.where(k == 1, np.log(a), (k - 1) * np.log1p(-a) + np.log(a))
        if family == "bernoulli":
            return np.where(k == 1, np.log(a), np.log1p(-a))
        if family == "negative_binomial":
            return lg(k + a) - lg(k + 1) - math.lgamma(a) + a * np.log(b) + np.where(k == 0, 0.0, k * np.log1p(-b))
        return choose(b, k) + choose(a - b, c - k) - choose(a, c)


@dataclass(eq=False)
class Parametric(N.Leaf):
    """A family with its parameters as families.fit() gives them; c is used by the hypergeometric family only (population a, marked b, draws c)."""

    family: str = "gaussian"
    a: float = 0.0
    b: float = 1.0
    c: float = 0.0
    kind = "parametric"

    def __post_init__(self):
        if self.family in DISCRETE:
            mean, var = P.moment(self.family, 1, self.a, self.b, self.c), P.moment(self.family, 2, self.a, self.b, self.c)
            top = {"bernoulli": 1, "hypergeometric": min(self.b, self.c)}.get(self.family, min(SUPPORT, mean + 60 * math.sqrt(max(var - mean * mean, 0)) + 60))
            low = {"geometric": 1, "hypergeometric": max(0, self.c - (self.a - self.b))}.get(self.family, 0)
            k = np.arange(low, int(top) + 1, dtype=float)
            p = np.exp(_log_mass(self.family, k, self.a, self.b, self.c))
            self.lo, self.hi, self.pdf = k - 0.5, k + 0.5, p / p.sum()
            super().__post_init__()
            self.value = k
        else:
            self.discrete = False
            self.lo = self.hi = self.pdf = np.zeros(0)
            self.cum, self.value = np.zeros(1), np.zeros(0)
        self.fits = self.family in ("gaussian", "bernoulli")

    def parameters(self) -> int:
        return {"hypergeometric": 3, "gaussian": 2, "lognormal": 2, "gamma": 2, "uniform": 2, "negative_binomial": 2}.get(self.family, 1)

    def cdf(self, x: np.ndarray) -> np.ndarray:
        x, a, b = np.asarray(x, float), self.a, self.b
        if self.family in ("gaussian", "lognormal"):
            with np.errstate(divide="ignore", invalid="ignore"):
                x = x if self.family == "gaussian" else np.where(x > 0, np.log(np.maximum(x, 0)), -np.inf)
            return 0.5 + 0.5 * _erf((x - a) / (b * math.sqrt(2))) if b > 0 else (x >= a).astype(float)
        if self.family == "exponential":
            return -np.expm1(-a * np.maximum(x, 0))
        if self.family == "gamma":
            return _gamma_cdf(b * np.maximum(x, 0), a)
        return np.clip((x - a) / (b - a), 0, 1)

    def density(self, x: np.ndarray) -> np.ndarray:
        a, b = self.a, self.b
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            if self.family == "gaussian":
                out = np.exp(-((x - a) ** 2) / (2 * b * b)) / (b * math.sqrt(2 * math.pi))
            elif self.family == "lognormal":
                out = np.where(x > 0, np.exp(-((np.log(np.maximum(x, 1e-300)) - a) ** 2) / (2 * b * b)) / (np.maximum(x, 1e-300) * b * math.sqrt(2 * math.pi)), 0.0)
            elif self.family == "exponential":
                out = np.where(x >= 0, a * np.exp(-a * x), 0.0)
            elif self.family == "gamma":
                out = np.where(x > 0, np.exp(a * math.log(b) - math.lgamma(a) + (a - 1) * np.log(np.maximum(x, 1e-300)) - b * x), 0.0)
            else:
                out = np.where((x >= a) & (x <= b), 1 / (b - a), 0.0)
        return out

    def range_mass(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if self.family in DISCRETE:  # closed ends at whole numbers
            lo, hi = np.ceil(lo), np.floor(hi)
            return super().range_mass(lo, hi)
        return np.where(lo <= hi, np.clip(self.cdf(hi) - self.cdf(lo), 0, 1), 0.0) * self.non_null

    def point_mass(self, x: np.ndarray, floor: float = 0.0) -> np.ndarray:
        if self.family in DISCRETE:
            return np.where(np.isnan(x) | (x == np.floor(x)), super().point_mass(x, floor), floor)
        return np.where(np.isnan(x), 1.0, np.maximum(self.density(x) * self.non_null, floor))

    def moment(self, k: int) -> float:
        return P.moment(self.family, k, self.a, self.b, self.c) if k in (1, 2) else float(self.partial(np.array([-np.inf]), np.array([np.inf]), k)[0] / self.non_null)

    def mode(self) -> float:
        return P.mode(self.family, self.a, self.b, self.c)

    def _grid(self, cells: int = 4096) -> np.ndarray:
        """Quantiles, as far as a billionth of the mass."""
        spread = math.sqrt(max(0.0, P.moment(self.family, 2, self.a, self.b) - P.moment(self.family, 1, self.a, self.b) ** 2))
        mean = P.moment(self.family, 1, self.a, self.b)
        lo, hi = np.full(cells + 1, (mean - 40 * spread) if self.family == "gaussian" else (self.a if self.family == "uniform" else 0.0)), np.full(cells + 1, mean + 400 * spread)
        q = np.linspace(1e-9, 1 - 1e-9, cells + 1)
        for _ in range(80):
            mid = (lo + hi) / 2
            below = self.cdf(mid) < q
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return (lo + hi) / 2

    def partial(self, lo: np.ndarray, hi: np.ndarray, power: int) -> np.ndarray:
        """By quadrature between quantiles for continuous families."""
        if self.family in DISCRETE:
            return super().partial(np.ceil(lo), np.floor(hi), power)
        edges = self._grid()
        out = np.zeros(len(lo))
        at, w = np.polynomial.legendre.leggauss(4)
        for i in range(len(lo)):
            e = np.clip(edges, lo[i], hi[i])
            half, mid = np.diff(e) / 2, (e[1:] + e[:-1]) / 2
            x = mid[:, None] + half[:, None] * at
            with np.errstate(divide="ignore", invalid="ignore"):
                f = np.where((x != 0) | (power > 0), x**power, 0.0) * self.density(x)
            out[i] = (half[:, None] * w * f).sum()
        return out * self.non_null

    def slope(self, x: np.ndarray) -> np.ndarray:
        if self.family in DISCRETE:
            return super().slope(x)
        step = 1e-6 * np.maximum(1.0, np.abs(x))
        return (self.density(x + step) - self.density(x - step)) / (2 * step) * self.non_null

    def within(self, lo: float, hi: float) -> N.Leaf:
        if self.family in DISCRETE:
            return super().within(lo, hi)
        edges = np.unique(np.clip(self._grid(1024), lo, hi))
        p = np.diff(self.cdf(edges))
        return N.Leaf(self.scope, lo=edges[:-1], hi=edges[1:], pdf=p / p.sum() if p.sum() else p, rows=self.rows, discrete=False)

    def draw(self, n: int, rng: np.random.Generator) -> np.ndarray:
        if self.family in DISCRETE:
            return super().draw(n, rng)
        a, b = self.a, self.b
        return {"gaussian": lambda: rng.normal(a, b, n), "lognormal": lambda: rng.lognormal(a, b, n), "exponential": lambda: rng.exponential(1 / a, n), "gamma": lambda: rng.gamma(a, 1 / b, n), "uniform": lambda: rng.uniform(a, b, n)}[self.family]()

    def em_sums(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.array([w.sum(), (w * x).sum(), (w * x * x).sum()])

    def em_update(self, sums: np.ndarray) -> None:
        """New parameters from weighted sums of 1, x and x * x over all rows."""
        if sums[0] <= 0:
            return
        mean = sums[1] / sums[0]
        self.a, self.b = (mean, math.sqrt(max(sums[2] / sums[0] - mean * mean, 1e-12))) if self.family == "gaussian" else (min(1.0, max(0.0, mean)), self.b)
        self.__post_init__()


def parametric(df: DataFrame, column: str, family: str) -> Parametric:
    """A leaf of that family, fitted by one aggregation."""
    r = P.fit(df, column).where(F.col("family") == family).first()
    if r is None:
        raise ValueError(f"{column} can't be {family}")
    known, n = df.agg(F.count(column), F.count("*")).first()
    return Parametric([column], family=family, a=r.a, b=r.b if r.b is not None else 1.0, non_null=known / n, rows=float(n))


@dataclass(eq=False)
class Piecewise(N.Leaf):
    """A density that is linear between knots x with heights y; its area is 1."""

    x: np.ndarray = None
    y: np.ndarray = None
    kind = "piecewise"

    def __post_init__(self):
        self.x, self.y = np.asarray(self.x, float), np.asarray(self.y, float)
        self.discrete = False
        self.lo, self.hi = self.x[:-1], self.x[1:]
        self.pdf = np.diff(self.x) * (self.y[1:] + self.y[:-1]) / 2
        self.cum = np.r_[0.0, np.cumsum(self.pdf)]
        self.value = (self.lo + self.hi) / 2

    def parameters(self) -> int:
        return 2 * len(self.x)

    def density(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y, left=0.0, right=0.0)

    def cdf(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.x[0], self.x[-1])
        i = np.clip(np.searchsorted(self.x, x, "right") - 1, 0, len(self.x) - 2)
        return self.cum[i] + (x - self.x[i]) * (self.y[i] + self.density(x)) / 2

    def range_mass(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return np.where(lo <= hi, self.cdf(hi) - self.cdf(lo), 0.0) * self.non_null

    def point_mass(self, x: np.ndarray, floor: float = 0.0) -> np.ndarray:
        return np.where(np.isnan(x), 1.0, np.maximum(self.density(x) * self.non_null, floor))

    def _integral(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Of x^k times the density from a to b within each segment, by a quadrature that is exact for polynomials of its degree."""
        at, w = np.polynomial.legendre.leggauss(k // 2 + 2)
        half, mid = (b - a) / 2, (a + b) / 2
        x = mid[..., None] + half[..., None] * at
        left, width = self.x[:-1, None], np.diff(self.x)[:, None]
        y = self.y[:-1, None] + (self.y[1:] - self.y[:-1])[:, None] * ((x - left) / width)
        return (half[..., None] * w * x**k * y).sum(axis=-1)

    def moment(self, k: int) -> float:
        return float(self._integral(self.x[:-1], self.x[1:], k).sum() / self.cum[-1])

    def mode(self) -> float:
        return float(self.x[int(np.argmax(self.y))])

    def partial(self, lo: np.ndarray, hi: np.ndarray, power: int) -> np.ndarray:
        if power < 0:
            raise ValueError("a density that may hold 0 has no expectation of a negative power")
        a, b = np.clip(self.x[:-1][None], lo[:, None], hi[:, None]), np.clip(self.x[1:][None], lo[:, None], hi[:, None])
        return self._integral(a, b, power).sum(axis=1) * self.non_null

    def slope(self, x: np.ndarray) -> np.ndarray:
        i = np.clip(np.searchsorted(self.x, x, "right") - 1, 0, len(self.x) - 2)
        inside = (x >= self.x[0]) & (x <= self.x[-1])
        return np.where(inside, (self.y[i + 1] - self.y[i]) / (self.x[i + 1] - self.x[i]), 0.0) * self.non_null

    def within(self, lo: float, hi: float) -> Piecewise:
        a, b = max(lo, self.x[0]), min(hi, self.x[-1])
        x = np.unique(np.r_[a, self.x[(self.x > a) & (self.x < b)], b])
        if a >= b:
            return self
        y = self.density(x)
        area = (np.diff(x) * (y[1:] + y[:-1]) / 2).sum()
        return Piecewise(self.scope, x=x, y=y / area if area > 0 else y, rows=self.rows)

    def draw(self, n: int, rng: np.random.Generator, ranges: list[tuple[float, float]] | None = None) -> np.ndarray:
        """By the inverse of the cumulated density; with ranges, from what lies in any of these disjoint ranges."""
        ends = np.array(ranges if ranges is not None else [(self.x[0], self.x[-1])], float)
        base = self.cdf(ends[:, 0])
        mass = self.cdf(ends[:, 1]) - base
        if mass.sum() <= 0:
            return np.full(n, math.nan)
        at = rng.choice(len(ends), n, p=mass / mass.sum())
        return self.quantile(base[at] + rng.random(n) * mass[at])

    def quantile(self, q: np.ndarray) -> np.ndarray:
        i = np.clip(np.searchsorted(self.cum, q, "right") - 1, 0, len(self.x) - 2)
        s = (self.y[i + 1] - self.y[i]) / (self.x[i + 1] - self.x[i])
        rest = np.maximum(q - self.cum[i], 0.0)
        root = np.sqrt(np.maximum(self.y[i] ** 2 + 2 * s * rest, 0.0))
        return np.minimum(self.x[i] + 2 * rest / np.maximum(self.y[i] + root, 1e-300), self.x[i + 1])


def piecewise(segments: DataFrame, column: str, non_null: float = 1.0, rows: float = 0.0) -> Piecewise:
    """A leaf from histograms.piecewise(): as many segments as the histogram has bins reach the driver."""
    got = segments.orderBy("x0").collect()
    return Piecewise([column], x=np.array([got[0].x0, *(r.x1 for r in got)]), y=np.array([got[0].y0, *(r.y1 for r in got)]), non_null=non_null, rows=rows)


@dataclass(eq=False)
class TreeLeaf(N.Node):
    """A Chow-Liu tree over binary columns."""

    tree: ChowLiuTree = None
    kind = "tree"

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> TreeLeaf:
        return cls(list(columns), tree=ChowLiuTree.fit(df, columns))

    def allowed(self, lo: N.Batch, hi: N.Batch, m: int) -> np.ndarray:
        """For each box, column and value 0 or 1, 0 if it lies inside, else minus infinity."""
        out = np.zeros((m, len(self.scope), 2))
        for j, c in enumerate(self.scope):
            for v in (0, 1):
                inside = (lo.get(c, np.full(m, -np.inf)) <= v) & (hi.get(c, np.full(m, np.inf)) >= v)
                out[:, j, v] = np.where(inside, 0.0, -1e300)
        return out

    def rows_of(self, x: N.Batch, m: int) -> np.ndarray:
        return np.stack([x.get(c, np.full(m, np.nan)) for c in self.scope], 1)

    def moments(self, k: int) -> dict[str, float]:
        d = len(self.scope)
        x = np.full((d, d), np.nan)
        np.fill_diagonal(x, 1.0)
        return dict(zip(self.scope, np.exp(self.tree.log_likelihood(x)).tolist(), strict=True))  # 0 and 1 are their own powers

    def completed(self, x: N.Batch, m: int, rng: np.random.Generator | None) -> N.Batch:
        rows = self.rows_of(x, m)
        got = self.tree.most_probable(rows) if rng is None else self.tree.sample(rows, rng)
        return {c: got[:, j] for j, c in enumerate(self.scope)}


N.register(
    TreeLeaf,
    probability=lambda n, lo, hi, m: np.exp(n.tree.log_mass(n.allowed(lo, hi, m))),
    log_likelihood=lambda n, x, m: n.tree.log_likelihood(n.rows_of(x, m)),
    moments=lambda n, k: n.moments(k),
    complete=lambda n, x, m, rng: n.completed(x, m, rng),
)


@dataclass(eq=False)
class Gaussians(N.Node):
    """A Gaussian vector: mean and covariance."""

    mean: np.ndarray = None
    cov: np.ndarray = None
    kind = "gaussians"
    #: Points by which the mass of a box is estimated, the same for each box.
    POINTS = 16_384

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> Gaussians:
        d, mean = len(columns), np.zeros(len(columns))
        cov = np.zeros((d, d))
        for r in P.fit_multivariate(df, columns).collect():  # a row for each pair of columns
            i, j = columns.index(r.i), columns.index(r.j)
            mean[i], mean[j] = r.mean_i, r.mean_j
            cov[i, j] = cov[j, i] = r["cov"]
        return cls(list(columns), mean=mean, cov=cov)

    def _parts(self, x: N.Batch, m: int):
        """Rows with the same known columns, together: (rows, known, unknown, values)."""
        v = np.stack([x.get(c, np.full(m, np.nan)) for c in self.scope], 1)
        known, which = np.unique(~np.isnan(v), axis=0, return_inverse=True)
        for i, k in enumerate(known):
            at = np.flatnonzero(which.ravel() == i)
            yield at, np.flatnonzero(k), np.flatnonzero(~k), v[at]

    def log_likelihood(self, x: N.Batch, m: int) -> np.ndarray:
        out = np.zeros(m)
        for at, k, _, v in self._parts(x, m):
            if len(k):
                low = np.linalg.cholesky(self.cov[np.ix_(k, k)])
                z = np.linalg.solve(low, (v[:, k] - self.mean[k]).T)
                out[at] = -0.5 * (z**2).sum(axis=0) - np.log(np.diag(low)).sum() - len(k) / 2 * math.log(2 * math.pi)
        return out

    def probability(self, lo: N.Batch, hi: N.Batch, m: int) -> np.ndarray:
        used = [i for i, c in enumerate(self.scope) if c in lo]
        if not used:
            return np.ones(m)
        z = np.random.default_rng(17).normal(size=(self.POINTS // 2, len(self.scope)))
        points = np.r_[z, -z] @ np.linalg.cholesky(self.cov).T + self.mean
        inside = np.ones((m, self.POINTS), bool)
        for i in used:
            c = self.scope[i]
            inside &= (points[:, i] >= lo[c][:, None]) & (points[:, i] <= hi[c][:, None])
        return inside.mean(axis=1)

    def moments(self, k: int) -> dict[str, float]:
        return {c: P.moment("gaussian", k, float(self.mean[i]), math.sqrt(self.cov[i, i])) for i, c in enumerate(self.scope)}

    def completed(self, x: N.Batch, m: int, rng: np.random.Generator | None) -> N.Batch:
        out = np.empty((m, len(self.scope)))
        for at, k, u, v in self._parts(x, m):
            out[at] = v
            if len(u):
                gain = np.linalg.solve(self.cov[np.ix_(k, k)], self.cov[np.ix_(k, u)]).T if len(k) else np.zeros((len(u), 0))
                centre = self.mean[u] + (v[:, k] - self.mean[k]) @ gain.T
                if rng is not None:
                    rest = self.cov[np.ix_(u, u)] - gain @ self.cov[np.ix_(k, u)]
                    centre = centre + rng.multivariate_normal(np.zeros(len(u)), rest, len(at))
                out[np.ix_(at, u)] = centre
        return {c: out[:, j] for j, c in enumerate(self.scope)}


N.register(
    Gaussians,
    probability=lambda n, lo, hi, m: n.probability(lo, hi, m),
    log_likelihood=lambda n, x, m: n.log_likelihood(x, m),
    moments=lambda n, k: n.moments(k),
    complete=lambda n, x, m, rng: n.completed(x, m, rng),
)
