"""Randomised dependence coefficient between the columns of a bounded sample.

Each column goes through its empirical copula (ranks, ties to the highest; one-hot for discrete columns), a Gaussian random
projection, and a sine; the coefficient of two columns is the first canonical correlation of their features. All pairs come
from one Gram matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Projected features, scale, seed; rows of the sample.
K, SCALE, SEED = 10, 1 / 6, 17
SAMPLE_ROWS = 50_000
#: One-hot columns beyond this many values go through ranks instead, which bounds the memory of a sample.
ONE_HOT_VALUES = 256


def sample_matrix(df: DataFrame, columns: list[str], rows: int = SAMPLE_ROWS, seed: int = SEED, n: int | None = None) -> np.ndarray:
    """At most rows rows as doubles with NaN for null; n, if known, is the number of rows there are."""
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    n = df.count() if n is None else n
    picked = df if n <= rows else df.sample(False, min(1.0, 1.2 * rows / n), seed).limit(rows)
    return picked.select(*doubles).toPandas().to_numpy(float)


def copula(x: np.ndarray) -> np.ndarray:
    ok = ~np.isnan(x)
    out = np.zeros(len(x))
    v = np.sort(x[ok])
    if len(v):
        out[ok] = np.searchsorted(v, x[ok], "right") / len(v)
    return out


def projection(x: np.ndarray, discrete: bool, rng: np.random.Generator):
    """The features of a column as a function of its values, with ranks, values and projection learned from the sample x."""
    known = np.sort(x[~np.isnan(x)])
    values = np.unique(known)
    hot = discrete and len(values) <= ONE_HOT_VALUES
    shares = np.array([np.mean(x == v) for v in values]) if hot else None
    w = rng.normal(size=((len(values) if hot else 1) + 1, K))

    def f(y: np.ndarray) -> np.ndarray:
        if hot:
            u = np.where(y[:, None] == values[None], 1.0, 1.0 - shares[None])
        else:
            u = (np.searchsorted(known, np.nan_to_num(y, nan=-np.inf), "right") / max(1, len(known)))[:, None]
        u = np.c_[u, np.ones(len(y))]
        return np.sin(SCALE / u.shape[1] * u @ w)

    return f


def features(x: np.ndarray, discrete: bool, rng: np.random.Generator) -> np.ndarray:
    if discrete and len(values := np.unique(x[~np.isnan(x)])) <= ONE_HOT_VALUES:
        blocks = [np.where(x == v, 1.0, 1.0 - np.mean(x == v)) for v in values]  # the copula of a 0/1 column
    else:
        blocks = [copula(x)]
    u = np.c_[np.stack(blocks, 1), np.ones(len(x))] if blocks else np.ones((len(x), 1))
    return np.c_[np.sin(SCALE / u.shape[1] * u @ rng.normal(size=(u.shape[1], K))), np.ones(len(x))]


def rdc_matrix(x: np.ndarray, discrete: list[bool], seed: int = SEED) -> np.ndarray:
    """Symmetric, diagonal 1, 0 where it isn't defined."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    blocks = []
    for i in range(d):
        f = features(x[:, i], discrete[i], rng)
        f = f - f.mean(axis=0)
        u, s, _ = np.linalg.svd(f, full_matrices=False)
        blocks.append(u[:, s > 1e-7 * max(s[0], 1e-300)] if len(s) and s[0] > 1e-12 else np.zeros((len(f), 0)))
    out = np.eye(d)
    for i in range(d):
        for j in range(i):
            if blocks[i].shape[1] and blocks[j].shape[1]:
                r = float(np.linalg.svd(blocks[i].T @ blocks[j], compute_uv=False)[0])
                out[i, j] = out[j, i] = min(1.0, r)
    return out


def components(adjacent: np.ndarray) -> list[list[int]]:
    """Connected components of a boolean matrix, in order of their first member."""
    left, out = set(range(len(adjacent))), []
    while left:
        stack, seen = [min(left)], set()
        while stack:
            i = stack.pop()
            if i not in seen:
                seen.add(i)
                stack += [j for j in left if adjacent[i, j] and j not in seen]
        left -= seen
        out.append(sorted(seen))
    return out
