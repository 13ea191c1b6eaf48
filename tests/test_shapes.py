"""Kinds of leaves, model text and storage, splits by name, bounded maintenance, density clusters."""

import math

import numpy as np
import pytest

from statloom.operators import predicates as Q
from statloom.operators import rows as R
from statloom.plans import nodes as N
from statloom.plans.export import as_text, from_text
from statloom.plans.learn import Params, histogram_leaf, learn_binary
from statloom.plans.model import Model
from statloom.plans.shapes import Gaussians, Parametric, Piecewise, TreeLeaf, _gamma_cdf
from statloom.plans.strategies import split_functions
from statloom.operators.columns import ChowLiuTree
from statloom.sources.context import MetaType
from statloom.sources.workload import query_frame
from statloom.streaming import maintain


def tree():
    f = np.log(np.array([[[0.4, 0.6], [0.4, 0.6]], [[0.9, 0.1], [0.2, 0.8]]]))
    return TreeLeaf(["t", "u"], tree=ChowLiuTree(["t", "u"], [-1, 0], [0, 1], f))


def everything():
    x = Piecewise(["p"], x=[0.0, 1.0, 3.0], y=[0.0, 2 / 3, 0.0])
    gauss = Gaussians(["g", "h"], mean=np.array([1.0, 2.0]), cov=np.array([[2.0, 0.5], [0.5, 1.0]]))
    return N.assign_ids(Parametric(["a"], family="gamma", a=2.0, b=0.5) * Parametric(["b"], family="poisson", a=3.0) * x * gauss * tree())


def test_incomplete_gamma():
    """Against the exponential, the Erlang and the chi-square distribution."""
    x = np.array([0.0, 0.1, 1.0, 5.0, 40.0, np.inf])
    assert np.allclose(_gamma_cdf(x, 1.0), 1 - np.exp(-x))
    assert np.allclose(_gamma_cdf(x[:-1], 3.0), 1 - np.exp(-x[:-1]) * (1 + x[:-1] + x[:-1] ** 2 / 2))
    assert np.allclose(_gamma_cdf(x[:-1], 0.5), [math.erf(math.sqrt(v)) for v in x[:-1]])


def test_text_and_storage(spark, tmp_path):
    root = everything()
    rows = {"a": np.array([1.0, np.nan]), "b": np.array([2.0, 3.0]), "p": np.array([0.5, 2.0]), "g": np.array([1.0, np.nan]), "h": np.array([0.0, 2.0]), "t": np.array([1.0, 0.0]), "u": np.array([np.nan, 1.0])}
    want = N.log_likelihood(root, rows, 2)
    assert np.isfinite(want).all() and np.allclose(N.log_likelihood(from_text(as_text(root)), rows, 2), want)
    Model(root, 10, spark).save(f"{tmp_path}/m")
    assert np.allclose(N.log_likelihood(Model.load(spark, f"{tmp_path}/m").root, rows, 2), want)


def test_shapes_complete_and_condition():
    root = everything()
    mean, var = N.moments(root, 1), N.variance(root)
    x = N.complete(root, {}, 40_000, np.random.default_rng(1))
    for c in root.scope:
        assert abs(x[c].mean() - mean[c]) < 0.03 * max(1.0, math.sqrt(var[c])), c
    best = N.complete(root, {"t": np.array([1.0])}, 1)
    assert best["u"][0] == 1 and best["p"][0] == 1.0 and best["a"][0] == 2.0 and best["h"][0] == 2.0
    lo, hi = {"t": np.array([1.0]), "u": np.array([1.0]), "p": np.array([0.0])}, {"t": np.array([1.0]), "u": np.array([1.0]), "p": np.array([1.0])}
    assert np.allclose(N.probability(root, lo, hi, 1), 0.6 * 0.8 / 3)


def test_split_names(spark):
    df = spark.range(100).selectExpr("cast(id as double) as x", "cast(id % 7 as double) as y")
    for name in ("kmeans", "gmm", "rdc", "grid", "rectangle", "grid_naive"):
        parts = {r.part: r.n for r in R.part_shares(split_functions(rows=name)[1](df, ["x", "y"])).collect()}
        assert sum(parts.values()) == 100 and len(parts) >= 2, name
    with pytest.raises(ValueError, match="none of"):
        split_functions(rows="tsne")


def test_density_clusters(spark):
    """Against DBSCAN by definition, in two dimensions, with repeated points and dense cells."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 0.4, (60, 2)), r.normal(5, 0.5, (40, 2)), r.uniform(-10, 15, (30, 2)), np.repeat([[9.0, 9.0]], 12, 0)])
    eps, least = 0.9, 6
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    part = np.where(core, np.arange(len(x)), 10**9)
    for _ in range(len(x)):
        new = np.array([min(part[i], *(part[near[i] & core]), part[i]) if core[i] else part[i] for i in range(len(x))])
        if (new == part).all():
            break
        part = new
    want = {i: int(part[i]) if core[i] else int(part[near[i] & core].min()) if (near[i] & core).any() else None for i in range(len(x))}
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row long, a double, b double")
    assert {g.row: g.part for g in R.density_split(df, ["a", "b"], eps, least).collect()} == want


def test_range_joins_agree(spark, monkeypatch):
    """A batch too large to be sent whole gives the same as one that is."""
    bins = spark.createDataFrame([(float(i) - 0.5, float(i) + 0.5, 0.01, 1.0) for i in range(100)], "lo double, hi double, pdf double, non_null double")
    q = spark.createDataFrame([(i, float(i % 90), float(i % 90 + i % 7)) for i in range(200)], "query_id long, lo double, hi double")
    want = {r.query_id: r.p for r in Q.range_probability(bins, q).collect()}
    monkeypatch.setattr(Q, "MOST", 40)
    monkeypatch.setattr(Q._meet, "__defaults__", (40,))
    assert {r.query_id: pytest.approx(r.p) for r in Q.range_probability(bins, q).collect()} == want


def test_batches_of_many_new_values(spark, monkeypatch):
    """New values beyond the bound widen the nearest bin; no row is lost, and values beyond a real column's ends count too."""
    monkeypatch.setattr(maintain, "NEW", 5)
    old = spark.range(100).selectExpr("cast(id % 10 as double) as x")
    new = spark.range(100).selectExpr("cast(100 + id as double) as x")
    for meta in (MetaType.DISCRETE, MetaType.REAL):
        m = Model(N.assign_ids(histogram_leaf(old, "x", meta, Params(alpha=0.0, real_bins=10), 100)), 100, spark)
        m = maintain.update(m, new)
        got = m.probability(query_frame(spark, [{"x": (-1.0, 1e9)}, {"x": (0.0, 5.0)}, {"x": (50.0, 250.0)}], ["x"])).orderBy("query_id").collect()
        assert m.rows == 200 and abs(got[0].selectivity - 1) < 1e-9 and abs(got[1].selectivity - 0.3) < 0.06 and got[2].selectivity >= 0.5, meta


def test_binary_learner_rows(spark):
    """min_row_ratio of 1 or more is a number of rows; a constant column is a leaf of its own."""
    df = spark.range(2000).selectExpr("cast(id % 2 as int) as a", "cast(id % 2 as int) as b", "cast((id div 2) % 2 as int) as c", "0 as d")
    root = learn_binary(df, ["a", "b", "c", "d"], Params(rows="mle", min_row_ratio=100))
    at = lambda **v: {k: np.array([float(x)]) for k, x in v.items()}
    assert np.allclose(N.probability(root, at(a=1, b=1, c=0, d=0), at(a=1, b=1, c=0, d=0), 1), 0.25, atol=0.01)
    assert N.probability(root, at(a=1, b=0), at(a=1, b=0), 1)[0] < 0.01
