"""The model's operators on graphs small enough to enumerate."""

import itertools

import numpy as np
import pytest

from statloom.functions.rdc import components, rdc_matrix
from statloom.operators import families as P
from statloom.operators.columns import ChowLiuTree, stability_p_value
from statloom.plans import nodes as N
from statloom.plans.learn import Operation, Params, Task, learn, next_operation
from statloom.plans.model import Model
from statloom.sources.context import Context, MetaType, StatType
from statloom.sources.toy import TABLES, toy
from statloom.sources.workload import evidence_queries, read_npy_queries, read_table
from statloom.streaming.maintain import follow, update

INF = float("inf")


def leaf(c, p):
    x = np.arange(len(p), dtype=float)
    out = N.Leaf([c], lo=x - 0.5, hi=x + 0.5, pdf=p, rows=100.0)
    out.value = x
    return out


def graph():
    """P(a, b) given in two boxes of a, times a mixture over c."""
    right = N.Split(["b"], [leaf("b", [0.9, 0.1]), leaf("b", [0.2, 0.8])], boxes=[{"a": (-INF, 0.0)}, {"a": (1.0, INF)}], weights=np.array([0.3, 0.7]), rows=100.0)
    f = N.Factorize(["a", "b"], [leaf("a", [0.3, 0.5, 0.2]), right], condition=["a"])
    s = N.Sum(["c"], [leaf("c", [1.0, 0.0]), leaf("c", [0.25, 0.75])], weights=np.array([0.4, 0.6]), centres=[np.array([0.0]), np.array([1.0])], rows=100.0)
    return N.assign_ids(N.Product(["a", "b", "c"], [f, s]))


def joint():
    t = {}
    for a, b, c in itertools.product(range(3), range(2), range(2)):
        pb = [0.9, 0.1][b] if a == 0 else [0.2, 0.8][b]
        t[a, b, c] = [0.3, 0.5, 0.2][a] * pb * (0.4 * [1.0, 0.0][c] + 0.6 * [0.25, 0.75][c])
    return t


def test_probability_and_likelihood():
    g, t = graph(), joint()
    assert not N.validate(g)
    for (a0, a1), (b0, b1), (c0, c1) in itertools.product([(0, 0), (0, 1), (1, 2), (0, 2)], [(0, 1), (1, 1)], [(0, 0), (0, 1)]):
        want = sum(p for (a, b, c), p in t.items() if a0 <= a <= a1 and b0 <= b <= b1 and c0 <= c <= c1)
        got = N.probability(g, {"a": np.array([a0 * 1.0]), "b": np.array([b0 * 1.0]), "c": np.array([c0 * 1.0])}, {"a": np.array([a1 * 1.0]), "b": np.array([b1 * 1.0]), "c": np.array([c1 * 1.0])}, 1)[0]
        assert got == pytest.approx(want)
    keys = [k for k, p in t.items() if p > 0]
    x = {n: np.array([k[i] for k in keys], float) for i, n in enumerate("abc")}
    assert np.exp(N.log_likelihood(g, x, len(keys))) == pytest.approx([t[k] for k in keys])
    x["a"] = np.full(len(keys), np.nan)
    want = [sum(p for (_, b, c), p in t.items() if (b, c) == k[1:]) for k in keys]
    assert np.exp(N.log_likelihood(g, x, len(keys))) == pytest.approx(want)


def test_moments_conditions_marginals():
    g, t = graph(), joint()
    m = N.moments(g, 1)
    for i, c in enumerate("abc"):
        assert m[c] == pytest.approx(sum(k[i] * p for k, p in t.items()))
    e = N.expectation(g, {"a": np.array([1.0])}, {"a": np.array([2.0])}, 1, {"b": 1})[0]
    assert e == pytest.approx(sum(k[1] * p for k, p in t.items() if k[0] >= 1))
    cond, ll = N.condition(g, {"b": 1.0})
    pb = sum(p for k, p in t.items() if k[1] == 1)
    assert np.exp(ll) == pytest.approx(pb)
    got = N.probability(cond, {"a": np.array([0.0])}, {"a": np.array([0.0])}, 1)[0]
    assert got == pytest.approx(sum(p for k, p in t.items() if k[1] == 1 and k[0] == 0) / pb)
    mar = N.marginalize(g, ["b", "c"])
    assert N.probability(mar, {"b": np.array([1.0])}, {"b": np.array([1.0])}, 1)[0] == pytest.approx(pb)
    assert N.condition(g, {"b": 9.0})[0] is None


def test_algebra():
    g = graph()
    assert N.stats(g)["nodes"] == len(N.copy(g).walk()) == 9
    flat = N.prune(N.Product(["a", "c"], [N.Product(["a"], [leaf("a", [1.0])]), leaf("c", [1.0])]))
    assert [c.kind for c in flat.children] == ["leaf", "leaf"]
    twins = N.compress(N.Sum(["a"], [leaf("a", [0.5, 0.5]), leaf("a", [0.5, 0.5])], weights=np.array([0.5, 0.5])))
    assert twins.children[0] is twins.children[1]
    wide = N.limit_fan_out(N.Sum(["a"], [leaf("a", [1.0]) for _ in range(25)], weights=np.full(25, 0.04)), 10)
    assert len(wide.children) == 3 and wide.weights.sum() == pytest.approx(1)
    assert N.validate(N.Sum(["a"], [leaf("a", [1.0])], weights=np.array([0.7])))


def test_completion_samples_gradients_em():
    g, t = graph(), joint()
    out = N.complete(g, {"a": np.array([np.nan, 0.0]), "b": np.array([1.0, np.nan]), "c": np.array([np.nan, np.nan])}, 2)
    assert out["b"][1] == 0 and not any(np.isnan(v).any() for v in out.values())
    n = 4000
    draws = N.complete(g, {c: np.full(n, np.nan) for c in "abc"}, n, np.random.default_rng(3))
    assert np.mean((draws["a"] == 0) & (draws["b"] == 0)) == pytest.approx(0.27, abs=0.03)
    x = {c: np.array([1.0]) for c in "abc"}
    assert all(np.isfinite(v).all() for v in N.feature_gradients(g, x, 1).values())
    s = N.assign_ids(N.Sum(["c"], [leaf("c", [0.9, 0.1]), leaf("c", [0.1, 0.9])], weights=np.array([0.5, 0.5])))
    sums = N.em_step_sums(s, {"c": np.array([1.0, 1.0, 0.0])}, 3)[0]
    assert sums == pytest.approx([0.1 + 0.1 + 0.9, 0.9 + 0.9 + 0.1])


def test_planner():
    p, t = Params(), Task(None, ["a", "b"], [], ([None], 0))
    one = np.array([[1, 0.9], [0.9, 1]])
    d = {"a": 5, "b": 5, "c": 5}
    assert next_operation(t, 1000, 10, d, one, p)[0] is Operation.CREATE_LEAF
    assert next_operation(t, 1000, 10, d, np.eye(2), p) == (Operation.SPLIT_COLUMNS, [["a"], ["b"]])
    assert next_operation(t, 1000, 10, d, np.array([[1, 0.5], [0.5, 1]]), p)[0] is Operation.SPLIT_ROWS
    assert next_operation(t, 1000, 10, d | {"a": 1}, one, p)[0] is Operation.REMOVE_UNINFORMATIVE
    t3 = Task(None, ["a"], ["b"], ([None], 0))
    assert next_operation(t3, 1000, 10, d, one, p)[0] is Operation.SPLIT_ROWS_CONDITION
    assert next_operation(t3, 1000, 10, d, np.eye(2), p) == (Operation.REMOVE_CONDITION, ["b"])
    three = np.array([[1, 0.9, 0.5], [0.9, 1, 0.5], [0.5, 0.5, 1]])
    assert next_operation(Task(None, ["a", "b", "c"], [], ([None], 0)), 1000, 10, d, three, p) == (Operation.FACTORIZE, ["a", "b"])


def test_rdc_finds_groups():
    r = np.random.default_rng(1)
    a = r.integers(0, 10, 5000).astype(float)
    x = np.stack([a, a + r.integers(0, 2, 5000), r.integers(0, 30, 5000)], 1)
    m = rdc_matrix(x, [True, True, True])
    assert m[0, 1] > 0.9 and m[0, 2] < 0.2 and components(m > 0.3) == [[0, 1], [2]]


def test_tree_sums_to_one(spark):
    df = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (1, 1, 0), (0, 0, 0), (1, 0, 1)], "x int, y int, z int")
    t = ChowLiuTree.fit(df, ["x", "y", "z"])
    every = np.array(list(itertools.product([0, 1], repeat=3)), float)
    p = np.exp(t.log_likelihood(every))
    assert p.sum() == pytest.approx(1, abs=1e-6)
    holes = every.copy()
    holes[:, 1] = np.nan
    assert np.exp(t.log_likelihood(holes))[0] == pytest.approx(p[[i for i, e in enumerate(every) if e[0] == 0 and e[2] == 0]].sum())
    best = t.most_probable(np.full((1, 3), np.nan))[0]
    assert p[[i for i, e in enumerate(every) if (e == best).all()][0]] == pytest.approx(p.max())
    assert not np.isnan(t.sample(np.full((50, 3), np.nan), np.random.default_rng(0))).any()


def test_families(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 25)], "x double")
    p = [r[0] for r in df.select(F.exp(P.log_density("poisson", F.col("x"), 3.0))).collect()]
    assert p[:3] == pytest.approx([0.049787, 0.149361, 0.224042], abs=1e-5)
    for family, a, b in (("gaussian", 2.0, 1.5), ("lognormal", 0.1, 0.4), ("gamma", 3.0, 2.0), ("exponential", 0.5, None), ("uniform", 0.0, 4.0)):
        x = np.linspace(1e-6, 60, 60001) if family != "gaussian" else np.linspace(-20, 24, 44001)
        got = np.exp(np.array([r[0] for r in spark.createDataFrame([(float(v),) for v in x[:: len(x) // 400]], "x double").select(P.log_density(family, F.col("x"), a, b)).collect()]))
        assert np.all(got >= 0)
        assert P.moment(family, 2, a, b) >= P.moment(family, 1, a, b) ** 2 - 1e-9
        assert np.isfinite(P.mode(family, a, b))
    assert stability_p_value(0.0) == 1.0 and stability_p_value(40.0) < 1e-4


def test_learn_store_update_follow(spark, tmp_path):
    df = toy(spark, "medium_corr_cat", 4000).cache()
    ctx = Context.categorical(df, ["a1", "a2", "a5", "a9"])
    assert StatType.COUNT.meta is MetaType.DISCRETE and ctx.groupable()
    root = learn(df.select("a1", "a2", "a5", "a9"), ctx)
    m = Model(root, 4000, spark)
    m.save(f"{tmp_path}/m")
    back = Model.load(spark, f"{tmp_path}/m")
    q = spark.createDataFrame([(0, 2.0, 5.0, 3.0, 3.0), (1, None, None, 1.0, 4.0)], "query_id long, a1_lo double, a1_hi double, a2_lo double, a2_hi double")
    a, b = m.probability(q).toPandas(), back.probability(q).toPandas()
    assert a["selectivity"].tolist() == pytest.approx(b["selectivity"].tolist())
    truth = df.where("a1 between 2 and 5 and a2 = 3").count() / 4000
    assert a["selectivity"][0] == pytest.approx(truth, rel=0.2)
    batch = df.limit(500).cache()
    grown = update(m, batch)
    again = update(grown, batch, -1)
    assert grown.rows == 4500 and again.rows == 4000
    assert again.probability(q).toPandas()["selectivity"].tolist() == pytest.approx(a["selectivity"].tolist())
    batch.write.parquet(f"{tmp_path}/in")
    s = follow(m, spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/v", f"{tmp_path}/cp")
    s.processAllAvailable()
    s.stop()
    assert Model.load(spark, f"{tmp_path}/v/v0").rows == 4500


def test_sources(spark, tmp_path):
    for name in TABLES:
        assert toy(spark, name, 50).dropna().count() == 50
    spark.range(5).write.json(f"{tmp_path}/j")
    assert read_table(spark, f"{tmp_path}/j", "json").count() == 5
    np.save(f"{tmp_path}/lo.npy", np.array([[1.0, -np.inf]]))
    np.save(f"{tmp_path}/hi.npy", np.array([[2.0, np.inf]]))
    assert read_npy_queries(spark, f"{tmp_path}/lo.npy", f"{tmp_path}/hi.npy", ["x", "y"]).first().x_hi == 2.0
    df = toy(spark, "strong_corr_cat", 300)
    evidence, queries, truth = evidence_queries(df, df.columns[:4], 1)
    assert len(evidence) == 2 and sum(r.truth for r in truth.collect()) == pytest.approx(1.0)
