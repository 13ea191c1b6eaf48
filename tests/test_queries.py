"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from statloom.queries import QUERIES, SQL


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    norm = lambda d: d[cols].apply(lambda c: c.astype(float).round(6) if c.dtype.kind in "if" else c.astype(str)).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(norm(a), norm(b), check_dtype=False, atol=1e-6)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, duck, name):
    same(QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", ["kmeans_split", "gmm_split", "rdc_split"])
def test_clusters(spark, sf, name):
    """Two clusters that share all rows, the same at every run."""
    got = [sorted((r.part, r.n, round(r.share, 9)) for r in QUERIES[name](spark, sf).collect()) for _ in range(2)]
    assert got[0] == got[1] and len(got[0]) == 2 and abs(sum(s for _, _, s in got[0]) - 1) < 1e-6


def test_dependence(spark, sf):
    """Columns made from each other depend strongly, others hardly; a cut of a column lies inside it."""
    m = {frozenset((r.i, r.j)): r.rdc for r in QUERIES["rdc_matrix"](spark, sf).collect()}
    assert m[frozenset("ab")] > 0.9 and m[frozenset("ac")] > 0.3 and m[frozenset("ad")] < 0.3 and m[frozenset("de")] < 0.3
    assert 0 <= QUERIES["searched_cut"](spark, sf).first().cut <= 9
    boxes = QUERIES["condition_clusters"](spark, sf).collect()
    assert len(boxes) == 2 and all(r.d_lo <= r.d_hi and r.e_lo <= r.e_hi for r in boxes)


def test_kernel_histogram(spark, sf):
    got = QUERIES["kernel_histogram"](spark, sf).toPandas().sort_values("bin")
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    assert len(got) == 60 and abs(got["pdf"].sum() - 1) < 1e-9 and (got["lo"].to_numpy()[1:] == got["hi"].to_numpy()[:-1]).all()
    middle = (got["lo"] + got["hi"]) / 2
    assert abs((middle * got["pdf"]).sum() - rows.agg({"c_acctbal": "avg"}).first()[0]) < 300


def test_samples(spark, sf):
    got = QUERIES["model_samples"](spark, sf).toPandas()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("avg(l_quantity) as q", "avg(l_linenumber) as k").first()
    assert len(got) == 1000 and abs(got["q"].mean() - lines.q) < 2 and abs(got["k"].mean() - lines.k) < 0.3


def test_learned_cardinalities(spark, sf):
    q = QUERIES["cardinalities"](spark, sf).toPandas()
    assert q["q_error"].median() < 1.5
    c = QUERIES["model_conditioned"](spark, sf).toPandas()
    assert abs(c["selectivity"].sum() - 1) < 0.05
    assert QUERIES["model_marginal"](spark, sf).first().selectivity > 0
    assert QUERIES["model_gradients"](spark, sf).count() > 0
