"""Queries and leaves that take all of their rows."""

import numpy as np
import pytest

from statloom.plans import nodes as N
from statloom.plans.learn import Params, joint_leaf
from statloom.plans.model import Model
from statloom.queries import QUERIES
from statloom.sources.context import MetaType
from statloom.sources.workload import query_frame


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_gradients_of_all_rows(spark, sf):
    got = QUERIES["model_gradients"](spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("cast(l_orderkey * 10 + l_linenumber as long) as row")
    assert got.count() == lines.count() and lines.join(got, "row", "left_anti").count() == 0


def test_joint_leaf_of_too_many_cells(spark):
    """8 independent columns of 3 values have 6561 cells, all with rows. No row may be lost to a bound of 100."""
    names = [f"c{i}" for i in range(8)]
    rows = spark.range(3**8).selectExpr(*[f"cast(floor(id / {3**i}) % 3 as double) as {c}" for i, c in enumerate(names)])
    leaf = joint_leaf(rows, names, dict.fromkeys(names, MetaType.DISCRETE), Params(cells=100), 3**8)
    m = Model(N.assign_ids(leaf), 3**8, spark)
    boxes = [{"c0": (0.0, 0.0), "c7": (1.0, 2.0)}, {c: (0.0, 0.0) for c in names}, {"c7": (0.0, 0.0)}]
    got = [r.selectivity for r in m.probability(query_frame(spark, boxes, names)).orderBy("query_id").collect()]
    assert np.allclose(got, [2 / 9, 1 / 3**8, 1 / 3])
