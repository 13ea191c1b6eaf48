"""Queries whose values leave the support or the cells that the given tables have, against their SQL."""

import duckdb
import pytest

from statloom.operators import rows
from statloom.queries import QUERIES, SQL


def both(spark, folder, name: str, table: str, made) -> tuple[dict, dict]:
    """A query's rows by first column, from Spark and from its SQL, on a table of those rows."""
    made.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return {r[0]: tuple(r[1:]) for r in QUERIES[name](spark, str(folder)).collect()}, {r[0]: r[1:] for r in con.execute(SQL[name]).fetchall()}


def test_log_densities(spark, tmp_path):
    """At 0, below it, at null and at what is no number."""
    values = [0.0, -1.5, None, float("nan"), float("inf"), 0.01, 10.0, 200.0, 200.5]
    got, want = both(spark, tmp_path, "log_densities", "events", spark.createDataFrame(list(enumerate(values)), "event_id long, value double"))
    assert len(got) == len(values) and got.keys() == want.keys()
    for k, row in want.items():
        assert [v is None for v in got[k]] == [v is None for v in row], k
        assert [v for v in got[k] if v is not None] == pytest.approx([v for v in row if v is not None], abs=1e-9, nan_ok=True), k


def test_log_densities_to_the_last_bit(spark, tmp_path):
    """Over many values, with logarithms and the order of operations as in the SQL: no result differs in any bit."""
    values = [k / 100 for k in range(1, 20_001)]
    got, want = both(spark, tmp_path, "log_densities", "events", spark.createDataFrame(list(enumerate(values)), "event_id long, value double"))
    assert got == want and len(got) == len(values)


def test_density_of_chained_and_odd_rows(spark, tmp_path):
    """A chain of many cells, sparse rows at its side, and values that are near nothing."""
    x = [100.0 * k for k in range(0, 1200, 2) for _ in range(2)] + [250_000.0, 250_150.0, 250_350.0, float("nan"), float("nan"), float("nan"), None, float("inf"), float("inf"), float("-inf")]
    made = spark.createDataFrame([(i, v) for i, v in enumerate(reversed(x))], "s_suppkey long, s_acctbal double")
    got, want = both(spark, tmp_path, "density_split", "supplier", made)
    assert got == want and {p for (p,) in got.values()} >= {None, 10}


@pytest.mark.parametrize("part", [1_000_000, 40])
def test_density_takes_few_jobs(spark, monkeypatch, part):
    """The number of jobs doesn't grow with the length of a chain of cells, as its links are contracted in tasks."""
    monkeypatch.setattr(rows, "PART", part, raising=False)
    df = spark.range(600).selectExpr("id as row", "cast(id * 1.5 as double) as x")
    group = f"density-{part}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = rows.density_split(df, ["x"], 2.0, 3).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.part for r in got} == {1} and len(got) == 600  # rows 0 and 599 have two neighbours: at the edge, not core
    if part == 1_000_000:
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 60
