"""The execution filters' summary: one pass over the observations, and no horizon is lost."""

from barloom.operators import diagnostics as D
from barloom.plans.observations import observations

SF = "/root/testdata/sf0.001"


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_summary_reads_the_observations_once(spark):
    from barloom.plans.catalog import QUERIES

    assert scans(QUERIES["d23b_execution_filter_summary"](spark, SF)) == scans(observations(spark, SF)) > 0


def test_horizon_without_pairs_stays(spark):
    rows = [(60, 1.0, 2.0, 1.0), (60, -1.0, 1.0, 3.0), (60, None, 5.0, None), (180, None, 1.0, None)]
    obs = spark.createDataFrame(rows, "horizon_seconds int, f double, y double, spread double")
    got = {(r.horizon_seconds, r.measure): r.value for r in D.execution_summary(obs, ["horizon_seconds"], ["spread"]).collect()}
    assert got.pop((60, "spread")) == -1.0
    assert got == {(60, "adverse_selection"): -0.5, (180, "adverse_selection"): None, (180, "spread"): None}
