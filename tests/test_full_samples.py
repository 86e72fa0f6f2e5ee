"""Queries that drew four samples draw the reference's 500, or 100 in ensembles."""

import pytest

from slackline.plans import registry

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return registry.queries()[name](spark, SF).toPandas()


@pytest.mark.parametrize("name, low, high", [("mc_forecast", "p80", "p95"), ("mc_teac", "teac_p80", "teac_p95"), ("mc_calibrated", "p80_calibrated", "p95_calibrated")])
def test_percentiles_of_many_samples(spark, name, low, high):
    f = rows(spark, name)
    if name == "mc_calibrated":
        f = f[f.reference_class.isna()]  # its factors are 1
    assert (f[low] < f[high]).any()  # of four samples both are the third
    assert "range(500)" in registry.oracle_sql()[name]


def test_shares_of_a_hundred_samples(spark):
    c = rows(spark, "risk_indices").criticality
    assert ((c * 4) % 1 > 0).any() and "range(100)" in registry.oracle_sql()["risk_indices"]


def test_extremes_of_a_hundred_samples(spark):
    e = rows(spark, "extreme_activities")
    assert e.dragon_king.any() and (e.cap_share < 0.25).any() and "range(100)" in registry.oracle_sql()["extreme_activities"]
