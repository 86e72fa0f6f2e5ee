"""Samples made in kernels, against hashlib, carried multipliers and brute force."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from slackline.functions import hashing, stats
from slackline.operators import cpm, montecarlo
from slackline.plans import registry
from slackline.plans.core_queries import schedule
from slackline.sources.star import STATUS_DATE, activities

SF = "/root/testdata/sf0.001"


def test_hashes_of_many_keys():
    keys = [b"", b"7-1", b"a\0", "ü9-1".encode(), b"y" * 200, *[b"x" * n for n in range(44, 54)], *[f"{i}-{i % 9}".encode() for i in range(40)]]
    prefixes = [f"42|{k}|".encode() for k in (0, 1, 9, 10, 99, 100, 249, 1000)]
    want = [[int(md5(p + k).hexdigest()[:13], 16) for p in prefixes] for k in keys]
    assert (hashing.top_bits(prefixes, keys) == want).all() and hashing.top_bits(prefixes, []).shape == (0, 8)


def test_rounding_in_kernels(spark):
    from slackline.plans.core_queries import rounded

    x = [1.005, 2.675, -1.005, 0.285, 8.345, 0.5, -0.001, 1e15 + 0.3, 0.145, 0.49999999999999994, -2.5e-7, 1.00000005, *np.random.default_rng(1).uniform(-3, 3, 200)]
    for places in (0, 2, 7):
        got = [r.v for r in rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double"), places, "v").orderBy("i").collect()]
        assert got == stats.scaled_round(np.array(x), places).tolist()


def test_all_multipliers(spark):
    df = registry.queries()["mc_multipliers_full"](spark, SF)
    assert "md5" not in df._jdf.queryExecution().optimizedPlan().toString()  # 500 hashes an activity as expressions don't end
    some = montecarlo.with_scope(activities(spark, SF), STATUS_DATE).where("project_id < 20")
    want = {(r.id, r.s): r.m for r in montecarlo.multipliers(some, 500).select("id", F.posexplode("mult").alias("s", "m")).collect()}
    got = {(r.id, r.sample): r.mult for r in df.where("project_id < 20").collect()}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-7) for k, v in want.items())


@pytest.mark.parametrize("name, samples", [("extreme_activities", 4), ("extreme_activities_full", 100)])
def test_extremes_by_hand(spark, name, samples):
    df = registry.queries()[name](spark, SF)
    assert "md5" not in df._jdf.queryExecution().optimizedPlan().toString()  # the filter repeated the samples' expressions within each other
    a = montecarlo.with_scope(activities(spark, SF), STATUS_DATE).toPandas()
    m = montecarlo.factors(a, 0, samples)
    unit = lambda x: np.clip(x, 0, 1)
    cap = 6 + 4 * unit(0.6 * unit((a.risk - 0.5) / 0.5) + 0.4 * unit((a.remaining / 8 - 30) / 180)).to_numpy()
    share = (m >= 0.95 * cap[:, None]).mean(1)
    king = (m.max(1) > m.mean(1) + 4 * m.std(1)) & (m.max(1) > 2 * m.mean(1))
    want = {(i, s, s >= 0.1, k) for i, s, k in zip(a.id, share, king) if s >= 0.1 or k}
    assert want and {(r.id, r.cap_share, r.black_swan, r.dragon_king) for r in df.collect()} == want


def test_forecasts_are_summed_up_in_the_kernel(spark):
    a, e = schedule(spark, SF)
    a = montecarlo.with_scope(a, STATUS_DATE).where("project_id % 9 = 0")
    want = {r.project_id: r for r in montecarlo.summary(montecarlo.forecast(a, e, 60)).collect()}
    got = {r.project_id: r for r in montecarlo.summary_sampled(a, e, 60).collect()}
    assert want and got.keys() == want.keys() and all(tuple(got[k]) == pytest.approx(tuple(r)) for k, r in want.items())
    for name in ("mc_forecast_full", "mc_teac_full", "mc_calibrated_full"):
        assert "array_sort" not in registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()  # four sorts of 500 a project, by an interpreted comparison


@pytest.mark.parametrize("fan", [3, 300])
def test_links_that_share_an_end(fan):
    rng = np.random.default_rng(2)
    at = rng.integers(0, 4, fan)
    x, v = rng.uniform(0, 1, (4, 5)), rng.uniform(0, 2, (fan, 5))
    want = x.copy()
    np.maximum.at(want, at, v)
    for k, alone in cpm.in_turns(at, np.arange(fan)):
        assert alone == (fan < 300) and (not alone or len(set(at[k])) == len(k))
        cpm.merge(np.maximum, x, at[k], v[k], alone)
    assert (x == want).all() and cpm.in_turns(at, np.zeros(0, int)) == []
