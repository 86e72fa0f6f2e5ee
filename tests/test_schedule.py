"""Known answers of small schedules, cycles and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slackline.functions import reference_classes, stats, units
from slackline.functions.order_stats import index_percentiles
from slackline.operators import calendar, community, cpm, ensemble, evm, health, montecarlo, outcomes, paths, sanitise, solver
from slackline.streaming import progress

ACT = "project_id long, id string, seq int, duration double"
LNK = "project_id long, source string, target string, rel string, lag double, ord int"


def network(spark, durations: dict, links: list):
    acts = spark.createDataFrame([(1, k, i + 1, v) for i, (k, v) in enumerate(durations.items())], ACT)
    rows = [(1, a, b, *(rest or ["FS", 0.0]), i) for i, (a, b, *rest) in enumerate(links)]
    return acts, spark.createDataFrame(rows, LNK)


def dates(acts, links):
    return {r.id: r for r in cpm.cpm(acts, links).collect()}


def test_linear_and_diamond(spark):
    a = network(spark, {"A": 10.0, "B": 20.0, "C": 5.0}, [("A", "B"), ("B", "C")])
    d = dates(*a)
    assert d["C"].makespan == 35 and all(r.critical for r in d.values())
    a = network(spark, {"A": 10.0, "B": 15.0, "C": 8.0, "D": 12.0, "E": 5.0}, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")])
    d = dates(*a)
    assert d["E"].makespan == 42 and d["C"].tf == 7
    assert [r.id for r in sorted(cpm.critical_path(*a).collect(), key=lambda r: r.pos)] == ["A", "B", "D", "E"]


def test_relations_and_lags(spark):
    a = network(spark, {"A": 10.0, "B": 5.0, "C": 8.0, "D": 3.0}, [("A", "B", "SS", 2.0), ("A", "C"), ("B", "D"), ("C", "D")])
    d = dates(*a)
    assert (d["B"].es, d["C"].es, d["D"].es, d["D"].makespan) == (2, 10, 18, 21)
    a = network(spark, {"A": 10.0, "B": 5.0, "C": 8.0, "D": 3.0}, [("A", "B", "FS", 2.0), ("A", "C"), ("B", "D", "FF", 1.0), ("C", "D")])
    d = dates(*a)
    assert (d["D"].es, d["D"].makespan) == (18, 21)
    assert dates(*network(spark, {"X": 7.0}, [("X", "X"), ("X", "gone")]))["X"].makespan == 7
    assert dates(*network(spark, {"A": 5.0, "B": 2.0}, [("A", "B", "FS", -9.0)]))["B"].es == 0


def test_parallel_paths(spark):
    a = network(spark, {"A": 5.0, "B": 30.0, "C": 29.0, "D": 28.0, "E": 27.0, "F": 7.0}, [("A", x) for x in "BCDE"] + [(x, "F") for x in "BCDE"])
    got = cpm.path_durations(*a).collect()
    assert sorted((r.duration, r.path) for r in got) == [(39.0, "A>E>F"), (40.0, "A>D>F"), (41.0, "A>C>F"), (42.0, "A>B>F")]
    assert cpm.path_durations(*a, most_paths=3).count() == 0


def test_cycles_follow_input_order(spark):
    a = network(spark, {"A": 1.0, "B": 2.0, "C": 3.0}, [("A", "B"), ("B", "C"), ("C", "A")])
    d = dates(*a)
    assert (d["A"].es, d["B"].es, d["C"].es, d["C"].makespan) == (0, 1, 3, 6)


def test_empty_tables(spark):
    acts, links = spark.createDataFrame([], ACT), spark.createDataFrame([], LNK)
    assert cpm.cpm(acts, links).count() == 0 and cpm.critical_path(acts, links).count() == 0
    alone = spark.createDataFrame([(1, "A", 1, None)], ACT)
    assert dates(alone, links)["A"].makespan == 0


def test_pagerank_against_power_iteration(spark):
    rng = np.random.default_rng(2)
    n = 12
    pairs = sorted({(int(i), int(j)) for i, j in rng.integers(0, n, (30, 2)) if i < j})
    acts, links = network(spark, {str(i): 1.0 for i in range(n)}, [(str(i), str(j)) for i, j in pairs])
    w = {p: float(v) for p, v in zip(pairs, rng.integers(1, 5, len(pairs)))}
    links = links.withColumn("duration", F.element_at(F.create_map(*[F.lit(x) for (i, j), v in w.items() for x in (f"{i}-{j}", v)]), F.concat_ws("-", "source", "target")))
    got = {int(r.id): r for r in health.centralities(acts, links).collect()}
    m = np.zeros((n, n))
    for (i, j), v in w.items():
        m[i, j] = v
    out = m.sum(1)
    rank = np.full(n, 1 / n)
    for _ in range(200):
        rank = 0.9 * ((m / np.where(out == 0, 1, out)[:, None]).T @ rank + rank[out == 0].sum() / n) + 0.1 / n
    assert np.allclose([got[i].pagerank for i in range(n)], rank, atol=1e-5)
    far = np.full((n, n), np.inf)
    for i, j in pairs:
        far[i, j] = 1
    for k in range(n):
        far = np.minimum(far, far[:, [k]] + far[[k], :])
    for j in range(n):
        seen = [far[i, j] for i in range(n) if i != j and np.isfinite(far[i, j])]
        assert got[j].closeness == pytest.approx(len(seen) / sum(seen) * len(seen) / (n - 1) if seen else 0)


def test_louvain_finds_cliques(spark):
    names = [f"{c}{i}" for c in "abc" for i in range(5)]
    links = [(f"{c}{i}", f"{c}{j}") for c in "abc" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0"), ("b1", "c1")]
    acts, lnk = network(spark, dict.fromkeys(names, 1.0), links)
    got = community.communities(acts, lnk)
    assert {r.id: r.community for r in got.collect()} == {x: "abc".index(x[0]) for x in names}
    q = community.modularity(got, lnk).first().modularity
    m = len(links)
    assert q == pytest.approx(sum(10 / m - (d / (2 * m)) ** 2 for d in (21, 22, 21)))


def test_quantiles(spark):
    from statistics import NormalDist

    u = [1e-10, 1e-4, 0.02, 0.075, 0.3, 0.5, 0.8, 0.93, 0.999, 1 - 1e-10]
    df = spark.createDataFrame([(x,) for x in u], "u double")
    got = [r.z for r in df.select(F.expr(stats.ndtri("u")).alias("z")).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(x) for x in u], rtol=1e-9)
    one = df.select(F.expr(stats.multiplier("u", "0e0", "0.05e0", "0.55e0", "10e0")).alias("m")).distinct().collect()
    assert [r.m for r in one] == [1.0]


def test_order_statistics_of_a_hot_group(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 3000) / 7
    rows = [("hot" if i % 3 else f"g{i % 5}", float(x)) for i, x in enumerate(v)]
    got = {r.g: r for r in index_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p80": 0.8, "p95": 0.95}).collect()}
    for g, r in got.items():
        s = sorted(x for k, x in rows if k == g)
        assert (r.n, r.p50, r.p80, r.p95) == (len(s), *(s[int(p * (len(s) - 1))] for p in (0.5, 0.8, 0.95)))


def test_forecast_without_risk_is_the_expected_finish(spark):
    acts, links = network(spark, {"A": 10.0, "B": 20.0, "C": 5.0}, [("A", "B", "SS", 4.0), ("B", "C", "FF", 2.0)])
    acts = acts.withColumns({"remaining": F.col("duration"), "base": F.lit(0.0), "risk": F.lit(0.0), "fat": F.lit(0.55)})
    r = montecarlo.forecast(acts, links, 6).first()
    assert r.expected == 26.0 and r.finishes == [26.0] * 6


def test_calendar_advance(spark):
    cal = calendar.calendar(spark, "2024-01-01", 60, holidays=("2024-01-10",))
    rows = [("2024-01-05 09:00:00", 8.0, "2024-01-08 09:00:00"), ("2024-01-06 09:00:00", 4.0, "2024-01-08 13:00:00"), ("2024-01-09 10:00:00", 8.0, "2024-01-11 10:00:00"), ("2024-01-06 09:00:00", 0.0, "2024-01-06 09:00:00"), ("2024-01-04 20:00:00", 12.0, "2024-01-08 00:00:00")]
    df = spark.createDataFrame(rows, "s string, h double, want string").withColumn("start", F.to_timestamp_ntz("s"))
    for r in calendar.advance(df, cal, "start", "h", "2024-01-01", 60).collect():
        assert str(r.finished) == r.want
    assert calendar.horizon_days(0) == 30 and calendar.horizon_days(800) == 600 and calendar.horizon_days(1e6) == 3650


def test_units(spark):
    df = spark.createDataFrame([("3", "m", 0.05), ("2", "mo", 2 * 4.345 * 40), ("1", "Years", 52.14 * 40), ("x", "h", 0.0), ("-1", "h", 0.0), (None, None, 0.0), ("5", "", 5.0), ("2", "fortnight", 2.0)], "d string, u string, want double")
    for r in df.select("want", units.to_hours(F.col("d"), F.col("u")).alias("got")).collect():
        assert r.got == pytest.approx(r.want)
    p = spark.createDataFrame([("50%", 0.5), (".5", 0.005), ("150", 1.0), ("-3", 0.0), ("", 0.0), (None, 0.0), ("NaN", 0.0)], "x string, want double")
    assert all(r.got == pytest.approx(r.want) for r in p.select("want", units.percent(F.col("x")).alias("got")).collect())
    s = spark.createDataFrame([("Oil and Gas development", 0.64), ("facility", 0.28), (None, 0.25), ("Rail", 0.45)], "x string, want double")
    assert all(r.got == r.want for r in s.select("want", units.sector_overrun(F.col("x")).alias("got")).collect())


def test_reference_classes(spark):
    df = spark.createDataFrame([("Data Center", "data_centre_hyperscale"), (" RAIL ", "rail"), ("it", "it_software"), ("none", None), (None, None)], "x string, want string")
    assert all(r.got == r.want for r in df.select("want", reference_classes.resolved(F.col("x")).alias("got")).collect())


def test_pareto_and_weights(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 5.0), (1, "b", 2.0, 4.0), (1, "c", 2.0, 5.0), (1, "d", 1.0, 5.0), (2, "e", 9.0, 9.0)], "g int, id string, x double, y double")
    assert sorted(r.id for r in solver.pareto_front(df, "g", ["x", "y"]).collect()) == ["a", "b", "d", "e"]
    v = solver.weight_vectors(["a", "b", "c"], 20)
    assert 3 < len(v) <= 20 and all(sum(x.values()) == pytest.approx(1, abs=1e-5) for x in v)


def test_eac_tiers(spark):
    df = spark.createDataFrame([(100.0, 1.0, 1.0, 5.0, 115.0), (100.0, 0.9, 1.0, 95.0, 95 / 0.9 + 5), (100.0, 0.5, 0.5, 40.0, 300.0), (100.0, 1.0, 1.0, 50.0, 100.0), (0.0, 1.0, 1.0, 50.0, 0.0)], "bac double, cpi double, spi double, pct double, want double")
    for r in df.select("want", evm.eac(F.col("bac"), F.col("cpi"), F.col("spi"), F.col("pct")).alias("got")).collect():
        assert r.got == pytest.approx(r.want)


def test_outcome_store(spark, tmp_path):
    rows = [("rail", "p1", "2024-01-01", "2024-03-01"), ("rail", "p1", "2024-02-01", "2024-04-01"), ("rail", "bad id!", "2024-01-01", "2024-03-01"), ("roads", "p2", "2010-01-01", "2010-03-01"), ("rail", "p3", "2024-01-01", None)]
    df = spark.createDataFrame(rows, "reference_class string, project_id string, submitted_at string, actual_finish string")
    df = df.withColumns({c: F.to_timestamp_ntz(c) for c in ("submitted_at", "actual_finish")})
    path = f"file://{tmp_path}/store"
    outcomes.register(df, path)
    outcomes.register(df.limit(1), path)
    kept = outcomes.latest(spark.read.parquet(path), "2024-06-01 00:00:00").collect()
    assert [(r.reference_class, r.project_id, str(r.actual_finish)[:10]) for r in kept] == [("rail", "p1", "2024-04-01")]


def test_stream_drops_late_and_repeated_events(spark, tmp_path):
    t = "2024-01-01 {}:00"
    first = [(1, "10:05", 1.0), (2, "10:55", 2.0), (2, "10:55", 2.0), (3, "12:00", 4.0)]
    second = [(4, "10:30", 50.0), (5, "12:30", 8.0), (6, "15:00", 0.0)]
    for k, rows in enumerate((first, second)):
        df = spark.createDataFrame([(i, t.format(h), 1, "x", v, "") for i, h, v in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        s = progress.windowed(progress.events(spark, f"file://{tmp_path}/in"))
        out = progress.run_once(s, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    got = sorted((str(r.start)[11:16], r.n, r.total) for r in out.collect())
    assert got == [("10:00", 2, 3.0), ("12:00", 2, 12.0)]


def test_cycles_are_cut_at_the_smallest_link(spark):
    acts, links = network(spark, {"A": 1.0, "B": 1.0, "C": 1.0, "D": 1.0}, [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D")])
    assert [(r.source, r.target) for r in sanitise.removed_links(acts, links).collect()] == [("A", "B")]
    marked = acts.withColumn("milestone", F.col("id").isin("B", "D"))
    got = {(r.source, r.target) for r in sanitise.sanitised(marked, links).collect()}
    assert got == {("B", "C"), ("C", "A"), ("C", "D"), ("A", "D")}
    plain = network(spark, {"A": 1.0, "B": 1.0}, [("A", "B")])
    assert sanitise.removed_links(*plain).count() == 0
    assert {(r.source, r.target) for r in sanitise.sanitised(plain[0].withColumn("milestone", F.lit(False)), plain[1]).collect()} == {("A", "B")}


def test_optimum_is_no_worse_and_within_bounds(spark):
    acts, links = network(spark, {"A": 10.0, "B": 20.0, "C": 5.0, "D": 0.0}, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")])
    acts = acts.withColumns({"risk": F.lit(0.3), "resource_count": F.lit(2.0)})
    rows = {r.id: r for r in ensemble.optimise(acts, links, {"schedule": 1.0}).collect()}
    assert rows["A"].value <= rows["A"].initial_value and rows["A"].schedule_after == pytest.approx(24.0)
    assert all(0.8 * r.duration - 1e-9 <= r.optimised <= r.duration for r in rows.values())
    cheap = {r.id: r.optimised for r in ensemble.optimise(acts, links, {"quality": 1.0}).collect()}
    assert cheap == {"A": 10.0, "B": 20.0, "C": 5.0, "D": 0.0}


def test_resolutions_and_novelty(spark):
    names = [f"{c}{i}" for c in "ab" for i in range(4)]
    links = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(4) for j in range(i + 1, 4)] + [("a3", "b0")]
    acts, lnk = network(spark, dict.fromkeys(names, 1.0), links)
    got = community.multi_resolution(acts, lnk, ladder=(0.05, 1.0)).collect()
    assert {r.community for r in got if r.resolution == 0.05} == {0}
    assert {r.id: r.community for r in got if r.resolution == 1.0} == {x: "ab".index(x[0]) for x in names}
    assert all(r.stability == pytest.approx(1.0) for r in got)
    chains = paths.driving_chains(acts, lnk).collect()
    assert [(r.chain, r.hours, r.selected) for r in chains] == [("a0>a1>a2>a3>b0>b1>b2>b3", 8.0, True)]


def test_full_samples_against_carried_multipliers(spark):
    rng = np.random.default_rng(5)
    names = [f"N{i}" for i in range(14)]
    pairs = sorted({(int(i), int(j)) for i, j in rng.integers(0, 14, (30, 2)) if i < j})
    acts, links = network(spark, {k: float(v) for k, v in zip(names, rng.uniform(8, 400, 14))}, [(names[i], names[j]) for i, j in pairs])
    risk = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.06, 0.1, 0.17, 0.3, 0.5, 0.56, 0.7, 0.79, 0.81, 0.9, 1.0, 0.2, 0.45)]), F.col("seq"))
    acts = acts.withColumns({"remaining": F.col("duration"), "base": F.lit(0.0), "risk": risk, "fat": F.lit(0.55)})
    carried = montecarlo.multipliers(acts, 500)
    a = carried.orderBy("seq").toPandas()
    assert np.allclose(np.concatenate([montecarlo.factors(a, s, 50) for s in range(0, 500, 50)], axis=1), np.stack(a.mult), rtol=1e-9)
    want, got = montecarlo.forecast(acts, links, 500).first(), montecarlo.forecast_sampled(acts, links, 500).first()
    assert len(got.finishes) == 500 and got.expected == want.expected and np.allclose(got.finishes, want.finishes, rtol=1e-9)
    s = montecarlo.summary(montecarlo.forecast_sampled(acts, links, 500)).first()
    finishes = sorted(want.finishes)
    assert [s.p80, s.p95] == pytest.approx([finishes[399], finishes[474]]) and s.p80 < s.p95
    assert montecarlo.forecast_sampled(acts.limit(0), links, 500).count() == 0 and montecarlo.forecast_sampled(acts.withColumn("remaining", F.lit(0.0)), links, 500).count() == 0 and ensemble.risk_indices_sampled(acts.limit(0), links, 100).count() == 0
    want = {r.id: r for r in ensemble.risk_indices(montecarlo.multipliers(acts, 100), links).collect()}
    got = {r.id: r for r in ensemble.risk_indices_sampled(acts, links, 100).collect()}
    assert all(got[k].criticality == r.criticality and got[k].cruciality == pytest.approx(r.cruciality, abs=1e-9) for k, r in want.items())


def test_full_queries_draw_the_references_samples(spark):
    from slackline.plans import registry

    q = registry.queries()
    f = q["mc_forecast_full"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(f) and (f.p95 > f.p80).mean() > 0.5
    c = q["risk_indices_full"](spark, "/root/testdata/sf0.001").toPandas().criticality
    assert np.allclose(c * 100, np.round(c * 100)) and ((c * 4) % 1 > 1e-9).any()


def test_every_path_of_a_large_network(spark):
    names = ["S"] + [f"{s}{i}" for i in range(14) for s in "ab"] + ["E"]
    links = [("S", s + "0") for s in "ab"] + [(f"{s}{i}", f"{t}{i + 1}") for i in range(13) for s in "ab" for t in "ab"] + [(s + "13", "E") for s in "ab"]
    d = {k: float(2 ** int(k[1:])) if k[0] == "a" else 0.0 for k in names}
    got = cpm.path_durations(*network(spark, d, links)).toPandas()
    assert len(got) == 2**14 and got.path.is_unique and (got.length == 16).all()
    assert sorted(got.duration) == list(range(2**14))
    assert all(sum(d[x] for x in r.path.split(">")) == r.duration for r in got.itertuples())


def test_numbers_are_rounded_as_the_sql_does(spark):
    import duckdb

    from slackline.plans.core_queries import rounded

    values = [1.005, 2.675, -1.005, 0.285, 8.345, 0.5, -0.001, 1e15 + 0.3, 0.145]
    got = [r.v for r in rounded(spark.createDataFrame([(v,) for v in values], "v double"), 2, "v").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 2) + 0.0", [v]).fetchone()[0] for v in values]


def test_sums_follow_the_rows_of_the_file(spark):
    rows = spark.createDataFrame([(1, 2, -1e16), (1, 0, 1e16), (1, 1, 1.0), (2, 5, 3.0)], "project_id long, row long, v double").repartition(3)
    assert {r.project_id: r.s for r in evm.sums(rows, s=F.col("v")).collect()} == {1: 0.0, 2: 3.0}


def test_planned_curve_is_exact_where_nothing_is_open(spark):
    rng = np.random.default_rng(5)
    rows = [(p, f"{y}-01-{int(a):02d} 00:00:00", f"{y}-{int(m):02d}-01 00:00:00", float(rng.integers(1, 50)), y) for p in range(40) for y in range(1992, 1998) for a, m in [(rng.integers(1, 28), rng.integers(2, 8))] for _ in range(3)]
    acts = spark.createDataFrame([(p, s, f, h) for p, s, f, h, _ in rows], "project_id long, s string, f string, duration double")
    acts = acts.select("project_id", F.col("s").cast("timestamp_ntz").alias("start"), F.col("f").cast("timestamp_ntz").alias("finish"), "duration")
    last = {(p, y): f for p, _, f, _, y in sorted(rows, key=lambda r: r[2])}
    got = {(r.project_id, str(r.date)): r.planned_hours for r in evm.planned_curve(acts).collect()}
    assert all(got[p, f] == sum(h for q, _, _, h, z in rows if q == p and z <= y) for (p, y), f in last.items())
