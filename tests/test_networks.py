"""Kernels over networks against brute force: deep and cyclic ones, centralities, longest paths, predictions."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from slackline.operators import analytics, community, cpm, ensemble, evm, health, inputs, longest, sanitise
from slackline.plans.core_queries import schedule
from slackline.plans.grouped import graph_apply

ACT = "project_id long, seq int, id string, duration double, risk double, resource_count double"
LNK = "project_id long, source string, target string, rel string, lag double, ord int, duration double"


def network(spark, acts, links):
    """acts: {project: durations}; links: (project, from, to, relation, lag)."""
    a = [(p, i, f"{p}-{i}", float(d), 0.1 * (i % 5), 1.0) for p, ds in acts.items() for i, d in enumerate(ds)]
    e = [(p, f"{p}-{s}", f"{p}-{t}", r, float(g), k, 1.0) for k, (p, s, t, r, g) in enumerate(links)]
    return spark.createDataFrame(a, ACT), spark.createDataFrame(e, LNK)


def random_links(seed, p, n, m):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(m):
        s, t = sorted(rng.choice(n, 2, replace=False).tolist())
        out.append((p, s, t, str(rng.choice(["FS", "SS", "FF", "SF"])), int(rng.integers(-3, 4))))
    return out


def all_paths(n, links):
    succ = {v: [x for x in links if x[1] == v] for v in range(n)}
    starts = [v for v in range(n) if not any(x[2] == v for x in links)]
    done, todo = [], [[(v, None)] for v in starts]
    while todo:
        path = todo.pop()
        out = succ[path[-1][0]]
        if not out:
            done.append(path)
        todo += [[*path, (x[2], x)] for x in out]
    return done


def test_longest_paths_against_all(spark):
    acts = {1: np.arange(1, 13), 2: [5.0], 3: [0, 0, 2], 4: np.full(10, 3.0)}
    links = random_links(1, 1, 12, 26) + [(3, 0, 1, "FS", 0), (3, 0, 2, "SF", 1), (3, 0, 2, "FS", 1)] + random_links(2, 4, 10, 20)
    got = longest.longest_paths(*network(spark, acts, links), most=7).collect()
    for p, d in acts.items():
        own = [x for x in links if x[0] == p]
        want = sorted((-sum(d[v] + (x[4] if x else 0) for v, x in path), ">".join(f"{p}-{v}" for v, _ in path)) for path in all_paths(len(d), own))
        rows = sorted((r for r in got if r.project_id == p), key=lambda r: r["rank"])
        assert [(-r.estimate, r.path) for r in rows] == [(pytest.approx(s), t) for s, t in want[:7]]
        assert all(r.n_paths == len(want) and r.truncated == (len(want) > 7) for r in rows)
    exact = {(r.project_id, r.path, round(r.duration, 6)) for r in cpm.path_durations(*network(spark, acts, links)).collect()}
    assert all((r.project_id, r.path, round(r.duration, 6)) in exact for r in got)  # parallel links make paths of one text
    none = network(spark, {1: [1.0]}, [(1, 0, 0, "FS", 0)])
    assert longest.longest_paths(none[0].where("false"), none[1]).count() == 0


def test_ladder_of_many_paths_is_flagged(spark):
    """Fourteen times two ways: 16,384 paths, none of them followed one by one."""
    links = [(1, 3 * k, 3 * k + j, "FS", 0) for k in range(14) for j in (1, 2)] + [(1, 3 * k + j, 3 * k + 3, "FS", 0) for k in range(14) for j in (1, 2)]
    a, e = network(spark, {1: [1.0 + (i % 3 == 2) for i in range(43)]}, links)
    rows = sorted(longest.longest_paths(a, e, most=15).collect(), key=lambda r: r["rank"])
    assert rows[0].n_paths == 2**14 and rows[0].truncated and len(rows) == 15
    assert rows[0].estimate == 15 + 28 and [r.estimate for r in rows[1:]] == [42.0] * 14


def test_deep_networks(spark):
    n = 3000
    chain = [(1, i, i + 1, "FS", 0) for i in range(n - 1)]
    a, e = network(spark, {1: np.ones(n)}, chain)
    assert cpm.cpm(a, e).agg(F.max("makespan")).first()[0] == n
    back = e.unionByName(spark.createDataFrame([(1, f"1-{n - 1}", "1-0", "FS", 0.0, n, 1.0)], LNK))
    assert cpm.cpm(a, back).agg(F.max("makespan")).first()[0] == n  # the link against the input order is left out
    r = health.centralities(a, e).orderBy("id").toPandas().set_index("id")
    assert r.closeness["1-1"] == pytest.approx(1 / (n - 1)) and r.clustering.max() == 0
    assert r.closeness[f"1-{n - 1}"] == pytest.approx((n - 1) / (n * (n - 1) / 2))


@pytest.mark.parametrize("block", [3, 256])
def test_centralities_against_dense(monkeypatch, block):
    monkeypatch.setattr(health, "BLOCK", block)
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (2, 1), (30, 60), (40, 300)):
        pair = np.unique(rng.integers(0, n, (m, 2)), axis=0) if m else np.zeros((0, 2), int)
        pair = pair[pair[:, 0] != pair[:, 1]]
        adj = np.zeros((n, n), bool)
        adj[pair[:, 0], pair[:, 1]] = True
        dist = np.where(adj, 1.0, np.inf)
        np.fill_diagonal(dist, 0)
        for k in range(n):
            dist = np.minimum(dist, dist[:, k : k + 1] + dist[k : k + 1])
        reach = np.isfinite(dist)
        total, seen = np.where(reach, dist, 0).sum(0), reach.sum(0) - 1
        want = np.where(total > 0, seen / np.maximum(total, 1) * seen / max(n - 1, 1), 0)
        assert np.allclose(health.closeness(n, pair[:, 0], pair[:, 1], np.full(n, float(n))), want)
        und = (adj | adj.T).astype(float)
        k = und.sum(1)
        tri = ((und @ und) * und).sum(1)
        assert np.allclose(health.clustering(n, pair[:, 0], pair[:, 1]), np.where(k > 1, tri / np.maximum(k * (k - 1), 1), 0))


def test_between_and_downstream(spark):
    a, e = network(spark, {1: np.ones(7)}, [(1, 0, 1, "FS", 0), (1, 1, 2, "FS", 0), (1, 2, 5, "FS", 0), (1, 0, 3, "FS", 0), (1, 4, 2, "FS", 0), (1, 5, 6, "FS", 0)])
    marked = a.withColumn("is_start", F.col("seq") == 0).withColumn("is_end", F.col("seq") == 5)
    assert sorted(r.id for r in longest.between(marked, e).collect()) == ["1-0", "1-1", "1-2", "1-5"]
    assert [(r.id, r.hops) for r in longest.downstream(marked, e, hops=2, most=3).collect()] == [("1-1", 1), ("1-3", 1), ("1-2", 2)]


def test_risk_on_cycles(spark):
    links = [(1, 0, 1, "FS", 0), (1, 1, 2, "FS", 0), (1, 2, 1, "FS", 0), (1, 2, 3, "FS", 0), (2, 0, 1, "FS", 0), (2, 1, 0, "FS", 0), (3, 0, 1, "FS", 0), (3, 0, 1, "SS", 0), (3, 1, 2, "FS", 0)]
    a, e = network(spark, {1: np.ones(4), 2: np.ones(2), 3: np.ones(3)}, links)
    few = {r.id: r for r in sanitise.risk_on_cycles(a, e).collect()}
    assert not few["1-1"].converged and few["1-1"].propagated_risk == pytest.approx(0.1)  # fifty damped rounds leave more than 1e-9
    got = {r.id: r for r in sanitise.risk_on_cycles(a, e, rounds=300).collect()}
    # 1: x1 = .1 + (x0 + x2) / 2, x2 = .2 + x1; x0 = 0
    assert (got["1-1"].propagated_risk, got["1-2"].propagated_risk, got["1-3"].propagated_risk) == pytest.approx((0.4, 0.6, 0.9), abs=2e-4)
    assert not got["2-0"].converged and got["2-1"].propagated_risk == pytest.approx(0.1) and got["2-0"].on_cycle  # nothing feeds it from outside
    plain = {r.id: r.propagated_risk for r in cpm.risk_propagation(a.where("project_id = 3"), e.where("project_id = 3")).collect()}
    assert {i: got[i].propagated_risk for i in plain} == pytest.approx(plain)


def test_components_of_cycles():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n, m = 12, int(rng.integers(0, 30))
        pair = rng.integers(0, n, (m, 2))
        reach = np.eye(n, dtype=bool)
        reach[pair[:, 0], pair[:, 1]] = True
        for k in range(n):
            reach |= reach[:, k : k + 1] & reach[k : k + 1]
        part = sanitise.components_of_cycles(n, pair[:, 0], pair[:, 1])
        assert all((part[i] == part[j]) == (reach[i, j] and reach[j, i]) for i, j in itertools.product(range(n), repeat=2))
        assert all(part[s] >= part[t] for s, t in pair)


def test_propagated_predictions_against_one_by_one(spark):
    rng = np.random.default_rng(8)
    n, monday = 14, dt.datetime(2024, 1, 1)
    days = [d for d in (dt.date(2023, 12, 1) + dt.timedelta(i) for i in range(400)) if d.weekday() < 5 and d != dt.date(2024, 1, 8)]
    links = random_links(4, 1, n, 24)
    rows = []
    for i in range(n):
        begun = i < 4
        rows.append((1, i, f"1-{i}", float(rng.integers(0, 40)), 50.0 if begun else 0.0, monday if begun else None, monday + dt.timedelta(3) if i == 0 else None, 1.4, float(rng.integers(1, 40)), monday + dt.timedelta(int(rng.integers(0, 9))), i == 3))
    a = spark.createDataFrame(rows, "project_id long, seq int, id string, duration double, pct double, actual_start timestamp_ntz, actual_finish timestamp_ntz, performance_delta double, predicted_hours double, predicted_start timestamp_ntz, frontier boolean")
    _, e = network(spark, {1: np.ones(n)}, links)
    got = {r.id: r for r in evm.propagated_predictions(a, e, days).collect()}

    def moved(at, hours, back=False):
        if hours <= 0:
            return at
        k = -(-hours // 8)
        if back:
            d = [x for x in days if x < at.date()][-int(k)]
        else:
            d = ([x for x in days if x <= at.date()][-1:] + [x for x in days if x > at.date()])[int(k)]
        return dt.datetime.combine(d, at.time())

    hops = {3: 0}
    for s in range(n):
        for x in links:
            if x[1] == s and s in hops:
                hops[x[2]] = min(hops.get(x[2], 99), hops[s] + 1)
    start, end, hours = {}, {}, {}
    for i, r in enumerate(rows):
        hours[i] = r[3] * (0.85 ** hops[i] * 1.4 + 1 - 0.85 ** hops[i]) if i in hops and i >= 4 else r[8]
        start[i], end[i] = r[9], moved(r[9], hours[i])
    for i in range(4, n):
        need = []
        for _, s, t, rel, lag in links:
            if t == i:
                x = moved(start[s] if rel in ("SS", "SF") else end[s], lag)
                if rel in ("SS", "FS"):
                    need.append(x)
                elif hours[i] > 0:
                    need.append(moved(x, hours[i], back=True))
        if need and max(need) > start[i]:
            start[i], end[i] = max(need), moved(max(need), hours[i])
    for i in range(n):
        assert (got[f"1-{i}"].predicted_hours, got[f"1-{i}"].predicted_start, got[f"1-{i}"].predicted_end) == (pytest.approx(hours[i]), start[i], end[i])


def test_pareto_in_one_pass(spark):
    links = random_links(1, 1, 9, 14) + random_links(2, 2, 6, 8)
    a, e = network(spark, {1: np.arange(2, 11), 2: np.arange(3, 9)}, links)
    vectors = [{"schedule": w, "quality": 1 - w} for w in (0.05, 0.5, 0.95)]
    front = ensemble.pareto_sweep(a, e, vectors).toPandas()
    for i, v in enumerate(vectors):
        one = ensemble.optimise(a, e, v).groupBy("project_id").agg(F.max("schedule_after").alias("s"), F.max("quality_after").alias("q")).toPandas().set_index("project_id")
        for r in front[front.vector == i].itertuples():
            assert (r.schedule, r.quality) == pytest.approx((one.s[r.project_id], one.q[r.project_id]))
    assert (front.schedule >= front.utopia_schedule - 1e-9).all() and front.groupby("project_id").size().min() >= 1
    plan = ensemble.pareto_sweep(a, e, vectors)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2


def test_odd_inputs(spark):
    one = spark.range(1)
    num = lambda c: one.select(c.alias("x")).first().x
    assert num(inputs.wall_clock_ms(F.lit(2.0), F.lit(" Days "))) == 2 * 86_400_000 and num(inputs.wall_clock_ms(F.lit(float("nan")), F.lit("h"))) == 0
    assert num(inputs.wall_clock_ms(F.lit(None).cast("double"), F.lit(None).cast("string"))) == 0 and num(inputs.wall_clock_ms(F.lit(1.0), F.lit("?"))) == 3_600_000
    assert num(inputs.first_number(F.lit("x"), F.lit("inf"), F.lit("7"))) == 7 and num(inputs.first_number(F.lit(""))) is None
    assert num(inputs.first_filled(F.lit(" "), F.lit(None).cast("string"), default=F.lit("z"))) == "z"
    assert num(analytics.overrun_multiplier(F.lit(-4.0))) == 1 and num(analytics.overrun_multiplier(F.lit(900.0), "percent")) == 3 and num(analytics.overrun_multiplier(F.lit(None).cast("double"))) == 1
    assert num(analytics.cost_type(F.lit("tool steel"))) == "DIRECT_MATERIAL" and num(analytics.cost_type(F.lit(None).cast("string"))) == "DIRECT_LABOR"
    day = lambda s: F.lit(s).cast("date")
    assert num(analytics.resource_need(day("2024-01-06"), day("2024-01-07"), F.lit(9.0))) == 0 and num(analytics.resource_need(day("2024-01-05"), day("2024-01-08"), F.lit(33.0))) == 3
    assert num(analytics.resource_need(day("2024-01-08"), day("2024-01-05"), F.lit(33.0))) == 0
    bounds = spark.createDataFrame([(1, 10.0, 5.0)], "project_id long, makespan double, cost double")
    r = ensemble.constraints(bounds, F.lit(8.0), F.lit(None).cast("double")).first()
    assert (r.makespan_violation, r.makespan_met, r.budget_met, r.penalty) == (2.0, False, True, pytest.approx(50 * 4 / 64))


def test_optimum_against_a_grid(spark):
    """A chain of two: all durations between 80 % and the plan, in steps of a hundredth."""
    a, e = network(spark, {1: [10.0, 20.0]}, [(1, 0, 1, "FS", 0)])
    a = a.withColumn("bound", F.lit(27.0)).withColumn("budget", F.lit(None).cast("double"))
    grid = np.array(list(itertools.product(np.linspace(8, 10, 81), np.linspace(16, 20, 161))))
    cut = (np.array([10.0, 20.0]) - grid) / np.array([10.0, 20.0])
    span, quality = grid.sum(1), (cut * cut * [10.0, 20.0]).sum(1)
    for w in ({"schedule": 0.5, "quality": 0.5}, {"schedule": 0.9, "quality": 0.1}):
        value = w["schedule"] * span / 30 + w["quality"] * quality
        got = ensemble.optimise(a, e, w, rounds=60).first()
        assert got.value <= value.min() + 1e-4 and got.value <= got.initial_value
        over = np.maximum(0, span - 27) / 27
        got = ensemble.optimise(a, e, w, rounds=80, max_makespan="bound", max_budget="budget").first()
        assert got.value <= (value + 50 * over * over).min() + 1e-3
        terms = np.stack([w["schedule"] * (span - 24) / 30, w["quality"] * quality])
        tch = terms.max(0) + np.log(np.exp(20 * (terms - terms.max(0))).sum(0)) / 20 + 0.05 * terms.sum(0)
        got = ensemble.optimise(a, e, w, rounds=80, tchebycheff=True).first()
        assert got.value <= tch.min() + 1e-3


def test_request_lines_and_overrides(spark, tmp_path):
    from dataclasses import dataclass

    from slackline.sources import requests

    path = tmp_path / "r.json"
    path.write_text('{"project_id": 1, "nodes": [{"id": "a"}, {"id": "b", "duration": 2.5}], "links": [{"source": "a", "target": "b"}]}\nbroken\n{"project_id": 2}\n')
    got = requests.read(spark, f"file://{path}")
    assert [r.broken for r in got.where("broken is not null").collect()] == ["broken"]
    assert [(r.project_id, r.seq, r.id, r.duration, r.risk) for r in requests.nodes(got).orderBy("seq").collect()] == [(1, 1, "a", 1.0, 0.0), (1, 2, "b", 2.5, 0.0)]
    assert [tuple(r) for r in requests.links(got).collect()] == [(1, "a", "b", "FS", 0.0, 0)]

    @dataclass(frozen=True)
    class Config:
        most: int = 5
        share: float = 0.5
        flag: bool = True

    assert requests.overridden(Config(), {"most": 7, "share": 1, "flag": False}, {"most": (1, 10)}) == Config(7, 1.0, False)
    for bad in ({"most": True}, {"most": 2.0}, {"most": 11}, {"flag": 1}, {"other": 1}, {"share": float("nan")}):
        with pytest.raises(ValueError):
            requests.overridden(Config(), bad, {"most": (1, 10)})


def test_kernels_ask_for_whole_projects(spark):
    """A repartition() is dropped where both sides are partitioned alike, and joins may then be read in other parts: a window above the union asks for them."""
    a, e = network(spark, {1: [1.0, 2.0]}, [(1, 0, 1, "FS", 0)])
    joined = a.join(a.groupBy("project_id").agg(F.max("seq").alias("last")), "project_id")
    df = graph_apply(joined, e, lambda a, e: a.assign(links=len(e)), "project_id long, id string, links long", ["seq"])
    plan = df._jdf.queryExecution().sparkPlan().toString()
    asks = plan[plan.index("MapInArrow") : plan.index("Union")]
    assert "Window" in asks and "windowspecdefinition(project_id" in asks
    assert {(r.id, r.links) for r in df.collect()} == {("1-0", 1), ("1-1", 1)}


def test_links_without_activities_alone(spark):
    """A chunk that holds only links of projects without activities gives no rows, and no error."""
    from slackline.operators import montecarlo

    a, e = network(spark, {1: [1.0, 2.0]}, [(1, 0, 1, "FS", 0)] + [(p, 0, 1, "FS", 0) for p in range(2, 40)])
    a = a.selectExpr("*", "duration AS remaining", "0.0D AS base", "0.4D AS fat", "array(1.0D, 2.0D) AS mult")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [r.project_id for r in montecarlo.forecast(a.drop("mult"), e, 2).collect()] == [1]
        assert {r.id for r in ensemble.risk_indices(a, e).collect()} == {"1-0", "1-1"}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_significant_dates_shuffle_activities_only(spark):
    a = spark.createDataFrame([(p, f"199{p}-01-0{i + 1} 00:00:00", f"199{p}-0{i + 2}-01 00:00:00") for p in (2, 3) for i in range(3)], "project_id long, s string, f string")
    a = a.select("project_id", F.col("s").cast("timestamp_ntz").alias("start"), F.col("f").cast("timestamp_ntz").alias("finish"))
    out = evm.significant_dates(a, ["start", "finish"], "1993-02-10 00:00:00", 400)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    # 6 own dates, 14 weeks after the first, the status date
    want = {dt.datetime(1993, 1, 1) + dt.timedelta(days=7 * i) for i in range(13)} | {dt.datetime(1993, 1, i) for i in (2, 3)} | {dt.datetime(1993, i, 1) for i in (2, 3, 4)} | {dt.datetime(1993, 2, 10)}
    got = [r.day for r in out.where("project_id = 3").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_mined_parts_shuffle_paths_once(spark):
    """Anchor pairs are made within a path's row: the paths' text is shuffled to the scores of their project and no further."""
    from slackline.operators import mining

    schema = "project_id long, id string, z_in double, z_out double, z_risk double, z_importance double"
    scores = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0, 0.0), (1, "b", 3.0, 0.0, 0.0, 0.0), (1, "c", 0.0, 0.0, 1.5, 1.5), (1, "d", 0.0, 3.0, 0.0, 0.0)], schema)
    paths = spark.createDataFrame([(1, "s>b>c>d>e"), (1, "s>a>b>c>d>e"), (1, "s>b>c>d>a>e"), (1, "s>e"), (2, "s>b>c>d>e")], "project_id long, path string")
    found = mining.recurring_parts(paths, scores)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    r, = found.collect()
    assert (r.part, r.length, r.support, r.supp, r.junc) == ("b>c>d", 3, 3, 0.75, 1.0)
    assert r.sal == pytest.approx(1 / 9) and r.maxpen == pytest.approx(1 / 3)


def test_resolutions_depend_on_a_projects_network_alone(spark):
    shapes = [random_links(k, 0, 5 + k % 3, 9) for k in range(4)]
    ends = [np.array([r[1:3] for r in s]) for s in shapes]
    p, pair, want = [], [], []
    for i in range(40):
        k = i % 4
        n = 8
        edges = np.unique(np.sort(ends[k], axis=1), axis=0)
        edges = edges[edges[:, 0] != edges[:, 1]]
        want.append(community.typical(np.zeros(n, int), edges, 1.0, 3))
        pair.append(edges + len(p))
        p += [i] * n
    p, pair = np.array(p), np.concatenate(pair)
    same, _ = community.alike(p, pair)
    assert same.tolist() == [i % 4 for i in range(40)]
    label, stability = community.typical(p, pair, 1.0, 3)
    assert all((label[p == i] == want[i][0]).all() and stability[i] == pytest.approx(want[i][1][0]) for i in range(40))
    acts, lnk = schedule(spark, "/root/testdata/sf0.001")
    all_of = community.multi_resolution(acts, lnk).where("project_id % 5 = 0").collect()
    some = community.multi_resolution(acts.where("project_id % 5 = 0"), lnk).collect()
    assert some and {tuple(r) for r in all_of} == {tuple(r) for r in some}  # orders came from the chunk before


def test_front_in_the_kernel(spark):
    points = np.random.default_rng(3).integers(0, 4, (30, 7, 3)).astype(float)
    got = ensemble.undominated(points)
    for g, own in enumerate(points):
        assert got[g].tolist() == [not any((o <= x).all() and (o < x).any() for o in own) for x in own]
    a, e = network(spark, {1: np.arange(2, 11), 2: np.arange(3, 9)}, random_links(1, 1, 9, 14) + random_links(2, 2, 6, 8))
    vectors = [{"schedule": w, "quality": 1 - w} for w in np.linspace(0.05, 0.95, 33).tolist()]
    front = ensemble.pareto_sweep(a, e, vectors)
    assert "collect_list" not in front._jdf.queryExecution().optimizedPlan().toString()  # every point was compared by interpreted expressions before
    rows = front.collect()
    assert {r.project_id for r in rows} == {1, 2} and max(r.vector for r in rows) > 29
    assert all(min(r[k] for r in rows if r.project_id == p) >= r[f"utopia_{k}"] for p in (1, 2) for k in ensemble.OBJECTIVES for r in rows if r.project_id == p)
