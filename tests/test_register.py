"""Near-critical selection, groups, curves and registers against brute force."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from slackline.operators import cpm, evm, grouping, risk_register, selection

PATH = "project_id long, path string, duration double"


def lattice(p, levels, seed):
    """All paths through levels of two or three activities, with durations."""
    rng = np.random.default_rng(seed)
    names = [[f"{p}-{i}{c}" for c in "abc"[: 2 + i % 2]] for i in range(levels)]
    return [(p, ">".join(x), float(rng.integers(5, 60))) for x in itertools.product(*names)]


def by_hand(rows, most):
    """What families() says of one project, path by path."""
    rows = sorted(rows, key=lambda r: (-r[2], r[1]))[: max(most * 20, most * 3)]
    ref = rows[0][1].split(">")
    fam = {}
    for _, path, d in rows:
        n, dev = path.split(">"), None
        for i in range(len(n) - 1):
            if n[i] in ref[:-1] and ref[ref.index(n[i]) + 1] != n[i + 1]:
                back = [v for v in n[i + 1 :] if v in ref and ref.index(v) > ref.index(n[i])]
                dev = f"{n[i]}>{n[i + 1]}>{back[0] if back else 'none'}"
                break
        dev = "UNSPEC" if len(n) < 2 or len(ref) < 2 else dev or "ON_REF"
        k = max(0, len(n) // 2 - 1)
        fam.setdefault((">".join(n[:4]), dev), []).append((path, d, "short" if len(n) < 5 else ">".join(n[k : k + 3])))
    top, share = max(map(len, fam.values())), len(fam) / len(rows)
    large = top >= 200 or top / len(rows) >= 0.25 or share <= 0.4
    rule = (0.90, 10) if large else (0.94, 5) if top <= 10 and share >= 0.85 else (0.92, 5)
    branches = {}
    for (b, dev), members in fam.items():
        branches.setdefault(b, []).append((*members[0], dev, len(members)))
    order = sorted(branches.values(), key=lambda m: (-m[0][1], m[0][0]))
    out = []
    for i, m in enumerate(order):
        q = most // len(order) + (i < most % len(order))
        q = max(1 if len(order) * 3 > most else 3, min(20 if large else 30, q))
        q = min(len(m), (3 * q + 1) // 2)
        firsts = [x for j, x in enumerate(m) if x[2] not in [y[2] for y in m[:j]]]
        out += (firsts + [x for x in m if x not in firsts])[:q]
    out = out[: min(len(fam), max(most * 3, most + 10))]
    return sorted(out, key=lambda r: (-r[1], r[0])), rule


def apart(pre, rule, most):
    taken, used = [], set()
    for path, d, *_ in pre:
        n = path.split(">")
        own = set(zip(n, n[1:]))
        if not own or len(taken) >= most or taken and len(own - used) < rule[1]:
            continue
        if all(len(own & o) / min(len(own), len(o)) < rule[0] for _, o in taken):
            taken.append((path, own))
            used |= own
    names = [t[0] for t in taken]
    return names, [r[0] for r in pre if r[0] not in names][: max(0, most - len(names))]


@pytest.mark.parametrize("most", [2, 7, 200])
def test_families_and_selection_by_hand(spark, most):
    rows = lattice(1, 5, 1) + lattice(2, 7, 2) + [(3, "3-a", 4.0)] + lattice(4, 12, 3) + [(5, f"5-{i}>5-x{i}>5-y{i}>5-z{i}>5-u{i}>5-w{i}>5-e", float(9 - i % 4)) for i in range(8)]
    df = spark.createDataFrame([*rows, (6, None, 1.0), (6, "6-a", None)], PATH)
    pre = selection.families(df, most)
    got = {}
    for r in pre.orderBy("project_id", "place").collect():
        got.setdefault(r.project_id, []).append(r)
    picked = selection.independent(pre, most).collect()
    assert set(got) == {1, 2, 3, 4, 5}
    for p in got:
        want, rule = by_hand([r for r in rows if r[0] == p], most)
        assert [(r.path, r.duration, r.midpoint, r.deviation, r.family) for r in got[p]] == want
        assert {(r.overlap_threshold, r.min_new_links) for r in got[p]} == {rule}
        taken, filled = apart(want, rule, most)
        assert sorted(r.path for r in picked if r.project_id == p and not r.filled) == sorted(taken)
        assert sorted(r.path for r in picked if r.project_id == p and r.filled) == sorted(filled)
    none = selection.families(spark.createDataFrame([], PATH))
    assert none.count() == 0 and selection.independent(none).count() == 0


def test_complete_linkage_by_hand():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, m = int(rng.integers(2, 14)), int(rng.integers(0, 20))
        a, b = rng.integers(0, n, (2, m))
        a, b = a[a != b], b[a != b]
        d = grouping.hops(n, a, b)
        near = np.where(np.eye(n) > 0, 0.0, grouping.APART)
        near[a, b] = near[b, a] = 1
        for k in range(n):
            near = np.minimum(near, near[:, [k]] + near[[k]])
        assert (d == np.minimum(near, grouping.APART)).all()
        ways = grouping.complete_linkage(d, min(4, n))
        for k in range(1, min(4, n) + 1):
            g = [[i] for i in range(n)]
            while len(g) > k:
                _, i, j = min((d[np.ix_(g[i], g[j])].max(), i, j) for i in range(len(g)) for j in range(i + 1, len(g)))
                g[i] = sorted(g[i] + g.pop(j))
            assert sorted(np.flatnonzero(ways[k - 1] == x).tolist() for x in np.unique(ways[k - 1])) == sorted(g)


def test_dependency_groups(spark):
    acts = [(1, i, f"1-{i}") for i in range(9)] + [(2, 0, "2-0"), (3, 0, "3-0"), (3, 1, "3-1"), (3, 2, "3-2")] + [(4, i, f"4-{i}") for i in range(2100)]
    links = [(1, f"1-{3 * g + i}", f"1-{3 * g + i + 1}", "FS", 0.0, 1) for g in range(3) for i in range(2)] + [(3, "3-0", "3-1", "FS", 0.0, 1)] * 2
    links += [(4, f"4-{i}", f"4-{i + 1}", "FS", 0.0, 1) for i in range(2099)]
    a, e = spark.createDataFrame(acts, "project_id long, seq int, id string"), spark.createDataFrame(links, "project_id long, source string, target string, rel string, lag double, ord int")
    got = {r.id: r.grp for r in grouping.dependency_groups(a, e).collect()}
    assert [got[f"1-{i}"] for i in range(9)] == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert got["2-0"] == 0 and [got[f"3-{i}"] for i in range(3)] == [0, 0, 1]
    large = [got[f"4-{i}"] for i in range(2100)]
    assert 2 < len(set(large)) < 700 and large == sorted(large)
    assert grouping.dependency_groups(a.limit(0), e.limit(0)).count() == 0


def test_silhouette_by_hand():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    label = np.array([0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3])
    s = []
    for i, k in enumerate(label):
        own = [d[i, j] for j in range(12) if label[j] == k and j != i]
        near = min(np.mean([d[i, j] for j in range(12) if label[j] == c]) for c in set(label) - {k})
        s.append((near - np.mean(own)) / max(near, np.mean(own)) if own else 0.0)
    assert np.isclose(grouping.silhouette(d, label), np.mean(s))


def test_risk_groups(spark):
    rng = np.random.default_rng(0)
    blobs = np.concatenate([rng.normal(c, 0.02, (30, 2)) for c in ((0.2, 0.2), (0.8, 0.8), (0.2, 0.9))] + [[[0.5, 0.45], [0.6, 0.2]]])
    acts = [(1, i, f"1-{i}", float(x), float(y)) for i, (x, y) in enumerate(blobs)] + [(2, i, f"2-{i}", v, v) for i, v in enumerate([0.1, 0.9, 0.12, None, 0.88])] + [(3, 0, "3-0", 0.5, 0.5), (4, 0, "4-0", 0.1, 0.1), (4, 1, "4-1", 0.1, 0.1)]
    a = spark.createDataFrame(acts, "project_id long, seq int, id string, importance double, risk double")
    rows = {r.id: r for r in grouping.risk_groups(a).collect()}
    assert len(rows) == len(acts)
    assert [rows[f"1-{i}"].cluster for i in range(90)] == [0] * 30 + [1] * 30 + [2] * 30 and rows["1-0"].method == "density"
    gap = ((blobs[:90, None] - blobs[None, 90:]) ** 2).sum(2).argmin(0)
    assert [rows[f"1-{90 + i}"].cluster for i in range(2)] == [rows[f"1-{k}"].cluster for k in gap]
    assert [rows[f"2-{i}"].cluster for i in range(5)] == [0, 1, 0, 0, 1] and rows["2-0"].method == "k-means"
    assert rows["3-0"].cluster == rows["4-0"].cluster == rows["4-1"].cluster == 0
    assert grouping.risk_groups(a.limit(0)).count() == 0


def test_joint_overruns(spark):
    x = np.array([[0.0, 0.01], [0.01, 0.0], [0.0, 0.02], [0.9, 0.1], [1.0, 0.2], [0.1, 0.8], [0.1, 0.9]])
    got = grouping.overrun_groups(x)
    assert [(g[1], g[2]) for g in got] == [("nominal", 3), ("cost_dominated", 2), ("schedule_dominated", 2)]
    assert np.isclose(got[0][7], np.corrcoef(x.T)[0, 1]) and np.isclose(got[0][8], np.quantile(x[:, 0], 0.95))
    assert grouping.overrun_groups(np.zeros((8, 2)))[0][1:3] == ("nominal", 8)
    acts = [(1, i, f"1-{i}", 10.0 * (i + 1), 10.0 * (i + 1), 0.1 * i, 0.5, 1.0) for i in range(5)]
    a = spark.createDataFrame(acts, "project_id long, seq int, id string, duration double, remaining double, risk double, fat double, resource_count double")
    e = spark.createDataFrame([(1, f"1-{i}", f"1-{i + 1}", "FS", 0.0, 1) for i in range(4)], "project_id long, source string, target string, rel string, lag double, ord int")
    rows = grouping.joint_overruns(a, e, 40).collect()
    assert sum(r.n for r in rows) == 40
    # a chain with one resource each: cost overruns as its schedule does
    assert all(np.isclose(r.schedule_mean, r.cost_mean) and np.isclose(r.correlation, 1) for r in rows)
    assert grouping.joint_overruns(a, e, 4).count() == 0


def test_accrual_of_odd_windows(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    w = [(1, "x", day(0), day(4), 8.0), (1, "x", day(2), day(2), 5.0), (1, "x", day(3), day(1), 1.0), (1, "x", None, day(1), 9.0), (1, "y", day(1), day(2), None), (1, "y", day(10), day(12), 4.0), (2, "x", day(0), day(1), 1.0)]
    days = spark.createDataFrame([(1, day(n)) for n in (-1, 0, 1, 2, 3, 4, 9, 11, 11)] + [(1, None)], "project_id long, day timestamp_ntz")
    rows = evm.accrual(spark.createDataFrame(w, "project_id long, curve string, begin timestamp_ntz, end timestamp_ntz, amount double"), days).collect()
    got = {(r.curve, (r.day - day(0)).days): (r.amount, r.period) for r in rows}
    assert len(rows) == 16
    assert [got["x", n] for n in (-1, 0, 1, 2, 3, 4, 9, 11)] == [(0, 0), (0, 2), (3, 2), (10, 7), (12, 2), (14, 2), (14, 0), (14, 0)]
    assert [got["y", n] for n in (4, 9, 11)] == [(0, 0), (0, 0), (2, 2)]


def test_keyword_groups_by_hand(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{c}" for c in "abcdefgh"]
    risks = [(int(rng.integers(0, 3)), i, int(rng.integers(0, 40)), [None, "A", "B"][int(rng.integers(0, 3))], " ".join(rng.choice(vocabulary, int(rng.integers(0, 5))))) for i in range(120)]
    df = spark.createDataFrame(risks, "register long, risk_id long, ord int, type string, name string").withColumn("words", risk_register.keywords(F.col("name")))
    df = df.withColumn("score", F.when(F.col("risk_id") % 5 > 0, F.col("risk_id") % 7 / 7)).withColumn("mitigations", F.when(F.col("risk_id") % 3 > 0, F.array(F.concat(F.lit("m"), F.col("risk_id") % 4))))
    groups = risk_register.grouped(df)
    got = {r.risk_id: r.leader for r in groups.collect()}
    want = {}
    for reg in range(3):
        leaders = []
        for _, i, _, kind, name in sorted((r for r in risks if r[0] == reg), key=lambda r: (r[2], r[1])):
            own = set(name.split())
            near = [j for j, k, o in leaders if k == kind and own | o and len(own & o) / len(own | o) > 0.5]
            want[i] = near[0] if near else i
            if not near:
                leaders.append((i, kind, own))
    assert got == want
    best = {(r.register, r.leader): r for r in risk_register.merged(df, groups, most=2).collect()}
    for (reg, leader), r in best.items():
        own = sorted((i for i in want if want[i] == leader), key=lambda i: (i % 5 == 0, -(i % 7), i))
        assert (r.best, r.members) == (own[0], len(own))
        assert r.mitigations == list(dict.fromkeys(f"m{i % 4}" for i in own if i % 3))[:2]
    assert risk_register.grouped(df.limit(0)).count() == 0


def test_all_families_of_a_large_project(spark):
    """20 activities have 6,765 paths: quotas leave families out, the query's form none."""
    acts = spark.createDataFrame([(1, i, f"1-{i}", float(i * 7 % 11)) for i in range(20)], "project_id long, seq int, id string, duration double")
    links = spark.createDataFrame([(1, f"1-{i}", f"1-{i + k}", "FS", 0.0, k) for i in range(20) for k in (1, 2) if i + k < 20], "project_id long, source string, target string, rel string, lag double, ord int")
    paths = cpm.path_durations(acts, links).cache()
    whole, some = selection.families(paths, most=None).toPandas(), selection.families(paths).toPandas()
    assert whole.family.sum() == paths.count() == 6_765 and not whole.duplicated(["branch", "deviation"]).any()
    assert sorted(whole.place) == list(range(1, len(whole) + 1)) and some.family.sum() < 6_765


def test_forecasted_curves_against_accrual(spark):
    rng = np.random.default_rng(4)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(n))
    some = lambda x, share=0.15: None if rng.random() < share else x
    rows = []
    for p, n in [(1, 1), (2, 3), (3, 5), (4, 90), (5, 400), (6, 2)] + [(p, 4) for p in range(10, 30)]:
        for _ in range(n):
            s = rng.integers(0, 60) * 24
            rows.append((p, some(day(s)), some(day(s + rng.integers(-2, 9) * 12)), some(day(s + 30), 0.6), some(day(s + 100), 0.6), some(float(rng.integers(0, 20))), some(float(rng.integers(0, 30)), 0.5), some(float(rng.integers(0, 101))), some(float(rng.integers(-1, 5)))))
    rows += [(7, None, day(3), None, None, 5.0, None, 10.0, 2.0), (8, None, None, None, None, None, None, None, None), (9, day(0), day(0), None, None, 4.0, None, 50.0, None)]
    a = spark.createDataFrame(rows, "project_id long, start timestamp_ntz, finish timestamp_ntz, risk_start timestamp_ntz, risk_end timestamp_ntz, duration double, risk_duration double, pct double, cost_rate double")
    got = {(r.project_id, r.curve, r.day): (r.amount, r.period) for r in evm.forecasted_curves(a, "2024-01-20 00:00:00").collect()}
    windows, days = [], {}
    for p, s, f, rs, re, h, rh, pct, rate in rows:
        days.setdefault(p, {dt.datetime(2024, 1, 20)}).update(x for x in (s, f) if x)
        if s and f and h:
            rate = rate if rate and rate > 0 else 1.0
            for name, b, e, v in (("planned", s, f, h), ("overrun", rs or s, re or f, rh or h), ("earned", s, f, h * (pct or 0) / 100)):
                windows += [(p, name, b, e, v), (p, f"{name}_cost", b, e, v * rate)]
    w = spark.createDataFrame(windows, "project_id long, curve string, begin timestamp_ntz, end timestamp_ntz, amount double")
    d = spark.createDataFrame([(p, x) for p, own in days.items() for x in own], "project_id long, day timestamp_ntz")
    want = {(r.project_id, r.curve, r.day): (r.amount, r.period) for r in evm.accrual(w, d).collect()}
    assert {5, 9} <= {k[0] for k in want} and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-8) for k, v in want.items())
    plan = evm.forecasted_curves(a, "2024-01-20 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan  # windows and days were shuffled, sorted and joined before
    assert evm.forecasted_curves(a.limit(0), "2024-01-20 00:00:00").count() == 0


def test_overruns_of_many_projects_at_once():
    rng = np.random.default_rng(8)
    s, c = rng.gamma(1.0, 0.3, (2, 40, 60))
    s[:, 0], c[:, 0] = 0.0, 0.0
    s[:, 1], c[:, 1] = np.arange(40) % 2, 0.5
    s[:, 2], c[:, 2] = (np.arange(40) > 6) * 0.3, (np.arange(40) > 30) * 0.3
    s[:, 3:20], c[:, 3:20] = s[:, 3:20].round(1), c[:, 3:20].round(1)
    rows = grouping.overruns(s, c)
    for i in range(60):
        x = np.stack([s[:, i], c[:, i]], axis=1)
        label = grouping.kmeans(x, min(3, len(np.unique(x, axis=0))))
        own = rows[rows.p == i]
        want = sorted((x[label == k].mean(0).sum(), (label == k).sum(), *x[label == k].max(0)) for k in np.unique(label))
        assert own.cluster.tolist() == list(range(len(want)))
        assert np.allclose([(r.schedule_mean + r.cost_mean, r.n, r.schedule_max, r.cost_max) for r in own.itertuples()], want)
        assert np.allclose(own.correlation, 0.0 if i < 2 else np.corrcoef(x.T)[0, 1]) and np.allclose(own.cost_p95, np.percentile(c[:, i], 95))
