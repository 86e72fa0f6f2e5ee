"""Sampled critical paths: criticality, cruciality, extremes, and cost against schedule."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from slackline.plans.grouped import graph_apply

from .cpm import Net, merge
from .montecarlo import BLOCK, drawn, factors


def early(net: Net, durations: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(early start of every activity, weight of every link, makespan of every project) in each sample."""
    src, dst = net.src, net.dst
    w = net.lag + np.where(net.from_finish[:, None], durations[src], 0.0) - np.where(net.to_finish[:, None], durations[dst], 0.0)
    es = np.zeros_like(durations)
    for g, alone in net.forward:
        merge(np.maximum, es, dst[g], es[src[g]] + w[g], alone)
    return es, w, net.by_project(np.maximum, es + durations, -np.inf)


def sampled_passes(a, e, durations: np.ndarray, net: Net | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(total float of every activity, makespan of every project) in each sample."""
    net = net or Net(a, e)
    es, w, span = early(net, durations)
    ls = span[net.p] - durations
    for g, alone in net.backward:
        merge(np.minimum, ls, net.src[g], ls[net.dst[g]] - w[g], alone)
    return ls - es, span


def risk_indices(sampled: DataFrame, links: DataFrame) -> DataFrame:
    """criticality: share of samples in which an activity is critical; cruciality: correlation of its
    multiplier with the project's makespan (0 where either is constant). sampled has duration and mult."""

    def kernel(a, e):
        mult = np.stack(a.mult.to_list())
        tf, span = sampled_passes(a, e, np.nan_to_num(a.duration.to_numpy(float))[:, None] * mult)
        y = span[a.p.to_numpy()]
        dx, dy = mult - mult.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
        vx, vy = (dx * dx).sum(1), (dy * dy).sum(1)
        r = np.where((vx > 1e-12) & (vy > 1e-12), (dx * dy).sum(1) / np.sqrt(np.maximum(vx * vy, 1e-300)), 0.0)
        return a.assign(criticality=(np.abs(tf) < 1e-9).mean(1), cruciality=r)

    return graph_apply(sampled, links, kernel, "project_id long, id string, criticality double, cruciality double", ["seq", "duration", "mult"])


def risk_indices_sampled(scoped: DataFrame, links: DataFrame, samples: int) -> DataFrame:
    """What risk_indices gives, for many samples: made in the kernel, BLOCK at once, with sums of differences from the first."""

    def kernel(a, e):
        if not len(a):  # a chunk may hold links alone
            return a.assign(criticality=0.0, cruciality=0.0)
        d, p = np.nan_to_num(a.duration.to_numpy(float))[:, None], a.p.to_numpy()
        sums, first, critical = np.zeros((5, len(a))), None, np.zeros(len(a))
        for s in range(0, samples, BLOCK):
            mult = factors(a, s, min(BLOCK, samples - s))
            tf, span = sampled_passes(a, e, d * mult)
            y = span[p]
            first = first or (mult[:, :1], y[:, :1])
            x, y = mult - first[0], y - first[1]
            critical += (np.abs(tf) < 1e-9).sum(1)
            sums += [v.sum(1) for v in (x, y, x * x, y * y, x * y)]
        x, y, xx, yy, xy = sums
        vx, vy = xx - x * x / samples, yy - y * y / samples
        r = np.where((vx > 1e-12) & (vy > 1e-12), (xy - x * y / samples) / np.sqrt(np.maximum(vx * vy, 1e-300)), 0.0)
        return a.assign(criticality=critical / samples, cruciality=r)

    return graph_apply(scoped, links, kernel, "project_id long, id string, criticality double, cruciality double", ["seq", "duration", "remaining", "risk", "fat"])


def extremes(scoped: DataFrame, samples: int, cap: str) -> DataFrame:
    """Activities that reach 95 % of their cap in a tenth of the samples or more (black swans), or whose largest
    multiplier lies beyond mean + 4 deviations and twice the mean (dragon kings). Samples are made in a kernel, BLOCK at once, with sums of
    differences from the first, so their number doesn't multiply the expressions of a plan."""

    def kernel(a, draws):
        high = 0.95 * a.cap.to_numpy(float)
        sums, first, top, over = np.zeros((2, len(a))), None, np.full(len(a), -np.inf), np.zeros(len(a))
        for s in range(0, samples, BLOCK):
            m = draws(s, min(BLOCK, samples - s))
            first = m[:, :1] if first is None else first
            x = m - first
            sums += [x.sum(1), (x * x).sum(1)]
            top, over = np.maximum(top, m.max(1)), over + (m >= high[:, None]).sum(1)
        x, xx = sums / samples
        mean, sd = first[:, 0] + x, np.sqrt(np.maximum(xx - x * x, 0))
        out = a.assign(cap_share=over / samples, black_swan=over / samples >= 0.1, dragon_king=(top > mean + 4 * sd) & (top > 2 * mean))
        out = out[out.black_swan | out.dragon_king]
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type, from_pandas=True) for f in target], schema=target)

    schema = "project_id long, id string, cap_share double, black_swan boolean, dragon_king boolean"
    target = to_arrow_schema(StructType.fromDDL(schema))
    return drawn(scoped.withColumn("cap", F.expr(cap)), kernel, schema, ["cap"])


OBJECTIVES = ("schedule", "cost", "risk", "quality")


#: Sharpness of the soft maximum, share of the sum in it, and weight of a broken bound (fixed values).
KAPPA, RHO, PENALTY = 20.0, 0.05, 50.0


def optimum(a, e, weights: list[dict[str, float]], rounds: int, crash: float, rate: float, utopia: dict[str, np.ndarray] | None = None, bounds: dict[str, np.ndarray] | None = None, net: Net | None = None):
    """(durations, objectives of the plan, value of the plan, value reached, objectives reached), each project of the chunk and each weight
    vector (a column) for itself.

    With a utopia (the best of each objective by project) the value is the augmented Tchebycheff one: a soft maximum of the weighted, scaled
    distances and a share of their sum. bounds (of schedule or cost by project; not above 0: none) add a quadratic penalty.
    """
    net = net or Net(a, e)
    keys = [k for k in dict.fromkeys(k for v in weights for k in v) if k in OBJECTIVES]
    share = {k: np.array([v.get(k, 0.0) / sum(v.values()) for v in weights]) for k in keys}
    p, each = net.p, lambda x: net.by_project(np.add, x, 0.0)
    column = lambda x: np.repeat(np.asarray(x, float)[:, None], len(weights), axis=1)
    base = column(np.nan_to_num(a.duration.to_numpy(float)))
    risk, res = a.risk.to_numpy(float)[:, None] * 10, np.maximum(a.resource_count.to_numpy(float), 1)[:, None]
    low, safe = base * (1 - crash), np.where(base > 0, base, 1)

    def measured(d, wanted):
        """Those objectives, and their slopes by duration."""
        f, g = {}, {}
        tf, span = sampled_passes(a, e, d, net) if {"schedule", "risk"} & wanted else (None, None)
        if "schedule" in wanted:
            f["schedule"], g["schedule"] = span, (np.abs(tf) < 1e-9).astype(float)
        if "cost" in wanted:
            f["cost"], g["cost"] = each(rate * res * d), rate * res
        if "risk" in wanted:
            crit = 2 - np.clip(tf / np.maximum(span[p], 1e-9), 0, 1)
            f["risk"], g["risk"] = each(risk * crit * d), risk * crit
        if "quality" in wanted:
            cut = np.where(base > 0, (base - d) / safe, 0)
            f["quality"], g["quality"] = each(cut * cut * base), -2 * cut
        return f, g

    used = {*keys, *(bounds or {})}
    first, g = measured(base, set(OBJECTIVES))
    scale = {k: np.maximum(np.abs(first[k]), 1) for k in share}
    limits = {k: np.where(b > 0, b, np.inf)[:, None] for k, b in (bounds or {}).items()}

    def valued(f, g):
        """Value of each project and its slope by duration."""
        terms = np.stack([v * (f[k] - (utopia[k] if utopia else 0)) / scale[k] for k, v in share.items()])
        if utopia:
            top = terms.max(0)
            soft = np.exp(KAPPA * (terms - top))
            value = top + np.log(soft.sum(0)) / KAPPA + RHO * terms.sum(0)
            pull = soft / soft.sum(0) + RHO
        else:
            value, pull = terms.sum(0), np.ones_like(terms)
        slope = sum((c * v / scale[k])[p] * g[k] for c, (k, v) in zip(pull, share.items()))
        for k, b in limits.items():
            over = np.maximum(0, f[k] - b) / b
            value = value + PENALTY * over * over
            slope = slope + (2 * PENALTY * over / b)[p] * g[k]
        return value, slope

    before, grad = valued(first, g)
    d, best = base.copy(), before
    step = np.ones_like(best) * each(base) / np.maximum(each(np.abs(grad)), 1e-12)
    for _ in range(rounds):
        new = np.clip(d - step[p] * grad, low, base)
        value, grad2 = valued(*measured(new, used))
        better = value < best - 1e-12
        s, y = new - d, grad2 - grad
        sy, ss = each(s * y), each(s * s)
        step = np.where(better, np.where(sy > 1e-15, ss / np.maximum(sy, 1e-15), 2 * step), step / 4)
        take = better[p]
        d, grad, best = np.where(take, new, d), np.where(take, grad2, grad), np.where(better, value, best)
    return d, first, before, best, measured(d, set(OBJECTIVES))[0]


def optimise(rows: DataFrame, links: DataFrame, weights: dict[str, float], rounds: int = 20, crash: float = 0.2, rate: float = 85.0, tchebycheff: bool = False, max_makespan: str | None = None, max_budget: str | None = None) -> DataFrame:
    """Durations between (1 - crash) of and the planned ones that lower the weighted, scaled sum of schedule, cost, risk and quality.

    Projected gradient with a Barzilai-Borwein step of its own for each project and backtracking, all projects of
    a chunk at once; only improvements are kept, so the result is never worse than the plan. Each objective
    is scaled by its value for the plan (at least 1). rows has duration, resource_count and risk.

    tchebycheff: the largest weighted distance from the utopia (each objective optimised alone) counts instead of the weighted sum.
    max_makespan, max_budget: columns of rows with a project's bounds (alike in its rows; null or not above 0: none); breaking one is penalised.
    """
    limits = {k: c for k, c in (("schedule", max_makespan), ("cost", max_budget)) if c}

    def kernel(a, e):
        if not len(a):
            return a.assign(**{c.split()[0]: 0.0 for c in ("optimised", "initial_value", "value", *objectives.split(", "))})
        p = a.p.to_numpy()
        net = Net(a, e)
        utopia = {k: optimum(a, e, [{k: 1.0}], rounds, crash, rate, net=net)[4][k] for k in OBJECTIVES if weights.get(k)} if tchebycheff else None
        bounds = {k: np.nan_to_num(a.groupby("p")[c].first().to_numpy(float)) for k, c in limits.items()}
        d, first, before, best, last = optimum(a, e, [weights], rounds, crash, rate, utopia, bounds, net)
        out = a.assign(optimised=d[:, 0], initial_value=before[p, 0], value=best[p, 0])
        for k in OBJECTIVES:
            out[f"{k}_before"], out[f"{k}_after"] = first[k][p, 0], last[k][p, 0]
        return out

    objectives = ", ".join(f"{k}_{t} double" for k in OBJECTIVES for t in ("before", "after"))
    return graph_apply(rows, links, kernel, f"project_id long, id string, duration double, optimised double, initial_value double, value double, {objectives}", ["seq", "duration", "risk", "resource_count", *limits.values()])


#: Weight vectors that a kernel takes at once.
VECTORS = 30


def undominated(points: np.ndarray) -> np.ndarray:
    """Which points of each group (groups, points, objectives) no other of it equals or betters everywhere and betters somewhere."""
    out = np.ones(points.shape[:2], bool)
    for i in range(points.shape[1]):
        other = points[:, i : i + 1]
        out &= ~((other <= points).all(2) & (other < points).any(2))
    return out


def pareto_sweep(rows: DataFrame, links: DataFrame, vectors: list[dict[str, float]], rounds: int = 20, crash: float = 0.2, rate: float = 85.0) -> DataFrame:
    """Objectives of each project's optimum for each weight vector that no other vector's optimum dominates.

    One pass over the networks: a kernel takes all vectors of its chunk, some side by side, and the utopia is what the best of
    them reach in each objective (columns utopia_...). The front is found there too: a project's points are together.
    """

    def kernel(a, e):
        if not len(a):
            return
        net = Net(a, e)
        ids = a.project_id.to_numpy()[np.unique(net.p, return_index=True)[1]]
        last = [optimum(a, e, vectors[i : i + VECTORS], rounds, crash, rate, net=net)[4] for i in range(0, len(vectors), VECTORS)]
        points = np.stack([np.concatenate([x[k] for x in last], axis=1) for k in OBJECTIVES], axis=2)
        best = points.min(1)
        g, v = np.nonzero(undominated(points))
        yield pd.DataFrame({"project_id": ids[g], "vector": v, **{k: points[g, v, i] for i, k in enumerate(OBJECTIVES)}, **{f"utopia_{k}": best[g, i] for i, k in enumerate(OBJECTIVES)}})

    return graph_apply(rows, links, kernel, "project_id long, vector int, " + ", ".join(f"{k} double" for k in (*OBJECTIVES, *(f"utopia_{k}" for k in OBJECTIVES))), ["seq", "duration", "risk", "resource_count"])


def constraints(measured: DataFrame, max_makespan: Column, max_budget: Column, weight: float = 50.0) -> DataFrame:
    """measured (project_id, makespan, cost) with each bound's violation, whether it is met (to a millionth) and the penalty: weight times
    the squares of the violations as shares of their bounds. A null bound is met; one of 0 or less has no penalty."""
    out, penalty = measured, F.lit(0.0)
    for name, value, bound in (("makespan", "makespan", max_makespan), ("budget", "cost", max_budget)):
        over = F.greatest(F.lit(0.0), F.col(value) - bound)
        out = out.withColumn(f"{name}_violation", F.coalesce(over, F.lit(0.0))).withColumn(f"{name}_met", F.coalesce(over <= 1e-6 * F.greatest(bound, F.lit(1.0)), F.lit(True)))
        penalty = penalty + F.coalesce(F.when(bound > 0, weight * over * over / (bound * bound)), F.lit(0.0))
    return out.withColumn("penalty", penalty)
