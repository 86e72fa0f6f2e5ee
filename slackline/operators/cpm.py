"""Critical path method as (max, +) relaxation by levels, for many projects at once."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from slackline.plans.grouped import graph_apply


def weights(e: pd.DataFrame, d: np.ndarray) -> np.ndarray:
    """What a link adds to its source's early start (lag with the durations that its relation needs)."""
    rel = e.rel.str.upper().to_numpy(object) if len(e) else np.zeros(0, object)
    w = e.lag.to_numpy(float).copy()
    src, dst = e.src.to_numpy(int), e.dst.to_numpy(int)
    from_finish = ~np.isin(rel, ["SS", "SF"])  # an unknown relation counts as FS
    to_finish = np.isin(rel, ["FF", "SF"])
    w[from_finish] += d[src[from_finish]]
    w[to_finish] -= d[dst[to_finish]]
    return w


def levels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Longest number of links from a start; -1 on cycles and behind them."""
    level = np.full(n, -1)
    left = np.bincount(dst, minlength=n)
    by_src = np.argsort(src, kind="stable")
    first = np.searchsorted(src[by_src], np.arange(n + 1))
    front, k = np.flatnonzero(left == 0), 0
    while len(front):
        level[front] = k
        size = first[front + 1] - first[front]
        at = np.repeat(first[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        to = dst[by_src[at]]
        np.subtract.at(left, to, 1)
        to = np.unique(to)
        front, k = to[left[to] == 0], k + 1
    return level


def acyclic(n: int, e: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Links without the backward ones of activities on cycles or behind them (those follow in input order)."""
    src, dst = e.src.to_numpy(int), e.dst.to_numpy(int)
    level = levels(n, src, dst)
    if (level < 0).any():
        keep = ~((level[src] < 0) & (level[dst] < 0) & (src > dst))
        e = e[keep].reset_index(drop=True)
        level = levels(n, e.src.to_numpy(int), e.dst.to_numpy(int))
    return e, level


def by_level(level: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Links in groups of one level of the given ends, level 0 first."""
    if not len(at):
        return []
    order = np.argsort(level[at], kind="stable")
    return np.split(order, np.flatnonzero(np.diff(level[at][order])) + 1)


#: Most rows that share an end in a level before it is left to ufunc.at.
MOST_TURNS = 32


def in_turns(at: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, bool]]:
    """rows in parts in which no end (at) occurs twice, each end's rows in order, with True; all rows with False where an end has very many."""
    order = rows[np.argsort(at[rows], kind="stable")]
    first = np.r_[True, np.diff(at[order]) != 0] if len(order) else np.zeros(0, bool)
    turn = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    if len(order) and turn.max() >= MOST_TURNS:
        return [(rows, False)]
    return [(order[turn == k], True) for k in range(int(turn.max()) + 1)] if len(order) else []


def merge(op: np.ufunc, x: np.ndarray, at: np.ndarray, v: np.ndarray, alone: bool) -> None:
    """op.at(x, at, v); faster where no end occurs twice (alone)."""
    if alone:
        x[at] = op(x[at], v)
    else:
        op.at(x, at, v)


class Net:
    """What passes over a chunk of networks need of their links, made once for many samples."""

    def __init__(self, a: pd.DataFrame, e: pd.DataFrame):
        e, self.level = acyclic(len(a), e)
        self.src, self.dst, self.p = e.src.to_numpy(int), e.dst.to_numpy(int), a.p.to_numpy()
        rel = e.rel.str.upper().to_numpy(object) if len(e) else np.zeros(0, object)
        self.lag = e.lag.to_numpy(float)[:, None]
        self.from_finish, self.to_finish = ~np.isin(rel, ["SS", "SF"]), np.isin(rel, ["FF", "SF"])
        self.projects = int(self.p.max()) + 1 if len(a) else 0
        self.forward = [t for g in by_level(self.level, self.dst) for t in in_turns(self.dst, g)]
        self.backward = [t for g in reversed(by_level(self.level, self.src)) for t in in_turns(self.src, g)]
        self.own = in_turns(self.p, np.arange(len(a)))

    @cached_property
    def steps(self) -> list[tuple[np.ndarray, list, list]]:
        """By level: its activities, and the links that leave them to a start and to a finish."""
        out_of = {int(self.level[self.src[g[0]]]): g for g in by_level(self.level, self.src)}
        order, none = np.argsort(self.level, kind="stable"), np.zeros(0, int)
        out = []
        for nodes in np.split(order, np.flatnonzero(np.diff(self.level[order])) + 1):
            g = out_of.get(int(self.level[nodes[0]]), none) if len(nodes) else none
            out.append((nodes, in_turns(self.dst, g[~self.to_finish[g]]), in_turns(self.dst, g[self.to_finish[g]])))
        return out

    def by_project(self, op: np.ufunc, x: np.ndarray, start: float, rows: np.ndarray | None = None) -> np.ndarray:
        """op over the rows of x of each project, in order; only those that rows (booleans) says."""
        out = np.full((self.projects, x.shape[1]), start)
        for k, alone in self.own:
            k = k if rows is None else k[rows[k]]
            merge(op, out, self.p[k], x[k], alone)
        return out


def passes(a: pd.DataFrame, e: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """Activities with es, ef, ls, lf, tf and critical; the links kept; the levels."""
    d = np.nan_to_num(a.duration.to_numpy(float))
    e, level = acyclic(len(a), e)
    src, dst, w = e.src.to_numpy(int), e.dst.to_numpy(int), weights(e, d)
    es = np.zeros(len(a))
    for g in by_level(level, dst):
        np.maximum.at(es, dst[g], es[src[g]] + w[g])
    span = np.full(int(a.p.max()) + 1 if len(a) else 0, -np.inf)
    np.maximum.at(span, a.p.to_numpy(), es + d)
    ls = span[a.p.to_numpy()] - d
    for g in reversed(by_level(level, src)):
        np.minimum.at(ls, src[g], ls[dst[g]] - w[g])
    tf = ls - es
    return a.assign(es=es, ef=es + d, ls=ls, lf=ls + d, tf=tf, critical=np.abs(tf) < 1e-9, makespan=span[a.p.to_numpy()]), e.assign(w=w), level


#: Paths that are followed at once.
HELD_PATHS = 10_000
CPM = "project_id long, id string, seq int, es double, ef double, ls double, lf double, tf double, critical boolean, makespan double"


def cpm(acts: DataFrame, links: DataFrame) -> DataFrame:
    """Early and late dates, total float and criticality of every activity.

    A missing duration is 0; unknown relations are FS; early starts are at least 0. Of parallel links all
    count. On a cycle, links against the input order are left out. Empty tables give no rows.
    """
    return graph_apply(acts, links, lambda a, e: passes(a, e)[0], CPM, ["seq", "duration"])


def critical_path(acts: DataFrame, links: DataFrame) -> DataFrame:
    """(project_id, pos, id): the path from the first critical activity without a critical
    predecessor, always to the first critical successor in link order."""

    def kernel(a, e):
        a, e, level = passes(a, e)
        crit = a.critical.to_numpy()
        src, dst = e.src.to_numpy(int), e.dst.to_numpy(int)
        both = crit[src] & crit[dst]
        nxt = np.full(len(a), -1)
        order = np.lexsort((e.ord.to_numpy(), src))[::-1]
        order = order[both[order]]
        nxt[src[order]] = dst[order]  # the first link is written last
        begins = crit.copy()
        begins[dst[both]] = False
        rank = np.lexsort((np.arange(len(a)), level))
        rank = rank[begins[rank]]
        p = a.p.to_numpy()
        _, first = np.unique(p[rank], return_index=True)
        at, pos, rows = rank[first], 0, []
        while len(at):
            rows.append(np.stack([at, np.full(len(at), pos)]))
            at, pos = nxt[at], pos + 1
            at = at[at >= 0]
        at, pos = np.concatenate(rows, axis=1) if rows else np.zeros((2, 0), int)
        return pd.DataFrame({"project_id": a.project_id.to_numpy()[at], "pos": pos, "id": a.id.to_numpy()[at]})

    return graph_apply(acts, links, kernel, "project_id long, pos int, id string", ["seq", "duration"])


def distances(acts: DataFrame, links: DataFrame) -> DataFrame:
    """Shortest and longest distance of every activity from any start and to any end.

    Toward the end an overlapping relation counts at least the activity's own duration; from the start
    a finish-bound link never shortens.
    """

    def kernel(a, e):
        d = np.nan_to_num(a.duration.to_numpy(float))
        e, level = acyclic(len(a), e)
        src, dst, w = e.src.to_numpy(int), e.dst.to_numpy(int), weights(e, d)
        rel = e.rel.str.upper().to_numpy(object) if len(e) else np.zeros(0, object)
        finish = np.isin(rel, ["FF", "SF"])
        forward = np.where(finish, np.maximum(w, 0), w)
        out = {}
        sources = np.bincount(dst, minlength=len(a)) == 0
        for name, best, none in (("shortest_from_start", np.minimum, np.inf), ("longest_from_start", np.maximum, -np.inf)):
            x = np.where(sources, 0.0, none)
            for g in by_level(level, dst):
                best.at(x, dst[g], x[src[g]] + forward[g])
            out[name] = x
        sinks = np.bincount(src, minlength=len(a)) == 0
        fs = ~np.isin(rel, ["SS", "FF", "SF"])
        lag = e.lag.to_numpy(float)
        add = np.where(rel == "SS", lag, np.where(rel == "FF", np.maximum(0, d[src] + lag - d[dst]), np.maximum(0, lag - d[dst])))
        for name, best, none in (("shortest_to_end", np.minimum, np.inf), ("longest_to_end", np.maximum, -np.inf)):
            x = np.where(sinks, 0.0, none)
            for g in reversed(by_level(level, src)):
                s, t = src[g], dst[g]
                best.at(x, s, np.where(fs[g], x[t] + d[s] + lag[g], np.maximum(d[s], add[g] + x[t])))
            out[name] = x
        return a.assign(**out)

    return graph_apply(acts, links, kernel, "project_id long, id string, shortest_from_start double, longest_from_start double, shortest_to_end double, longest_to_end double", ["seq", "duration"])


def path_durations(acts: DataFrame, links: DataFrame, most_paths: int | None = None) -> DataFrame:
    """(project_id, length, duration, path) of every path from a start to an end.

    A path's duration runs along its relations with starts clamped at 0. Paths are followed depth first,
    HELD_PATHS at once, and given as they end, so a project's number of paths bounds time but not memory. With
    most_paths, projects with more paths (counted before any is listed) are left out.
    """

    def kernel(a, e):
        d = np.nan_to_num(a.duration.to_numpy(float))
        e, level = acyclic(len(a), e)
        src, dst, lags = e.src.to_numpy(int), e.dst.to_numpy(int), e.lag.to_numpy(float)
        rel = e.rel.str.upper().to_numpy(object) if len(e) else np.zeros(0, object)
        ids, projects, p = a.id.to_numpy(object), a.project_id.to_numpy(), a.p.to_numpy()
        starts, ends = np.bincount(dst, minlength=len(a)) == 0, np.bincount(src, minlength=len(a)) == 0
        ok = np.ones(len(a), bool)
        if most_paths is not None:
            count = starts.astype(float)
            for g in by_level(level, dst):
                np.add.at(count, dst[g], count[src[g]])
            ok = np.bincount(p[ends], count[ends], minlength=len(a))[p] <= most_paths
        order = np.lexsort((e.ord.to_numpy(), src))
        first = np.searchsorted(src[order], np.arange(len(a) + 1))
        at = np.flatnonzero(starts & ok)
        # a frame: activities reached, their start and finish, places in the frame before, and that frame
        stack = [(at[i : i + HELD_PATHS], np.zeros(len(at[i : i + HELD_PATHS])), d[at[i : i + HELD_PATHS]], None, None) for i in range(0, len(at), HELD_PATHS)]
        while stack:
            frame = stack.pop()
            at, start, finish, _, before = frame
            over = np.flatnonzero(ends[at])
            if len(over):
                cols, i, f = [], over, frame
                while f is not None:
                    cols.append(f[0][i])
                    i, f = (f[3][i] if f[3] is not None else i), f[4]
                paths = np.stack(cols[::-1], axis=1)
                yield pd.DataFrame({"project_id": projects[paths[:, 0]], "length": np.full(len(over), len(cols), "int32"), "duration": finish[over] if before is not None else np.zeros(len(over)), "path": [">".join(ids[x]) for x in paths]})
            n = first[at + 1] - first[at]
            who = np.repeat(np.arange(len(at)), n)
            k = order[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            to, r = dst[k], rel[k]
            s, f, own = start[who], finish[who], d[to]
            by_finish = np.isin(r, ["FF", "SF"])
            base = np.where(np.isin(r, ["SS", "SF"]), s, f) + lags[k]
            ns = np.maximum(np.where(by_finish, np.maximum(base - own, 0), base), 0)
            nf = np.maximum(np.where(by_finish, base, ns + own), ns + own)
            stack += [(to[i : i + HELD_PATHS], ns[i : i + HELD_PATHS], nf[i : i + HELD_PATHS], who[i : i + HELD_PATHS], frame) for i in range(0, len(to), HELD_PATHS)]

    return graph_apply(acts, links, kernel, "project_id long, length int, duration double, path string", ["seq", "duration"])


def predecessor_rankings(acts: DataFrame, links: DataFrame, top: int = 10) -> DataFrame:
    """Each activity's predecessors by how near they come to fixing its early start; top of them.

    Of parallel links the most binding one counts. delta is how much later the predecessor could push
    without moving the activity. Ties go by link order.
    """

    def kernel(a, e):
        a, e, _ = passes(a, e)
        src, dst = e.src.to_numpy(int), e.dst.to_numpy(int)
        t = pd.DataFrame({"src": src, "dst": dst, "c": a.es.to_numpy()[src] + e.w.to_numpy(), "ord": e.ord.to_numpy()})
        t = t.sort_values(["c", "ord"], ascending=[False, True], kind="stable").drop_duplicates(["src", "dst"])
        t["delta"] = t.groupby("dst").c.transform("max") - t.c
        t = t.sort_values(["dst", "c", "src"], ascending=[True, False, True], kind="stable")
        t["rank"] = t.groupby("dst").cumcount() + 1
        t = t[t["rank"] <= top]
        ids = a.id.to_numpy(object)
        return pd.DataFrame({"project_id": a.project_id.to_numpy()[t.dst], "id": ids[t.dst], "rank": t["rank"].to_numpy("int32"), "pred_id": ids[t.src], "candidate_es": t.c.to_numpy(), "delta": t.delta.to_numpy(), "driving": t.delta.to_numpy() <= 1e-6, "near_driving": t.delta.to_numpy() <= 8.0})

    return graph_apply(acts, links, kernel, "project_id long, id string, rank int, pred_id string, candidate_es double, delta double, driving boolean, near_driving boolean", ["seq", "duration"])


def risk_propagation(acts: DataFrame, links: DataFrame, places: int = 4) -> DataFrame:
    """propagated_risk (own risk and the mean of the predecessors' propagated) and risk_transmission
    (times the number of successors); a pair of activities counts once. Both are rounded."""

    def kernel(a, e):
        e = e.drop_duplicates(["src", "dst"], keep="last").reset_index(drop=True)
        e, level = acyclic(len(a), e)
        src, dst = e.src.to_numpy(int), e.dst.to_numpy(int)
        prop = np.nan_to_num(a.risk.to_numpy(float))
        n_pred = np.bincount(dst, minlength=len(a))
        for g in by_level(level, dst):
            np.add.at(prop, dst[g], prop[src[g]] / n_pred[dst[g]])
        out_degree = np.bincount(src, minlength=len(a))
        return a.assign(propagated_risk=np.round(prop, places), risk_transmission=np.round(prop * out_degree, places))

    return graph_apply(acts, links, kernel, "project_id long, id string, propagated_risk double, risk_transmission double", ["seq", "risk"])
