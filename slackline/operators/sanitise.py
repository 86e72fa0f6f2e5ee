"""Making a network acyclic and connecting loose ends to its milestones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.plans.grouped import graph_apply

from .cpm import levels


def first_cycle(start: list[int], near: dict[int, list[int]]) -> list[tuple[int, int]] | None:
    """Links of the first cycle that a depth-first search from these nodes in order meets."""
    done: set[int] = set()
    for root in start:
        if root in done:
            continue
        trail, place, stack = [root], {root: 0}, [iter(near.get(root, ()))]
        while stack:
            for x in stack[-1]:
                if x in place:
                    loop = trail[place[x] :]
                    return list(zip(loop, loop[1:] + [x]))
                if x not in done:
                    place[x] = len(trail)
                    trail.append(x)
                    stack.append(iter(near.get(x, ())))
                    break
            else:
                stack.pop()
                x = trail.pop()
                del place[x]
                done.add(x)
    return None


def removed_links(acts: DataFrame, links: DataFrame) -> DataFrame:
    """(project_id, source, target): links to cut so that no cycle is left.

    Of each cycle found the smallest link goes (by source, target, relation, lag), until none is left or half of the
    project's links are gone. Of parallel links the last counts, and all of a cut pair go. Only projects
    on whose levels a cycle shows are searched.
    """

    def kernel(a, e):
        e = e.drop_duplicates(["src", "dst"], keep="last").reset_index(drop=True)
        p, ids, projects = a.p.to_numpy(), a.id.to_numpy(object), a.project_id.to_numpy()
        stuck = np.unique(p[levels(len(a), e.src.to_numpy(int), e.dst.to_numpy(int)) < 0])
        rows = []
        for q in stuck.tolist():
            own = e[p[e.src.to_numpy(int)] == q]
            key = {(s, t): (str(ids[s]), str(ids[t]), str(r), float(lag)) for s, t, r, lag in zip(own.src, own.dst, own.rel, own.lag)}
            near: dict[int, list[int]] = {}
            for s, t in key:
                near.setdefault(s, []).append(t)
            for _ in range(max(len(key) // 2, 1)):
                loop = first_cycle(np.flatnonzero(p == q).tolist(), near)
                if loop is None:
                    break
                s, t = min(loop, key=key.get)
                near[s].remove(t)
                rows.append((projects[s], ids[s], ids[t]))
        return pd.DataFrame(rows, columns=["project_id", "source", "target"])

    return graph_apply(acts, links, kernel, "project_id long, source string, target string", ["seq"])


def sanitised(acts: DataFrame, links: DataFrame) -> DataFrame:
    """links without the cut ones, and with loose starts and ends linked to the project's first start and end milestone.

    acts needs a boolean column milestone. Projects without both kinds of milestone keep their loose ends. A new link is
    finish to start without lag.
    """
    kept = links.join(removed_links(acts, links), ["project_id", "source", "target"], "left_anti").select("project_id", "source", "target", "rel", "lag", "ord")
    starts = acts.join(kept.select("project_id", F.col("target").alias("id")), ["project_id", "id"], "left_anti").select("project_id", "id", "seq", "milestone")
    ends = acts.join(kept.select("project_id", F.col("source").alias("id")), ["project_id", "id"], "left_anti").select("project_id", "id", "seq", "milestone")
    first = starts.where("milestone").groupBy("project_id").agg(F.min_by("id", "seq").alias("first"))
    last = ends.where("milestone").groupBy("project_id").agg(F.min_by("id", "seq").alias("last"))
    anchors = first.join(last, "project_id")
    row = lambda s, t: ["project_id", F.col(s).alias("source"), F.col(t).alias("target"), F.lit("FS").alias("rel"), F.lit(0.0).alias("lag"), F.lit(1 << 20).alias("ord")]
    to_start = starts.join(anchors, "project_id").where("id != first").select(*row("first", "id"))
    to_end = ends.join(anchors, "project_id").where("id != last").select(*row("id", "last"))
    return kept.unionByName(to_start).unionByName(to_end)


def components_of_cycles(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A number for each node, equal for nodes on common cycles; numbers fall along the links between them (Tarjan's order)."""
    order = np.argsort(src, kind="stable")
    to, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    index, low, number, on, held, count = [-1] * n, [0] * n, [-1] * n, [False] * n, [], [0, 0]
    for root in range(n):
        if index[root] >= 0:
            continue
        todo = [(root, first[root])]
        while todo:
            v, k = todo.pop()
            if k == first[v] and index[v] < 0:
                index[v] = low[v] = count[0]
                count[0] += 1
                held.append(v)
                on[v] = True
            if k < first[v + 1]:
                todo.append((v, k + 1))
                w = to[k]
                if index[w] < 0:
                    todo.append((w, first[w]))
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            if low[v] == index[v]:
                while True:
                    w = held.pop()
                    on[w], number[w] = False, count[1]
                    if w == v:
                        break
                count[1] += 1
            if todo:
                u = todo[-1][0]
                low[u] = min(low[u], low[v])
    return np.array(number, int)


def risk_on_cycles(acts: DataFrame, links: DataFrame, damping: float = 0.5, rounds: int = 50, places: int = 4) -> DataFrame:
    """(project_id, id, propagated_risk, on_cycle, converged): own risk and the mean of the predecessors' propagated, in networks that may have
    cycles. Nodes on common cycles are iterated together, damped, until nothing moves by 1e-9; where `rounds` don't suffice they keep their own
    risk. A pair of activities counts once; links to itself don't count. Without cycles this is risk_propagation()."""

    def kernel(a, e):
        e = e[e.src != e.dst].drop_duplicates(["src", "dst"], keep="last")
        src, dst, n = e.src.to_numpy(int), e.dst.to_numpy(int), len(a)
        part = components_of_cycles(n, src, dst)
        size = np.bincount(part, minlength=1)[part]
        own = np.nan_to_num(a.risk.to_numpy(float))
        prop, fine = own.copy(), np.ones(n, bool)
        order = np.argsort(dst, kind="stable")
        before, first = src[order], np.searchsorted(dst[order], np.arange(n + 1))
        nodes = np.argsort(-part, kind="stable")  # predecessors have larger numbers
        for group in np.split(nodes, np.flatnonzero(np.diff(part[nodes])) + 1) if n else ():
            preds = [before[first[v] : first[v + 1]] for v in group]
            mean = lambda: np.array([prop[x].mean() if len(x) else 0.0 for x in preds])  # noqa: B023, E731
            if len(group) == 1:
                prop[group] = own[group] + mean()
                continue
            for _ in range(rounds):
                new = damping * (own[group] + mean()) + (1 - damping) * prop[group]
                moved = np.abs(new - prop[group]).max()
                prop[group] = new
                if moved < 1e-9:
                    break
            else:
                prop[group], fine[group] = own[group], False
        return a.assign(propagated_risk=np.round(prop, places), on_cycle=size > 1, converged=fine)

    return graph_apply(acts, links, kernel, "project_id long, id string, propagated_risk double, on_cycle boolean, converged boolean", ["seq", "risk"])
