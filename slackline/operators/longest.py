"""The longest paths of networks with any number of paths, and parts of networks between given activities."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from slackline.plans.grouped import graph_apply

from .cpm import acyclic, by_level


def longest_paths(acts: DataFrame, links: DataFrame, most: int = 20) -> DataFrame:
    """(project_id, rank, estimate, duration, path, n_paths, truncated): each project's longest paths, longest first.

    A path's estimate is the sum of its durations and lags, whatever the relations; ties go to the smaller path as text.
    duration runs along the relations with starts clamped at 0. n_paths counts all paths (as a double, which may be
    infinite), and truncated tells that there are more than `most`, so nothing is left out unsaid. Every activity keeps the
    `most` best ways to an end, made from those of its successors: the work grows with links times `most`, not with the
    number of paths. On a cycle, links against the input order are left out. Parallel links are paths of their own. A missing
    duration is 0. Empty tables give no rows.
    """

    def kernel(a, e):
        d = np.nan_to_num(a.duration.to_numpy(float))
        e, level = acyclic(len(a), e)
        src, dst, lag = e.src.to_numpy(int), e.dst.to_numpy(int), e.lag.to_numpy(float)
        rel = e.rel.str.upper().to_numpy(object) if len(e) else np.zeros(0, object)
        ids, p = a.id.to_numpy(object), a.p.to_numpy()
        order = np.argsort(src, kind="stable")
        first = np.searchsorted(src[order], np.arange(len(a) + 1))
        count = np.zeros(len(a))
        # (minus the estimate, path as text, link, rank in the successor's list)
        best: list[list[tuple]] = [[] for _ in range(len(a))]
        for v in np.argsort(-level, kind="stable").tolist():
            out = order[first[v] : first[v + 1]].tolist()
            if not out:
                count[v], best[v] = 1.0, [(-d[v], ids[v], -1, 0)]
                continue
            count[v] = sum(count[dst[k]] for k in out)
            ways = ((s - lag[k] - d[v], f"{ids[v]}>{text}", k, i) for k in out for i, (s, text, _, _) in enumerate(best[dst[k]]))
            best[v] = heapq.nsmallest(most, ways)

        def exact(v: int, rank: int) -> float:
            start, finish, hops = 0.0, d[v], 0
            while best[v][rank][2] >= 0:
                _, _, k, rank = best[v][rank]
                v, hops = dst[k], hops + 1
                base = (start if rel[k] in ("SS", "SF") else finish) + lag[k]
                by_finish = rel[k] in ("FF", "SF")
                start = max(max(base - d[v], 0) if by_finish else base, 0)
                finish = max(base if by_finish else start + d[v], start + d[v])
            return float(finish) if hops else 0.0

        rows = []
        starts = np.flatnonzero(np.bincount(dst, minlength=len(a)) == 0)
        for of in np.split(starts, np.flatnonzero(np.diff(p[starts])) + 1) if len(starts) else ():
            ways = heapq.nsmallest(most, ((*w[:2], int(v), i) for v in of for i, w in enumerate(best[v])))
            n = float(count[of].sum())
            rows += [(a.project_id.iloc[of[0]], r, 0.0 - s, exact(v, i), text, n, n > most) for r, (s, text, v, i) in enumerate(ways, 1)]
        return pd.DataFrame(rows, columns=["project_id", "rank", "estimate", "duration", "path", "n_paths", "truncated"])

    return graph_apply(acts, links, kernel, "project_id long, rank int, estimate double, duration double, path string, n_paths double, truncated boolean", ["seq", "duration"])


def between(acts: DataFrame, links: DataFrame) -> DataFrame:
    """(project_id, id): activities that a start activity reaches and that reach an end activity (both included).

    acts has boolean columns is_start and is_end (null: false). Without a start or an end a project has none.
    """

    def kernel(a, e):
        e, level = acyclic(len(a), e)
        src, dst = e.src.to_numpy(int), e.dst.to_numpy(int)
        ahead, back = a.is_start.fillna(False).to_numpy(bool), a.is_end.fillna(False).to_numpy(bool)
        for g in by_level(level, dst):
            np.logical_or.at(ahead, dst[g], ahead[src[g]])
        for g in reversed(by_level(level, src)):
            np.logical_or.at(back, src[g], back[dst[g]])
        return a[ahead & back]

    return graph_apply(acts, links, kernel, "project_id long, id string", ["seq", "is_start", "is_end"])


def downstream(acts: DataFrame, links: DataFrame, hops: int = 10, most: int = 25) -> DataFrame:
    """(project_id, id, hops): the activities that lie up to `hops` links behind one of column is_start, nearest first
    (ties in input order), at most `most` of a project; the start itself is none. A report, not a filter."""

    def kernel(a, e):
        src, dst = e.src.to_numpy(int), e.dst.to_numpy(int)
        away = np.where(a.is_start.fillna(False).to_numpy(bool), 0, -1)
        for k in range(hops):
            to = dst[away[src] == k]
            away[to[away[to] < 0]] = k + 1
        a = a.assign(hops=away)[away > 0].sort_values(["p", "hops", "seq"], kind="stable")
        return a[a.groupby("p").cumcount() < most]

    return graph_apply(acts, links, kernel, "project_id long, id string, hops int", ["seq", "is_start"])
