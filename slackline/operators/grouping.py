"""Groups of activities within a project: by distance in the network, and by risk and importance; groups of sampled outcomes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from slackline.plans.grouped import graph_apply

from .community import louvain
from .cpm import Net
from .ensemble import early
from .montecarlo import BLOCK, Draws

#: Most activities of a project whose distances are made (fixed value); larger ones are split by modularity.
SMALL = 2000
#: Distance of activities that no links connect (fixed value).
APART = 1e9


def numbered(label: np.ndarray) -> np.ndarray:
    """Labels as numbers from 0 in the order in which they first occur."""
    return pd.factorize(label)[0]


def hops(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of links between any two nodes, whatever their direction; frontiers of (from, node) move by a link at a time."""
    out = np.full((n, n), APART)
    np.fill_diagonal(out, 0)
    tail, head = np.r_[a, b], np.r_[b, a]
    order = np.argsort(tail, kind="stable")
    head, first = head[order], np.searchsorted(tail[order], np.arange(n + 1))
    frm, at, k = np.arange(n), np.arange(n), 0
    while len(at):
        k += 1
        degree = first[at + 1] - first[at]
        step = np.arange(degree.sum()) - np.repeat(np.cumsum(degree) - degree, degree)
        to, src = head[np.repeat(first[at], degree) + step], np.repeat(frm, degree)
        new = out[src, to] == APART
        pair = np.unique(src[new] * n + to[new])
        frm, at = pair // n, pair % n
        out[frm, at] = k
    return out


def complete_linkage(dist: np.ndarray, most: int) -> np.ndarray:
    """Labels for 1 to `most` groups, a row for each number: the two groups whose farthest members are nearest are joined first
    (ties: those of the smallest first members)."""
    n = len(dist)
    d = dist.astype(float).copy()
    d[np.tril_indices(n)] = np.inf  # row i: groups with a later first member
    label, low = np.arange(n), d.min(1)
    out = np.zeros((most, n), int)
    alive = np.ones(n, bool)
    for left in range(n, 1, -1):
        if left <= most:
            out[left - 1] = label
        i = int(low.argmin())
        j = int(d[i].argmin())
        both = np.maximum(np.minimum(d[i], d[:, i]), np.minimum(d[j], d[:, j]))  # one of a pair's two cells is infinite
        alive[j] = False
        both[~alive] = np.inf
        both[i] = np.inf
        stale = np.minimum(d[:, i], d[:, j]) <= low  # rows that lose their nearest; distances only grow
        stale[i] = True
        d[j], d[:, j], low[j] = np.inf, np.inf, np.inf
        d[i, i + 1 :], d[:i, i] = both[i + 1 :], both[:i]
        stale = np.flatnonzero(stale & alive)
        low[stale] = d[stale].min(1)
        label[label == j] = i
    return out


def silhouette(dist: np.ndarray, label: np.ndarray) -> float:
    """Mean over nodes of (nearest other group - own group) / the larger, by mean distances; 0 for a node alone."""
    k = int(label.max()) + 1
    one = np.eye(k)[label]
    size, total = one.sum(0), dist @ one
    own = size[label]
    inner = total[np.arange(len(label)), label] / np.maximum(own - 1, 1)
    other = np.where(one > 0, np.inf, total / size)
    near = other.min(1)
    return float(np.where(own > 1, (near - inner) / np.maximum(np.maximum(near, inner), 1e-300), 0).mean())


def dependency_groups(acts: DataFrame, links: DataFrame, least_small: int = 6) -> DataFrame:
    """(project_id, id, grp): groups of activities that are near each other in the network, numbered by first activity.

    Complete linkage of the number of links between activities; the number of groups (2 to 10, half the activities at most)
    is that of the best silhouette, of equals the smallest; 2 groups below `least_small` activities. A project of more
    than 2,000 activities is split by modularity instead. One activity is one group; parallel links count once.
    """

    def kernel(a, e):
        p, n = a.p.to_numpy(), len(a)
        pair = pd.DataFrame({"a": np.minimum(e.src, e.dst), "b": np.maximum(e.src, e.dst)}).drop_duplicates().to_numpy(int)
        grp = np.zeros(n, int)
        at = np.r_[0, np.flatnonzero(np.diff(p)) + 1, n] if n else np.zeros(1, int)
        pair = pair[np.argsort(pair[:, 0], kind="stable")]
        for s, t in zip(at[:-1].tolist(), at[1:].tolist()):
            lo, hi = np.searchsorted(pair[:, 0], [s, t])
            x, y = pair[lo:hi, 0] - s, pair[lo:hi, 1] - s
            if t - s > SMALL:
                grp[s:t] = numbered(louvain(t - s, x, y, np.ones(len(x)), np.zeros(t - s, int)))
            elif t - s > 1:
                grp[s:t] = _near(hops(t - s, x, y), least_small)
        return a.assign(grp=grp)

    return graph_apply(acts, links, kernel, "project_id long, id string, grp int", ["seq"])


def _near(dist: np.ndarray, least_small: int) -> np.ndarray:
    n = len(dist)
    if n < least_small:
        return numbered(complete_linkage(dist, 2)[1])
    ways = [numbered(w) for w in complete_linkage(dist, min(10, n // 2))[1:]]
    return max(ways, key=lambda w: (round(silhouette(dist, w), 12), -w.max()))


def kmeans(x: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Labels of k groups by Lloyd's steps, begun with points far from each other (the first: the one nearest the mean). Deterministic; ties
    go to the first."""
    away = lambda c: ((x - c) ** 2).sum(1)
    centres = [x[away(x.mean(0)).argmin()]]
    for _ in range(k - 1):
        centres.append(x[np.min([away(c) for c in centres], axis=0).argmax()])
    c, label = np.stack(centres), np.full(len(x), -1)
    for _ in range(rounds):
        new = np.stack([away(m) for m in c]).argmin(0)
        if (new == label).all():
            break
        label = new
        c = np.stack([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
    return label


def density_clusters(x: np.ndarray, least: int, neighbours: int, block: int = 1024) -> np.ndarray:
    """Labels of clusters of varying density (-1: noise): the minimum spanning tree of mutual reachability, condensed to
    clusters of `least` points or more, of which the most stable are taken; all points together are no cluster.

    A point counts among its own neighbours. Distances are made by rows, never all at once.
    """
    n = len(x)
    core = np.concatenate([np.partition(np.sqrt(((x[i : i + block, None] - x[None]) ** 2).sum(2)), min(neighbours, n) - 1, axis=1)[:, min(neighbours, n) - 1] for i in range(0, n, block)])
    best, frm, todo = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    v, tree = 0, []
    for _ in range(n - 1):
        todo[v] = False
        reach = np.maximum(np.maximum(np.sqrt(((x - x[v]) ** 2).sum(1)), core), core[v])
        nearer = todo & (reach < best)
        best[nearer], frm[nearer] = reach[nearer], v
        v = int(np.where(todo, best, np.inf).argmin())
        tree.append((best[v], int(frm[v]), v))
    # merge tree: node n + i is what the i-th shortest edge joins
    top, size, child, rate = list(range(n)), [1] * n, {}, {}
    up = list(range(2 * n))

    def root(u):
        while up[u] != u:
            up[u] = up[up[u]]
            u = up[u]
        return u

    for w, a, b in sorted(tree):
        a, b, new = root(a), root(b), len(top)
        top.append(new)
        size.append(size[a] + size[b])
        child[new], rate[new] = (a, b), 1 / max(w, 1e-12)
        up[a] = up[b] = new
    # condensed: each cluster's birth, stability, and the clusters it splits into
    birth, gain, parts, fallen = [0.0], [0.0], [[]], [[]]
    walk = [(2 * n - 2, 0)] if n > 1 else []
    while walk:
        u, c = walk.pop()
        if u < n:
            fallen[c].append(u)
            continue
        big = [s for s in child[u] if size[s] >= least]
        for s in child[u]:
            if len(big) == 2:
                gain[c] += size[s] * (rate[u] - birth[c])
                parts[c].append(len(birth))
                walk.append((s, len(birth)))
                birth.append(rate[u])
                gain.append(0.0)
                parts.append([])
                fallen.append([])
            elif s in big:
                walk.append((s, c))
            else:
                gain[c] += size[s] * (rate[u] - birth[c])
                under = [s]
                while under:
                    y = under.pop()
                    if y < n:
                        fallen[c].append(y)
                    else:
                        under += child[y]
    taken = set()
    for c in range(len(birth) - 1, 0, -1):
        inner = sum(gain[s] for s in parts[c])
        if parts[c] and inner > gain[c]:
            gain[c] = inner
        else:
            taken.add(c)
    label = np.full(n, -1)
    walk = [(0, -1)]
    while walk:
        c, name = walk.pop()
        name = c if name < 0 and c in taken else name
        label[fallen[c]] = name
        walk += [(s, name) for s in parts[c]]
    return label


def risk_groups(acts: DataFrame) -> DataFrame:
    """(project_id, id, cluster, method): each project's activities by importance and risk, clusters numbered by first activity.

    From 15 activities with 5 different points on, clusters of density (n / 20 points at least, 5 or more; 3 neighbours) count if there
    are two or more and half the points at most is noise; noise joins the cluster of its nearest point. Otherwise k-means with
    sqrt(n / 2) clusters, 2 to 10, no more than there are different points. Missing values are 0.
    """

    def kernel(a, e):
        xy = np.nan_to_num(a[["importance", "risk"]].to_numpy(float))
        p, n = a.p.to_numpy(), len(a)
        out, how = np.zeros(n, int), np.full(n, "k-means", object)
        at = np.r_[0, np.flatnonzero(np.diff(p)) + 1, n] if n else np.zeros(1, int)
        for s, t in zip(at[:-1].tolist(), at[1:].tolist()):
            x, label = xy[s:t], None
            m, unlike = t - s, len(np.unique(xy[s:t], axis=0))
            if m >= 15 and unlike >= 5:
                label = density_clusters(x, max(5, m // 20), 3)
                if label.max() < 0 or len(np.unique(label[label >= 0])) < 2 or (label < 0).mean() > 0.5:
                    label = None
                else:
                    label = with_noise(x, label)
                    how[s:t] = "density"
            if label is None:
                label = kmeans(x, min(max(2, min(10, int((m / 2) ** 0.5))), unlike))
            out[s:t] = numbered(label)
        return a.assign(cluster=out, method=how)

    none = acts.select("project_id", *[acts["id"].alias(c) for c in ("source", "target", "rel")], acts["seq"].alias("ord"), acts["risk"].alias("lag")).where("false")
    return graph_apply(acts, none, kernel, "project_id long, id string, cluster int, method string", ["seq", "importance", "risk"])


def with_noise(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Points labelled -1 take the label of the nearest other point (ties: the first)."""
    out, known = label.copy(), np.flatnonzero(label >= 0)
    for i in np.flatnonzero(label < 0):
        out[i] = label[known[((x[known] - x[i]) ** 2).sum(1).argmin()]]
    return out


def joint_overruns(scoped: DataFrame, links: DataFrame, samples: int, rate: float = 1.0) -> DataFrame:
    """(project_id, cluster, label, n, schedule_mean, schedule_max, cost_mean, cost_max, correlation, schedule_p95, cost_p95): three k-means groups
    of each project's samples by overrun of makespan and of cost against the plan, by mean overrun of both together.

    A group is nominal if its mean overruns are below 0.1 together, of the schedule or the cost if that is more than 1.5 times the
    other, else coupled. Fewer than 6 samples: no rows. Correlation is 0 where either is constant; P95 is interpolated.
    scoped has duration, remaining, risk, fat and resource_count.
    """
    schema = "project_id long, cluster int, label string, n int, schedule_mean double, schedule_max double, cost_mean double, cost_max double, correlation double, schedule_p95 double, cost_p95 double"

    def kernel(a, e):
        if not len(a) or samples < 6:
            return
        net, draws = Net(a, e), Draws(a)
        d = np.nan_to_num(a.duration.to_numpy(float))[:, None]
        res = rate * np.maximum(np.nan_to_num(a.resource_count.to_numpy(float)), 1)[:, None]

        def outcome(x):
            return [v.T for v in (early(net, x)[2], net.by_project(np.add, res * x, 0.0))]

        base = [np.maximum(v, 1e-9) for v in outcome(d)]
        drawn = [np.concatenate(v) for v in zip(*(outcome(d * draws(s, min(BLOCK, samples - s))) for s in range(0, samples, BLOCK)))]
        rows = overruns(*((v - b) / b for v, b in zip(drawn, base)))
        rows.insert(0, "project_id", a.project_id.drop_duplicates().to_numpy()[rows.pop("p")])
        yield rows

    return graph_apply(scoped, links, kernel, schema, ["seq", "duration", "remaining", "risk", "fat", "resource_count"])


def kmeans_each(s: np.ndarray, c: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """kmeans(x, k) of the points (s, c) of many projects at once, a column each: labels (points, projects)."""
    each = np.arange(s.shape[1])
    away = lambda at: (s - at[0]) ** 2 + (c - at[1]) ** 2
    point = lambda i: (s[i, each], c[i, each])
    centres = [point(away((s.mean(0), c.mean(0))).argmin(0))]
    for _ in range(k - 1):
        centres.append(point(np.min([away(m) for m in centres], axis=0).argmax(0)))
    out, left = np.full(s.shape, -1), each  # left: the projects whose labels still change
    at = np.array(centres)  # centres, coordinates, projects
    for _ in range(rounds):
        new = np.stack([away(m) for m in at]).argmin(0)
        moves = (new != out[:, left]).any(0)
        left, new, at, s, c = left[moves], new[:, moves], at[..., moves], s[:, moves], c[:, moves]
        if not len(left):
            break
        out[:, left] = new
        for i in range(k):
            own = new == i
            n = own.sum(0)
            for j, v in enumerate((s, c)):
                at[i, j] = np.where(n > 0, np.where(own, v, 0.0).sum(0) / np.maximum(n, 1), at[i, j])
    return out


NAMES = np.array(["cost_dominated", "coupled", "nominal", "schedule_dominated"], object)


def overruns(s: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    """Rows of joint_overruns, with p for the number of the project: overruns of schedule and cost (samples, projects)."""
    each = np.arange(s.shape[1])
    # different points, up to three: the first, one unlike it, one unlike both
    other = (s != s[0]) | (c != c[0])
    second = other.argmax(0)
    third = (other & ((s != s[second, each]) | (c != c[second, each]))).any(0)
    label, kinds = np.zeros(s.shape, int), 1 + other.any(0) + third
    for k in (2, 3):
        if (kinds == k).any():
            label[:, kinds == k] = kmeans_each(s[:, kinds == k], c[:, kinds == k], k)
    ds, dc = s - s.mean(0), c - c.mean(0)
    flat = (np.ptp(s, axis=0) <= 1e-12) | (np.ptp(c, axis=0) <= 1e-12)
    square = np.sqrt((ds * ds).sum(0)) * np.sqrt((dc * dc).sum(0))
    r = np.where(flat, 0.0, np.clip((ds * dc).sum(0) / np.where(flat, 1.0, square), -1, 1))
    p95 = [np.percentile(v, 95, axis=0) for v in (s, c)]
    parts = []
    for k in range(3):
        own = label == k
        n = own.sum(0)
        p = np.flatnonzero(n)
        mean = [np.where(own, v, 0.0).sum(0)[p] / n[p] for v in (s, c)]
        top = [np.where(own, v, -np.inf).max(0)[p] for v in (s, c)]
        name = np.select([mean[0] + mean[1] < 0.1, mean[0] > 1.5 * mean[1], mean[1] > 1.5 * mean[0]], [2, 3, 0], 1)
        parts.append(np.stack([p, mean[0] + mean[1], name, n[p], mean[0], top[0], mean[1], top[1]]))
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]  # by project, then by mean overrun; ties by what follows
    p = rows[0].astype(int)
    first = np.flatnonzero(np.r_[True, np.diff(p) != 0])
    cluster = np.arange(len(p)) - np.repeat(first, np.diff(np.r_[first, len(p)]))
    found = {"p": p, "cluster": cluster, "label": NAMES[rows[2].astype(int)], "n": rows[3].astype(int), "schedule_mean": rows[4], "schedule_max": rows[5], "cost_mean": rows[6], "cost_max": rows[7]}
    return pd.DataFrame(found | {"correlation": r[p], "schedule_p95": p95[0][p], "cost_p95": p95[1][p]})


def overrun_groups(x: np.ndarray) -> list[tuple]:
    """Rows of joint_overruns for one project's overruns (samples, 2)."""
    return list(overruns(x[:, :1], x[:, 1:]).drop(columns="p").itertuples(index=False, name=None))
