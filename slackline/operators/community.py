"""Communities of each project's network: Louvain, their modularity, density and boundary."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.plans.grouped import graph_apply


def louvain(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, part: np.ndarray, gamma: float = 1.0, most: int = 20) -> np.ndarray:
    """Community of each of n nodes; part says which network a node is of, and networks don't mix.

    Nodes move in order to the neighbouring community of largest gain (ties: smallest number) until none
    gains; then communities become nodes, until nothing changes. Deterministic.
    """
    label = np.arange(n)
    total = np.maximum(np.bincount(part[a], w, int(part.max()) + 1 if n else 0), 1e-12)
    while True:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        loop = np.zeros(n)
        for x, y, v in zip(a.tolist(), b.tolist(), w.tolist()):
            if x == y:
                loop[x] += v
            else:
                near[x][y] = near[x].get(y, 0.0) + v
                near[y][x] = near[y].get(x, 0.0) + v
        degree = np.array([sum(d.values()) for d in near]) + 2 * loop
        own, weight, moved = list(range(n)), degree.copy(), False
        m2 = 2 * total[part]
        for _ in range(most):
            changed = False
            for x in range(n):
                if not near[x]:
                    continue
                to: dict[int, float] = {own[x]: 0.0}
                for y, v in near[x].items():
                    to[own[y]] = to.get(own[y], 0.0) + v
                weight[own[x]] -= degree[x]
                best = max(to, key=lambda c: (round(to[c] - gamma * weight[c] * degree[x] / m2[x], 12), c == own[x], -c))
                weight[best] += degree[x]
                if best != own[x]:
                    own[x], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            return label
        names, new = np.unique(np.array(own), return_inverse=True)
        label = new[label]
        part = part[names] if len(names) else part
        a, b, n = new[a], new[b], len(names)


def communities(acts: DataFrame, links: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(project_id, id, community): numbered within the project by first activity."""

    def kernel(a, e):
        p = a.p.to_numpy()
        pair = pd.DataFrame({"a": np.minimum(e.src, e.dst), "b": np.maximum(e.src, e.dst)}).drop_duplicates().to_numpy(int)
        label = louvain(len(a), pair[:, 0], pair[:, 1], np.ones(len(pair)), p, gamma)
        first = pd.Series(np.arange(len(a))).groupby(label).transform("min").to_numpy()
        number = pd.Series(first).groupby(p).rank(method="dense").to_numpy(int) - 1
        return a.assign(community=number)

    return graph_apply(acts, links, kernel, "project_id long, id string, community int", ["seq"])


def metrics(members: DataFrame, links: DataFrame) -> DataFrame:
    """Size, inner and boundary links, and density of each community. members: project_id, id, community."""
    side = lambda name: members.select("project_id", F.col("id").alias(name), F.col("community").alias(f"c_{name}"))
    pairs = links.select("project_id", "source", "target").dropDuplicates()
    both = pairs.join(side("source"), ["project_id", "source"]).join(side("target"), ["project_id", "target"])
    ends = both.select("project_id", F.explode(F.array_distinct(F.array("c_source", "c_target"))).alias("community"), (F.col("c_source") == F.col("c_target")).alias("inner"))
    n = members.groupBy("project_id", "community").agg(F.count("*").alias("size"))
    e = ends.groupBy("project_id", "community").agg(F.count_if("inner").alias("inner_links"), F.count_if(~F.col("inner")).alias("boundary_links"))
    rows = n.join(e, ["project_id", "community"], "left").fillna(0, ["inner_links", "boundary_links"])
    return rows.withColumn("density", F.when(F.col("size") > 1, 2 * F.col("inner_links") / (F.col("size") * (F.col("size") - 1))).otherwise(0.0))


def modularity(members: DataFrame, links: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Modularity of each project's partition."""
    both = links.select("project_id", "source", "target").dropDuplicates()
    m = both.groupBy("project_id").agg(F.count("*").alias("m"))
    ends = both.select("project_id", F.explode(F.array("source", "target")).alias("id")).join(members, ["project_id", "id"])
    degree = ends.groupBy("project_id", "community").agg(F.count("*").alias("d"))
    inner = metrics(members, links).select("project_id", "community", "inner_links")
    rows = degree.join(inner, ["project_id", "community"]).join(m, "project_id")
    return rows.groupBy("project_id").agg(F.sum(F.col("inner_links") / F.col("m") - gamma * F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def coupling(members: DataFrame, links: DataFrame) -> DataFrame:
    """Share of an activity's community that it is directly linked with, to 4 places."""
    pairs = links.select("project_id", F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))).alias("p")).select("project_id", "p.*").dropDuplicates()
    c = members.select("project_id", F.col("id").alias("other"), F.col("community").alias("oc"))
    near = pairs.join(c, ["project_id", "other"]).groupBy("project_id", "id", F.col("oc").alias("community")).agg(F.count("*").alias("k"))
    size = members.groupBy("project_id", "community").agg(F.count("*").alias("size"))
    rows = members.join(size, ["project_id", "community"]).join(near, ["project_id", "id", "community"], "left")
    return rows.select("project_id", "id", F.round(F.when(F.col("size") > 1, F.coalesce("k", F.lit(0)) / (F.col("size") - 1)).otherwise(0.0), 4).alias("coupling"))


LADDER = (0.3, 1.0, 2.5, 4.0)


def agreement(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised mutual information of two partitions, for each project (1 where both are one group)."""
    n = np.bincount(p).astype(float)

    def entropy(*keys):
        g = pd.DataFrame(dict(enumerate(keys))).assign(p=p).groupby(["p", *range(len(keys))]).size().reset_index(name="k")
        q = g.k / n[g.p]
        return np.bincount(g.p, -q * np.log(q), len(n))

    ha, hb = entropy(a), entropy(b)
    mutual = ha + hb - entropy(a, b)
    return np.where(ha + hb > 1e-12, 2 * mutual / np.maximum(ha + hb, 1e-12), 1.0)


def typical(p: np.ndarray, pair: np.ndarray, gamma: float, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """(community of each node, stability of each network) of the most typical of several runs; p: number of each node's network, nodes of a
    network stand together. A run's order of a network's nodes comes from the run's number and the network's size alone."""
    n, size = len(p), np.bincount(p)
    first = np.cumsum(size) - size
    found = []
    for r in range(runs):
        order = np.arange(n)
        if r:
            turn = {m: np.random.default_rng(r).permutation(m) for m in np.unique(size).tolist()}
            order = np.concatenate([f + turn[m] for f, m in zip(first.tolist(), size.tolist())])
        place = np.empty(n, int)
        place[order] = np.arange(n)
        found.append(louvain(n, place[pair[:, 0]], place[pair[:, 1]], np.ones(len(pair)), p[order], gamma)[place])
    mean = np.stack([np.mean([agreement(p, x, y) for j, y in enumerate(found) if j != i] or [np.ones(len(size))], axis=0) for i, x in enumerate(found)])
    best = mean.round(12).argmax(0)
    label = np.choose(best[p], found)
    begin = pd.DataFrame({"p": p, "c": label, "i": np.arange(n)}).groupby(["p", "c"]).i.transform("min").to_numpy()
    return pd.Series(begin).groupby(p).rank(method="dense").to_numpy(int) - 1, mean.max(0)


def alike(p: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, bytes]]]:
    """(first network that is the same, for each network; what these first ones are by their numbers: size and links). Networks are the same
    if they have as many nodes and the same links between them, by place. pair holds links of nodes, each once."""
    size = np.bincount(p)
    first = np.cumsum(size) - size
    of = p[pair[:, 0]]
    code = (pair[:, 0] - first[of]) * size[of] + pair[:, 1] - first[of]
    order = np.lexsort((code, of))
    code, cut = code[order], np.searchsorted(of[order], np.arange(len(size) + 1)).tolist()
    seen: dict = {}
    same = np.array([seen.setdefault((m, code[cut[i] : cut[i + 1]].tobytes()), i) for i, m in enumerate(size.tolist())])
    return same, {i: key for key, i in seen.items()}


#: Activities of networks whose communities a task remembers.
REMEMBERED = 500_000


def multi_resolution(acts: DataFrame, links: DataFrame, ladder: tuple[float, ...] | None = None, runs: int = 3) -> DataFrame:
    """(project_id, resolution, stability, id, community): at each resolution the most typical of several runs.

    Runs differ in the order in which nodes move (from a seed); the one whose mean agreement with the others is
    largest stays (ties: the first). Without a ladder, projects below 500 activities take its first two steps. A project's result
    depends on its own network alone, so a network that a task has many times is run once.
    """
    known: dict[tuple[int, tuple[int, bytes]], tuple[np.ndarray, float]] = {}

    def kernel(a, e):
        p = a.p.to_numpy()
        size = np.bincount(p)
        first = np.cumsum(size) - size
        pair = pd.DataFrame({"a": np.minimum(e.src, e.dst), "b": np.maximum(e.src, e.dst)}).drop_duplicates().to_numpy(int)
        same, what = alike(p, pair)
        if sum(len(label) for label, _ in known.values()) > REMEMBERED:
            known.clear()
        for step, gamma in enumerate(ladder or LADDER):
            asked = np.ones(len(size), bool) if ladder or step < 2 else size >= 500
            own = np.unique(same[asked])
            new = [i for i in own.tolist() if (step, what[i]) not in known]
            if new:
                codes = [np.frombuffer(what[i][1], int) for i in new]
                m = size[new]
                begin = np.repeat(np.cumsum(m) - m, [len(c) for c in codes])
                x, y = np.divmod(np.concatenate(codes), np.repeat(m, [len(c) for c in codes]))
                label, stability = typical(np.repeat(np.arange(len(new)), m), np.stack([x + begin, y + begin], axis=1), gamma, runs)
                known.update({(step, what[i]): (part, float(v)) for i, part, v in zip(new, np.split(label, np.cumsum(m)[:-1]), stability)})
            if len(own):
                found = [known[step, what[i]] for i in own.tolist()]
                label, begin = np.concatenate([x for x, _ in found]), np.cumsum(size[own]) - size[own]
                rows = np.flatnonzero(asked[p])
                which = np.searchsorted(own, same[p[rows]])
                stable = np.array([v for _, v in found])[which]
                yield pd.DataFrame({"project_id": a.project_id.to_numpy()[rows], "resolution": gamma, "stability": stable, "id": a.id.to_numpy()[rows], "community": label[begin[which] + rows - first[p[rows]]]})

    return graph_apply(acts, links, kernel, "project_id long, resolution double, stability double, id string, community int", ["seq"])


def hierarchy(coarse: DataFrame, fine: DataFrame, least: float = 0.7) -> DataFrame:
    """Which coarse community holds at least that share of each fine one. Both: project_id, id, community."""
    both = fine.select("project_id", "id", F.col("community").alias("child")).join(coarse.select("project_id", "id", F.col("community").alias("parent")), ["project_id", "id"])
    k = both.groupBy("project_id", "child", "parent").agg(F.count("*").alias("k"))
    n = k.groupBy("project_id", "child").agg(F.sum("k").alias("n"))
    rows = k.join(n, ["project_id", "child"]).withColumn("overlap", F.col("k") / F.col("n"))
    return rows.where(F.col("overlap") >= least).select("project_id", "parent", "child", F.bround("overlap", 3).alias("overlap"))


def stable_cores(finest: DataFrame, coarser: list[DataFrame]) -> DataFrame:
    """(project_id, community, id): finest communities of two or more that every coarser level keeps together."""
    rows = finest.select("project_id", "id", "community")
    checks = [F.count("*") >= 2]
    for i, level in enumerate(coarser):
        rows = rows.join(level.select("project_id", "id", F.col("community").alias(f"c{i}")), ["project_id", "id"])
        checks.append((F.min(f"c{i}") == F.max(f"c{i}")))
    keep = checks[0]
    for c in checks[1:]:
        keep = keep & c
    cores = rows.groupBy("project_id", "community").agg(keep.alias("keep")).where("keep").drop("keep")
    return finest.join(cores, ["project_id", "community"], "left_semi").select("project_id", "community", "id")
