"""Euclidean p-stable hashing: near-duplicate vectors and multiprobe nearest-neighbour search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._hashing import mixed
from ._shared import aligned, block_pairs, dropped, numpy_of, persisted, run_bounds, shuffle_partitions, write_path
from .components import components


def usable(vec: Column) -> Column:
    """Not null, not empty, all components present and finite, not the zero vector."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(col) -> np.ndarray:
    """A list column of equally long vectors as a double matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    flat = numpy_of(col.flatten()).astype(np.float64)
    return flat.reshape(len(col), -1)


def collision(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection agrees for points at that distance."""
    s = width / distance
    phi = 0.5 * math.erfc(s / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * s) * (1 - math.exp(-s * s / 2))


@dataclass(frozen=True)
class Tables:
    """Projections and offsets of several hash tables; drawn from the seed, so every task has the same."""

    dim: int
    projections: int
    tables: int
    width: float
    seed: int = 7

    def draw(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(self.dim, self.tables * self.projections)), rng.uniform(0, self.width, self.tables * self.projections)

    def slots(self, x: np.ndarray, drawn: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Real-valued slot positions, (rows, tables, projections)."""
        return ((x @ drawn[0] + drawn[1]) / self.width).reshape(len(x), self.tables, self.projections)


def keys_of(slots: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and table from whole-numbered slots."""
    h = np.zeros(slots.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(slots.shape[2]):
            h = mixed(h * np.uint64(31) + slots[:, :, k].astype(np.int64).view(np.uint64) + np.uint64(k + 1))
    return h.view(np.int64)


def plan_tables(rows: int, dim: int, cosine: float, recall: float = 0.95, width: float = 2.0, per_bucket: int = 512) -> Tables:
    """As many projections as leave about per_bucket unrelated vectors of a table in a bucket, and as
    many tables as find a pair just at the threshold with chance recall (closer pairs: more often)."""
    far, near = collision(math.sqrt(2), width), collision(math.sqrt(2 - 2 * cosine), width)
    k = max(2, math.ceil(math.log(max(rows, 1) / per_bucket) / -math.log(far))) if rows > per_bucket else 2
    return Tables(dim, k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k)))), width)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, recall: float = 0.95, block_rows: int = 1024) -> DataFrame:
    """Links of vectors with cosine >= cosine: (vec_id, n_links, component_id, kept), one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    so do rows without an id (their component is null). Vectors of another length than most others'
    are compared among their own length. Rows that repeat an id are vectors of their own. Ties in the
    component's smallest id don't arise. An empty table gives no rows; columns other than
    the two named ones are not read.

    Equal vectors are grouped first (a partial aggregate), so copies never meet in a bucket. The rest
    are hashed; a pair is counted in the first table where it collides, which a task tells from both rows' 64-bit keys,
    made anew from the vectors (a product with the projections costs less than keys that travel), so nothing is joined
    to remove repeats. Buckets of any size are dealt out as pairs of blocks, and
    a task emits link counts and a spanning forest, never all pairs.
    """
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e"))
    good = usable(F.col("e")) & F.col("vec_id").isNotNull()
    groups = persisted(base.where(good).groupBy("e").agg(F.min("vec_id").alias("gid"), F.count("*").alias("mult")), "vectors")
    dims = [(r["d"], r["n"]) for r in groups.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).collect()]
    found = None
    for dim, rows in dims:
        part = _pairs(groups.where(F.size("e") == dim), plan_tables(rows, dim, cosine, recall), cosine, block_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = persisted(found, "vector-links")
    comps = components(found.where("b is not null"), "a", "b")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labelled = groups.join(counts, F.col("gid") == F.col("node"), "left").drop("node").join(comps, F.col("gid") == F.col("node"), "left")
    labelled = labelled.select(F.col("e").alias("ge"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).cast("long").alias("links"), F.coalesce("component", "gid").alias("comp"))
    out = base.where(good).join(labelled, F.col("e") == F.col("ge")).select("vec_id", F.col("links").alias("n_links"), F.col("comp").alias("component_id"))
    alone = base.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _pairs(groups: DataFrame, plan: Tables, cosine: float, block_rows: int) -> DataFrame:
    """Rows (a, null, n): n linked vectors of a; and (a, b, 0): edges of a spanning forest."""

    def hashed(batches, full: bool):
        drawn = plan.draw()
        for b in batches:
            x = matrix(b.column("e"))
            x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            keys = keys_of(np.floor(plan.slots(x, drawn)))
            n, t = keys.shape
            table = pa.array(np.tile(np.arange(t, dtype=np.int32), n))
            if not full:
                yield pa.RecordBatch.from_arrays([table, pa.array(keys.ravel())], names=["t", "bucket"])
                continue
            for at in range(0, n, 512):
                rows = pa.array(np.repeat(np.arange(at, min(n, at + 512)), t))
                cut = slice(at * t, min(n, at + 512) * t)
                cols = [b.column("gid").take(rows), b.column("mult").take(rows), b.column("e").take(rows), table[cut], pa.array(keys.ravel()[cut])]
                yield pa.RecordBatch.from_arrays(cols, names=["gid", "mult", "e", "t", "bucket"])

    large = groups.select("e").mapInArrow(lambda it: hashed(it, False), "t int, bucket long").groupBy("t", "bucket").count().where(F.col("count") > block_rows)
    large = persisted(large, "large-buckets")
    kind = dict(groups.dtypes)["e"]
    rows = groups.mapInArrow(lambda it: hashed(it, True), f"gid long, mult long, e {kind}, t int, bucket long")
    rows = block_pairs(rows.join(large, ["t", "bucket"], "left").withColumn("count", F.coalesce("count", F.lit(1))), F.col("count"), block_rows, F.col("gid"))
    keys = ["t", "bucket", "blk_i", "blk_j"]
    rows = rows.drop("count").repartition(shuffle_partitions(groups.sparkSession), *keys).sortWithinPartitions(*keys, "side")
    return rows.mapInArrow(lambda it: _linked(it, keys, cosine, plan), "a long, b long, n long")


def _linked(batches, keys: list[str], cosine: float, plan: Tables) -> Iterator[pa.RecordBatch]:
    drawn = plan.draw()
    for chunk in aligned(batches, keys, 8192):
        key = [numpy_of(chunk[k]) for k in keys]
        gid, mult, side, table = numpy_of(chunk["gid"]), numpy_of(chunk["mult"]), numpy_of(chunk["side"]), key[0]
        x = matrix(chunk["e"])
        x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        sig = np.concatenate([keys_of(np.floor(plan.slots(x[i : i + 4096], drawn))) for i in range(0, len(x), 4096)])
        links = np.zeros(len(x), np.int64)
        edges: list[np.ndarray] = []
        bounds = run_bounds(*key)
        sizes = np.diff(bounds)
        tiny = (sizes > 1) & (sizes <= 64) & (key[2][bounds[:-1]] == key[3][bounds[:-1]])
        for i, j in _enumerated(bounds[:-1][tiny], sizes[tiny]):
            near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[near], j[near]
            seen = np.zeros(len(i), bool)
            for t in range(int(table.max())):
                seen |= (sig[i, t] == sig[j, t]) & (t < table[i])
            i, j = i[~seen], j[~seen]
            np.add.at(links, i, mult[j])
            np.add.at(links, j, mult[i])
            edges.append(np.stack([gid[i], gid[j]]))
        for g in np.flatnonzero((sizes > 1) & ~tiny):
            s, e = bounds[g], bounds[g + 1]
            if key[2][s] == key[3][s]:
                left = right = np.arange(s, e)
            else:
                cut = s + int((side[s:e] == 0).sum())
                left, right = np.arange(s, cut), np.arange(cut, e)
            if not len(left) or not len(right):
                continue
            near = x[left] @ x[right].T >= cosine
            if left is right:
                np.fill_diagonal(near, False)
            for t in range(int(table[s])):
                if not near.any():
                    break
                near &= sig[left, t][:, None] != sig[right, t][None]
            links[left] += near @ mult[right]
            if left is not right:
                links[right] += near.T @ mult[left]
            edges.append(_forest(near, gid[left], gid[right]))
        some = np.flatnonzero(links)
        yield _batch(gid[some], None, links[some])
        if edges:
            ab = np.concatenate(edges, axis=1)
            yield _batch(ab[0], ab[1], np.zeros(ab.shape[1], np.int64))


def _batch(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def _enumerated(starts: np.ndarray, sizes: np.ndarray, at_once: int = 200_000):
    """Pairs of rows of one run, run by run, about at_once together."""
    pairs = sizes * (sizes - 1) // 2
    for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(np.cumsum(pairs) // at_once)) + 1):
        left, right = [], []
        for size in np.unique(sizes[part]):
            i, j = np.triu_indices(size, 1)
            at = starts[part][sizes[part] == size]
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
        if left:
            yield np.concatenate(left), np.concatenate(right)


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A spanning forest of the bipartite (or symmetric) adjacency, breadth first, each row once."""
    edges, todo = [], near.any(1)
    while todo.any():
        root = int(np.flatnonzero(todo)[0])
        rows, cols = np.zeros(len(left), bool), np.zeros(len(right), bool)
        front = np.zeros(len(left), bool)
        front[root] = True
        while front.any():
            rows |= front
            reach = near[front].any(0) & ~cols
            cols |= reach
            front = near[:, reach].any(1) & ~rows if reach.any() else np.zeros(len(left), bool)
        for mine, ids in ((rows, left), (cols, right)):
            other = ids[mine]
            edges.append(np.stack([np.full(len(other), left[root]), other]))
        todo &= ~rows
    out = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
    return out[:, out[0] != out[1]]


@dataclass(frozen=True)
class SearchPlan:
    """visit: the share of all rows in the buckets that a query visits in each table. Vectors without
    near neighbours (as good as isotropic ones) need a large share; clustered ones a small one.
    query_rows: queries broadcast at once. step, least: see nearest()."""

    projections: int = 8
    tables: int = 2
    width: float = 2.5
    visit: float = 0.65
    query_rows: int = 8192
    step: int = 8
    least: int = 16384


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", plan: SearchPlan | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest inner product found, in double precision.

    A query's own id is no candidate; ties go to the smaller vec_id; with fewer than k candidates
    all come. Vectors that are null, empty, zero or hold null or non-finite components, rows without
    an id, and vectors of another length than the queries' most frequent one take no part. Rows or queries
    that repeat an id count once with their best score. No usable query or row: no rows. Only the two named columns are read.

    Inner products become distances by one more component, which fills every row up to the largest norm. The
    directory of buckets with their counts is bounded by the lattice (slots to the power of
    projections), not by the rows. A query ranks all buckets by the squared distance of its
    projections to their slots (the likelier, the nearer) and visits the first of them until they
    hold the wanted share of the rows. A product is taken only of a query and the rows of a bucket that it visits.

    No row is shuffled. Queries are broadcast in blocks of bounded size, and each task keeps the k best of its own
    rows for each. A ladder of samples (a step-th of the rows of the next one, down to about `least` rows)
    goes first: the k-th best score in a sample bounds it from below for all rows, so a task hands on about
    k * step hits of a query in all, whatever the number of tasks, and no row that belongs to the result goes lost.
    """
    plan = plan or SearchPlan()
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).where(usable(F.col("e")) & F.col("vec_id").isNotNull())
    rows, asked = pick(vectors), persisted(pick(queries), "search-queries")
    kinds = asked.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not kinds:
        return spark.createDataFrame([], schema)
    dim = kinds[0]["d"]
    rows, asked = persisted(rows.where(F.size("e") == dim), "search-rows"), asked.where(F.size("e") == dim)
    double = lambda v: v.cast("double")
    found = rows.agg(F.max(F.aggregate("e", F.lit(0.0), lambda a, v: a + double(v) * double(v))).alias("top"), F.count("*").alias("n")).first()
    if not found["n"]:
        return spark.createDataFrame([], schema)
    lattice = Lattice(Tables(dim + 1, plan.projections, plan.tables, plan.width), found["top"])
    cells = rows.select("e").mapInArrow(lambda it: _cells(it, lattice), "t int, code binary, n long").groupBy("t", "code").agg(F.sum("n").alias("n")).orderBy("t", "code").toPandas()
    codes = [np.frombuffer(b"".join(bytes(c) for c in cells.code[cells.t == t]), np.int16).reshape(-1, plan.projections) for t in range(plan.tables)]
    index = (codes, [cells.n[cells.t == t].to_numpy() for t in range(plan.tables)])
    ladder = [1]
    while found["n"] / ladder[0] > plan.least * plan.step:
        ladder.insert(0, ladder[0] * plan.step)
    blocks = max(1, math.ceil(asked.count() / plan.query_rows))
    path = write_path(spark, "search-hits")
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)) == block).select("vec_id", "e").toPandas()
        if not len(own):
            continue
        q = np.array(own.e.tolist(), np.float64)
        ids, of = np.unique(own.vec_id.to_numpy(), return_inverse=True)  # rows that repeat a query's id are one query
        bound = np.full(len(ids), -np.inf)
        for share in ladder:
            shared = spark.sparkContext.broadcast((ids, of, q, bound, lattice, index))
            some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(share)) == 0) if share > 1 else rows
            hits = some.mapInArrow(lambda it, shared=shared: _searched(it, shared.value, plan, k), "place int, vec_id long, score double")
            hits = hits.groupBy("place", "vec_id").agg(F.max("score").alias("score"))
            best = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
            hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            if share > 1:
                edge = hits.where(F.col("rank") == k).select("place", "score").toPandas()
                bound = np.full(len(ids), -np.inf)
                bound[edge.place.to_numpy()] = edge.score.to_numpy()
                shared.unpersist()
        named = spark.createDataFrame(pd.DataFrame({"place": np.arange(len(ids), dtype=np.int32), "query_id": ids}))
        hits.join(F.broadcast(named), "place").select("query_id", "rank", "vec_id", "score").write.parquet(f"{path}/block={block}")  # query_rows rows
        shared.unpersist()
    dropped(rows, asked)
    return spark.read.schema(f"{schema}, block int").parquet(path).drop("block")


class Lattice:
    """The bucket codes of rows and the slot positions of queries, lifted so that inner products become distances."""

    def __init__(self, tables: Tables, top: float):
        self.tables, self.top, self.norm, self.drawn = tables, top, math.sqrt(top), None

    def slots(self, x: np.ndarray, query: bool) -> np.ndarray:
        if self.drawn is None:
            a, off = self.tables.draw()
            k = self.tables.projections
            for t in range(self.tables.tables):  # orthogonal directions tell more than independent ones
                if k <= len(a):
                    a[:, t * k : (t + 1) * k] = np.linalg.qr(a[:, t * k : (t + 1) * k])[0] * math.sqrt(len(a) - 1)
            self.drawn = a, off
        own = np.einsum("ij,ij->i", x, x)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - own / self.top))
        scale = np.sqrt(own)[:, None] if query else self.norm
        return self.tables.slots(np.concatenate([x / scale, last[:, None]], axis=1), self.drawn)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.floor(self.slots(x, False)).astype(np.int16)


def _cells(batches, lattice: Lattice) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        s = lattice.codes(matrix(b.column("e")))
        for t in range(s.shape[1]):
            codes, n = np.unique(s[:, t], axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(n)], names=["t", "code", "n"])


def _visits(q: np.ndarray, lattice: Lattice, index, visit: float) -> list[np.ndarray]:
    """For each table (queries, buckets): whether the query visits the bucket."""
    codes, counts = index
    at = lattice.slots(q, True)
    out = []
    for t, code in enumerate(codes):
        seen = np.zeros((len(q), len(code)), bool)
        for first in range(0, len(q), 256):
            score = _bucket_scores(code.astype(np.float64), at[first : first + 256, t])
            order = np.argsort(score, axis=1, kind="stable")
            before = np.cumsum(counts[t][order], axis=1) - counts[t][order]
            np.put_along_axis(seen[first : first + 256], order, before < visit * counts[t].sum(), axis=1)
        out.append(seen)
    return out


def _searched(batches, shared, plan: SearchPlan, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's k best of one task's rows that reach its bound, (place of the query, vec_id, score).

    Rows come in growing chunks, so that what a chunk adds to the best of all before stays small."""
    ids, of, q, bound, lattice, index = shared
    ids, bound = ids[of], bound[of]
    visits = lookup = None
    best_s, best_i = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
    size = 64
    for b in batches:
        lo = 0
        while lo < b.num_rows:
            part = b.slice(lo, size)
            lo, size = lo + size, min(2 * size, 4096)
            if visits is None:
                visits = _visits(q, lattice, index, plan.visit)
                lookup = [{c.tobytes(): i for i, c in enumerate(cs)} for cs in index[0]]
            x, own = matrix(part.column("e")), numpy_of(part.column("vec_id"))
            code = lattice.codes(x)
            cell = [np.array([lookup[t][c.tobytes()] for c in code[:, t]], np.int64) for t in range(len(lookup))]
            edge = np.maximum(bound, best_s[:, -1])
            got = []
            for t, at in enumerate(cell):
                order = np.argsort(at, kind="stable")
                for g in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    who = np.flatnonzero(visits[t][:, at[g[0]]])
                    score = q[who] @ x[g].T
                    hit = score >= edge[who, None] - 1e-9
                    for earlier in range(t):  # a pair counts in the first table that visits it
                        hit &= ~visits[earlier][np.ix_(who, cell[earlier][g])]
                    i, j = np.nonzero(hit)
                    got.append((who[i], g[j]))
            who, what = (np.concatenate(c) for c in zip(*got))
            other = ids[who] != own[what]
            who, what = who[other], what[other]
            # scores anew in one fixed order of sums
            exact = np.concatenate([np.einsum("ij,ij->i", q[who[i : i + 65536]], x[what[i : i + 65536]]) for i in range(0, len(who), 65536)] or [np.zeros(0)])
            _merge(best_s, best_i, who, own[what], exact, k)
    place, rank = np.nonzero(np.isfinite(best_s) & (best_s >= bound[:, None] - 1e-9))
    yield pa.RecordBatch.from_arrays([pa.array(of[place].astype(np.int32)), pa.array(best_i[place, rank]), pa.array(best_s[place, rank])], names=["place", "vec_id", "score"])


def _merge(best_s: np.ndarray, best_i: np.ndarray, who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> None:
    """Put hits among the k best of their queries; an id counts once, with its best score."""
    touched = np.unique(who)
    old = np.repeat(touched, k)
    s, i = np.concatenate([score, best_s[touched].ravel()]), np.concatenate([ids, best_i[touched].ravel()])
    w = np.concatenate([who, old])
    use = np.isfinite(s)
    w, i, s = w[use], i[use], s[use]
    order = np.lexsort((-s, i, w))
    w, i, s = w[order], i[order], s[order]
    new = np.append(True, (w[1:] != w[:-1]) | (i[1:] != i[:-1]))[: len(w)]
    w, i, s = w[new], i[new], s[new]
    order = np.lexsort((i, -s, w))
    w, i, s = w[order], i[order], s[order]
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1])[: len(w)])
    rank = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
    keep = rank < k
    best_s[w[keep], rank[keep]], best_i[w[keep], rank[keep]] = s[keep], i[keep]


def _bucket_scores(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distance from each query's projections to each bucket's slots, in slots."""
    out = np.zeros((len(at), len(codes)))
    for j in range(codes.shape[1]):
        low = codes[None, :, j] - at[:, j, None]
        out += np.maximum(0, np.maximum(low, -low - 1)) ** 2
    return out
