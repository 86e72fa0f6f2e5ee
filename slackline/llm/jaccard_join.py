"""Exact Jaccard join of shingle sets with adaptive multi-match prefixes.

A set's tokens are ordered by one order for all sets, rare ones first. If two sets reach the threshold,
their prefixes lengthened by m - 1 tokens share at least m tokens, for every m. Each document picks
its m by estimated cost: a longer prefix reads more postings, but demands more shared
tokens and so leaves fewer candidates to verify, which matters the more the longer the document is.
A pair's m is the smaller one of its two documents.

The order needs frequencies, not exact ones: any order is correct. They come from one row of a
count-min sketch of fixed size over all tokens of all documents.

A shared token also tells by its places in the two orders how much can follow it. Of a pair that
reaches the threshold, each of the first m shared tokens leaves room enough for the rest, so a
token that doesn't is no evidence for its pair, and pairs are emitted only where it does.

What is wanted is classes of linked documents. A node is a distinct set, named by a 64-bit key of it, so
neither copies nor rows that repeat a doc_id matter until the end, when ids join their nodes. Candidates are
verified in two steps: first one best partner for each document (tried first: the one in whose
order the shared token stands nearest to the front, as it has the fewest tokens of its own), by which large groups of near copies become one class with as many checks as members; then every candidate pair that
is not yet in one class. So no link between different classes is missed, and the pairs within a class are
never listed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import WordHasher, mixed, shingle_sets
from ._shared import aligned, binaries, block_pairs, broadcast_if_small, dropped, numpy_of, persisted, run_bounds, shuffle_partitions, sliced, small_batches
from .components import components


@dataclass(frozen=True)
class JoinPlan:
    """percent: least 100 * intersection / union. cells: counters of the sketch (a power of two).
    most: matches a prefix demands at most. verify_cost: postings read in the time that one
    token of a verified pair costs. block_rows: documents of one block of a frequent token."""

    width: int = 5
    percent: int = 80
    cells: int = 1 << 20
    parts: int = 64
    most: int = 4
    verify_cost: float = 0.2
    block_rows: int = 512
    star_rows: int = 64


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n must share with any set that reaches the threshold."""
    return -(-percent * n // 100)


def prefix_of(tokens: np.ndarray, sketch: np.ndarray, floor: float, plan: JoinPlan) -> tuple[np.ndarray, int]:
    """(tokens of the prefix in order, the document's m)."""
    n = len(tokens)
    need = least_overlap(n, plan.percent)
    base = n - need + 1
    most = min(plan.most, need)
    count = sketch[(tokens & np.uint64(len(sketch) - 1)).astype(np.int64)]
    order = np.lexsort((tokens, count))[: base + most - 1]
    lists = np.cumsum(np.maximum(count[order] - floor, 0.0))
    m = np.arange(1, most + 1)
    read = lists[base - 1 : base + most - 1]
    cost = read + plan.verify_cost * n * read / m  # at most read / m documents share m of the tokens
    own = int(np.argmin(cost)) + 1
    return tokens[order[: base + own - 1]], own


def level_of(pos: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """The m from which on a place in the order belongs to the prefix."""
    return np.maximum(1, pos - (n - -(-percent * n // 100)) + 1)


def admissible(n: np.ndarray, pos: np.ndarray, m: np.ndarray, n2: np.ndarray, pos2: np.ndarray, m2: np.ndarray, percent: int) -> np.ndarray:
    """Whether a shared token at these places can be one of the first m of a pair that reaches the threshold."""
    need = -(-percent * (n + n2) // (100 + percent))
    least = np.minimum(m, m2)
    ok = least + np.minimum(n - pos, n2 - pos2) - 1 >= need
    return ok & (np.maximum(level_of(pos, n, percent), level_of(pos2, n2, percent)) <= least)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


@dataclass
class TextLinks:
    """What links() finds. sets: (doc, n, node) of every row; nodes: (node, first, docs) with the smallest
    doc_id and the number of doc_ids of a set; edges: (a, b), enough links to connect every class of sets."""

    sets: DataFrame
    nodes: DataFrame
    edges: DataFrame
    clash: list[int]


def jaccard_classes(docs: DataFrame, plan: JoinPlan | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs.

    Words are split at ASCII blanks with A-Z lower-cased; a text of fewer words than width is one
    shingle; a null text or one without words has none and links with nothing. Texts are whole,
    however long. component_id is the smallest doc_id reachable by links. A null doc_id links with
    nothing and has a null component. Rows that repeat a doc_id are one document with the links of all its
    texts, also where these differ. Pairs exactly at the threshold link. An empty table gives no rows. Only the
    two named columns are read. Tokens are 64-bit hashes: two sets are miscounted only if a collision falls
    within the pair; sets whose 64-bit keys clash are told apart by a second key.
    """
    found = links(docs, plan, doc_id, text)
    known = found.sets.where("doc is not null and n > 0").select("doc", "node")
    several = known.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("doc", "a")
    same = known.join(several, "doc").where("a != node").select("a", F.col("node").alias("b"))  # one document's texts
    joined = persisted(components(found.edges.unionByName(same)), "jaccard-joined")
    least = found.nodes.join(joined, "node").groupBy("component").agg(F.min("first").alias("least"))
    label = joined.join(least, "component").select("node", F.col("least").alias("component_id"))
    label = label.unionByName(found.nodes.where("docs > 1").join(joined, "node", "left_anti").select("node", F.col("first").alias("component_id")))
    label = persisted(label, "jaccard-labels")
    hollow = found.sets.where("doc is not null and n = 0")  # they belong to their document's other texts
    borrowed = known.join(hollow.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.min("node").alias("node"))
    rows = found.sets.where("doc is null or n > 0").unionByName(hollow.drop("node").join(borrowed, "doc", "left"))
    out = rows.join(broadcast_if_small(label, label.count()), "node", "left")
    own = F.when(F.col("doc").isNotNull(), F.col("component_id"))
    out = persisted(out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce(own, "doc").alias("component_id")), "jaccard-classes")
    dropped(found.sets, found.nodes, found.edges, joined, label)
    return out


def links(docs: DataFrame, plan: JoinPlan | None = None, doc_id: str = "doc_id", text: str = "text") -> TextLinks:
    """The distinct sets of all texts and links that connect every class of them; rows with a null doc_id or
    without a shingle have no node. The tables stay until the caller drops them."""
    plan = plan or JoinPlan()
    spark = docs.sparkSession
    n_parts = shuffle_partitions(spark)
    small_batches(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    seen = persisted(source.mapInArrow(lambda it: _fingerprints(it, plan), "doc long, n int, f1 long, f2 long, part int, counts binary"), "jaccard-seen")
    sets = seen.where("part is null").select("doc", "n", "f1", "f2")
    twice = sets.where("n > 0").groupBy("f1").agg(F.min("f2").alias("lo"), F.max("f2").alias("hi")).where("lo != hi").select("f1")
    clash = [r["f1"] for r in twice.collect()]  # about the square of the sets' number / 2**65
    node = F.col("f1") if not clash else F.when(F.col("f1").isin(clash), F.col("f2")).otherwise(F.col("f1"))
    sets = persisted(sets.select("doc", "n", F.when(F.col("n") > 0, node).alias("node")), "jaccard-sets")
    known = sets.where("doc is not null and n > 0")
    nodes = persisted(known.groupBy("doc", "node").agg(F.lit(1).alias("one")).groupBy("node").agg(F.min("doc").alias("first"), F.count("*").alias("docs")), "jaccard-nodes")
    gone = persisted(known.select("doc").distinct().join(nodes.select(F.col("first").alias("doc")).distinct(), "doc", "left_anti"), "jaccard-gone")
    # what is left holds every set at least once; rows that repeat a set give equal postings, which _distinct drops
    only = source.where("doc is not null").join(broadcast_if_small(gone, gone.count()), "doc", "left_anti")

    shared_sketch = spark.sparkContext.broadcast(_merged(seen, plan))
    shape = "token long, doc long, n int, pos int, m short"
    postings = only.mapInArrow(lambda it: _postings(it, shared_sketch, plan, clash), shape)
    postings = postings.repartition(n_parts, "token").sortWithinPartitions("token", "pos", "doc")
    postings = persisted(postings.mapInArrow(lambda it: _shared_only(_distinct(it)), shape + ", first struct<doc:long,n:int,pos:int,m:short>"), "jaccard-postings")
    dropped(seen)

    stars = postings.select("doc", "n", "pos", "m", "first").mapInArrow(lambda it: _led(it, plan), "doc long, first long").groupBy("doc", "first").agg(F.count("*").alias("c"))
    stars = stars.groupBy("doc").agg(F.max_by("first", F.struct("c", -F.col("first"))).alias("other"))
    stars = persisted(stars.select(F.col("other").alias("a"), F.col("doc").alias("b")), "jaccard-stars")
    linked = persisted(verified(only, stars, nodes, plan, clash), "jaccard-links")
    classes = persisted(components(linked), "jaccard-classes")

    rest = persisted(_across(postings, classes, plan), "jaccard-candidates")
    rest = rest.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = verified(only, rest, nodes, plan, clash)
    edges = persisted(linked.unionByName(more).distinct(), "jaccard-edges")
    dropped(postings, stars, linked, classes, rest, gone)
    return TextLinks(sets, nodes, edges, clash)


def keys_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set of tokens."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    at = np.concatenate([[0], np.cumsum(size)])
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(flat[:-1] ^ np.uint64(salt)))])
            out.append(mixed(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def node_keys(sets: list[np.ndarray], clash: list[int]) -> np.ndarray:
    f1, f2 = keys_of(sets)
    return np.where(np.isin(f1, np.array(clash, np.int64)), f2, f1) if clash else f1


def node_key(plan: JoinPlan, clash: list[int]):
    """A column function from a text to the key of its set (null without words)."""

    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        sets = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in texts], plan.width, WordHasher())
        return pd.Series(node_keys(sets, clash) if sets else [], dtype="Int64").mask([not len(s) for s in sets])

    return key


def _fingerprints(batches, plan: JoinPlan) -> Iterator[pa.RecordBatch]:
    """A row for each document (size and 128-bit fingerprint of its set), and the task's sketch in parts."""
    names = ["doc", "n", "f1", "f2", "part", "counts"]
    hasher, sketch = WordHasher(), np.zeros(plan.cells, np.int64)
    for b in sliced(batches):
        sets = shingle_sets(binaries(b.column("text")), plan.width, hasher)
        size = np.array([len(s) for s in sets], np.int32)
        flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
        sketch += np.bincount((flat[:-1] & np.uint64(plan.cells - 1)).astype(np.int64), minlength=plan.cells)
        prints = keys_of(sets)
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(size), pa.array(prints[0]), pa.array(prints[1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    used = np.array_split(sketch, plan.parts)
    for i, part in enumerate(used):
        if part.any():
            packed = zlib.compress(part.astype("<u4").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([i], pa.int32()), pa.array([packed], pa.binary())], names=names)


def _merged(seen: DataFrame, plan: JoinPlan) -> np.ndarray:
    """The sum of all tasks' sketches, part by part on the executors; cells numbers reach the driver."""

    def total(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("part").to_pylist(), b.column("counts")):
                v = np.frombuffer(zlib.decompress(c.as_py()), "<u4").astype(np.float64)
                held[i] = held[i] + v if i in held else v
        for i, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v.astype("<f4").tobytes()], pa.binary())], names=["part", "counts"])

    rows = seen.where("part is not null").select("part", "counts")
    rows = rows.repartition(min(plan.parts, shuffle_partitions(seen.sparkSession)), "part").mapInArrow(total, "part int, counts binary").collect()
    found = {r["part"]: np.frombuffer(bytes(r["counts"]), "<f4") for r in rows}
    empty = [len(p) for p in np.array_split(np.zeros(plan.cells, np.int8), plan.parts)]
    return np.concatenate([found.get(i, np.zeros(n, np.float32)) for i, n in enumerate(empty)])


def _postings(batches, sketch, plan: JoinPlan, clash: list[int]) -> Iterator[pa.RecordBatch]:
    hasher, counts = WordHasher(), sketch.value
    floor = float(np.median(counts))  # what a cell holds of other tokens
    for b in sliced(batches):
        sets = shingle_sets(binaries(b.column("text")), plan.width, hasher)
        got = [(prefix_of(s, counts, floor, plan), len(s), k) for s, k in zip(sets, node_keys(sets, clash)) if len(s)]
        if not got:
            continue
        size = [len(p[0]) for p, _, _ in got]
        cols = [
            np.concatenate([p[0] for p, _, _ in got]).view(np.int64),
            np.repeat(np.array([d for _, _, d in got], np.int64), size),
            np.repeat(np.array([n for _, n, _ in got], np.int32), size),
            np.concatenate([np.arange(k, dtype=np.int32) for k in size]),
            np.repeat(np.array([p[1] for p, _, _ in got], np.int16), size),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "doc", "n", "pos", "m"])


LEAD = ("doc", "n", "pos", "m")


def _distinct(batches) -> Iterator[pa.RecordBatch]:
    """Sorted postings without those that repeat their token and document."""
    last = (None, None)
    for b in batches:
        if b.num_rows:
            token, doc = numpy_of(b.column("token")), numpy_of(b.column("doc"))
            new = np.append((token[0], doc[0]) != last, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]))
            last = (token[-1], doc[-1])
            yield b.filter(pa.array(new))


def _shared_only(batches) -> Iterator[pa.RecordBatch]:
    """Postings of tokens with two documents or more, with the token's first posting. Rows stream: a
    batch waits for the next one's first token."""
    before, lead, held = None, None, None

    def kept(b: pa.RecordBatch, after: int | None) -> pa.RecordBatch:
        nonlocal before, lead
        tokens = numpy_of(b.column("token"))
        bounds = run_bounds(tokens)
        same = tokens[1:] == tokens[:-1]
        shared = np.append(same, after is not None and tokens[-1] == after)
        shared[1:] |= same
        cols = []
        for i, c in enumerate(LEAD):
            v = numpy_of(b.column(c))[bounds[:-1]].copy()
            if before is not None and tokens[0] == before:
                v[0] = lead[i]
            cols.append(v)
        shared[0] |= before is not None and tokens[0] == before
        before, lead = int(tokens[-1]), [int(v[-1]) for v in cols]
        first = pa.StructArray.from_arrays([pa.array(np.repeat(v, np.diff(bounds))) for v in cols], names=list(LEAD))
        return pa.RecordBatch.from_arrays([*b.columns, first], names=[*b.schema.names, "first"]).filter(pa.array(shared))

    for b in batches:
        if b.num_rows:
            if held is not None:
                yield kept(held, int(numpy_of(b.column("token"))[0]))
            held = b
    if held is not None:
        yield kept(held, None)


def _led(batches, plan: JoinPlan) -> Iterator[pa.RecordBatch]:
    """(doc, first document of the token) where the token can be evidence for the pair."""
    for b in batches:
        first = b.column("first")
        mine = [numpy_of(b.column(c)).astype(np.int64) for c in LEAD]
        other = [numpy_of(first.field(i)).astype(np.int64) for i in range(len(LEAD))]
        ok = (mine[0] != other[0]) & admissible(*mine[1:], *other[1:], plan.percent)
        yield pa.RecordBatch.from_arrays([pa.array(mine[0][ok]), pa.array(other[0][ok])], names=["doc", "first"])


def _across(postings: DataFrame, classes: DataFrame, plan: JoinPlan) -> DataFrame:
    """(a, b) of different classes that share as many prefix tokens as their m demands."""
    rows = postings.drop("first").join(classes.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    # written first, so that the join below can be split where a token is hot
    mixed_tokens = persisted(rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("df")).where("lo != hi").select("token", "df"), "jaccard-tokens")
    rows = block_pairs(rows.join(mixed_tokens, "token"), F.col("df"), plan.block_rows, F.col("doc"))
    keys = ["token", "blk_i", "blk_j"]
    rows = rows.drop("df").repartition(shuffle_partitions(postings.sparkSession), *keys).sortWithinPartitions(*keys, "side")

    def pairs(batches):
        for chunk in aligned(batches, keys, 8192):
            key = [numpy_of(chunk[k]) for k in keys]
            doc, comp, n, pos, m, side = (numpy_of(chunk[c]).astype(np.int64) for c in ("doc", "component", "n", "pos", "m", "side"))
            bounds = run_bounds(*key)
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s < 2:
                    continue
                inner = key[1][s] == key[2][s]
                cut = e if inner else s + int((side[s:e] == 0).sum())
                left = np.arange(s, cut)
                right = left if inner else np.arange(cut, e)
                ok = (comp[left][:, None] != comp[right][None]) & (doc[left][:, None] != doc[right][None])
                if inner:
                    ok &= doc[left][:, None] < doc[right][None]
                ok &= admissible(n[left][:, None], pos[left][:, None], m[left][:, None], n[right][None], pos[right][None], m[right][None], plan.percent)
                i, j = np.nonzero(ok)
                if len(i):
                    a, b = doc[left[i]], doc[right[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.minimum(m[left[i]], m[right[j]]).astype(np.int16))], names=["a", "b", "m"])

    found = rows.mapInArrow(pairs, "a long, b long, m short")
    return found.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("m").alias("m")).where("c >= m").select("a", "b")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, plan: JoinPlan, clash: list[int]) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the threshold.

    Pairs meet at a: its text comes once for each block of star_rows partners, so a node with any
    number of partners is spread out, and a task holds one text of a and one partner at a time. Texts
    come by a node's first doc_id; another text of that id is known by its key and left out.
    """
    pairs = persisted(pairs, "jaccard-pairs")
    heavy = pairs.groupBy("a").agg(F.ceil(F.count("*") / plan.star_rows).cast("int").alias("nb"))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ends = persisted(ends.join(nodes.select("node", F.col("first").alias("doc")), "node"), "jaccard-ends")
    texts = docs.join(broadcast_if_small(ends.select("doc").distinct(), ends.count()), "doc", "left_semi")
    pairs = pairs.join(heavy, "a").withColumn("blk", F.pmod(F.xxhash64("b"), F.col("nb").cast("long")).cast("int"))
    tasks = pairs.select("a", "blk", F.col("b").alias("node"), F.lit(1).alias("role"))
    tasks = tasks.unionByName(heavy.select("a", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("blk"), F.col("a").alias("node"), F.lit(0).alias("role")))
    rows = texts.join(tasks.join(ends, "node"), "doc").repartition(shuffle_partitions(docs.sparkSession), "a", "blk").sortWithinPartitions("a", "blk", "role")

    def checked(batches):
        hasher, at, lead = WordHasher(), None, None
        for b in sliced(batches):
            keys = list(zip(b.column("a").to_pylist(), b.column("blk").to_pylist()))
            wanted, roles = numpy_of(b.column("node")), b.column("role").to_pylist()
            sets = shingle_sets(binaries(b.column("text")), plan.width, hasher)
            mine = node_keys(sets, clash) == wanted
            out = []
            for i, s in enumerate(sets):
                if not mine[i]:
                    continue
                if roles[i] == 0:
                    at, lead = keys[i], (s if at != keys[i] else lead)
                elif at == keys[i] and similar(lead, s, plan.percent):
                    out.append((keys[i][0], int(wanted[i])))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(checked, "a long, b long")
