"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents become pieces of at most `capacity` tokens. A round range-sorts the pieces left and the gaps (free ends
of sequences) together by length, longest first. A piece's successor is the smallest gap still free that holds it.
Sweeping from long to short, gaps go on a stack and a piece takes the top one: every task sweeps its own range, and a
sweep over two counts of each task (pieces that found nothing, gaps that nobody took) tells by ranks which task's
left-over gaps its shorter neighbours' pieces get, so that no two pieces get one gap. Gaps shrink, and the next round
begins; new sequences are opened only for pieces longer than every gap. A gap that holds several of the longest pieces
left is offered as so many slots, so that short pieces don't need a round each.

A round places at least one piece; on the documents here 9 to 13 rounds place all. Their number grows with the variety
of lengths, not with the number of documents.
"""

from __future__ import annotations

import base64
import itertools
import logging
import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import dropped, numpy_of, persisted, shuffle_partitions, small_batches, write_path

#: The byte-level BPE vocabulary as ranks: the same ids as byte_bpe_50k.json gives, several times faster.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The special token of byte_bpe_50k.json (fixed value): its string in a text is this one id, as there.
SPECIAL = {"<|endoftext|>": 50256}
END_OF_TEXT = 0
#: Pieces and slots of a task of a sweep.
SWEEP_ROWS = 50_000
log = logging.getLogger(__name__)


def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


SWEPT = "part int, rank long, pid long, size int, sequence_id long, slot int"


def matched(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions (pieces, their gaps, pieces without one, gaps without one) of a sweep in order; piece tells which are pieces.

    Gaps open and pieces close brackets; a pair stands on one level with nothing of that level between.
    """
    depth = np.cumsum(np.where(piece, -1, 1))
    alone = piece & (depth < np.minimum(0, np.minimum.accumulate(np.append(0, depth[:-1]))))
    rest = np.flatnonzero(~alone)
    closes = piece[rest]
    level = np.cumsum(np.where(closes, -1, 1)) + closes
    order = np.argsort(level, kind="stable")
    here, level, closes = rest[order], level[order], closes[order]
    pair = np.flatnonzero(closes)  # before each piece of a level stands its gap
    free = np.ones(len(here), bool)
    free[pair] = free[pair - 1] = False
    return here[pair], here[pair - 1], np.flatnonzero(alone), np.sort(here[free])


def swept(batches) -> Iterator[pa.RecordBatch]:
    """One task's sweep: pairs, and ranks of what is left (pieces first to last, gaps in the order of the sweep)."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    kind, ids, size, slot = (numpy_of(t[c]) for c in ("kind", "id", "size", "slot"))
    pieces, gaps, loose, open_ = matched(kind == 1)
    part = TaskContext.get().partitionId()

    def rows(n, rank, pid, sizes, seq, slots):
        none = lambda v, kind: pa.nulls(n, kind) if v is None else pa.array(v, kind)
        cols = [pa.array(np.full(n, part, np.int32)), none(rank, pa.int64()), none(pid, pa.int64()), none(sizes, pa.int32()), none(seq, pa.int64()), none(slots, pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["part", "rank", "pid", "size", "sequence_id", "slot"])

    yield rows(len(pieces), None, ids[pieces], size[pieces], ids[gaps], slot[gaps])
    yield rows(len(loose), np.arange(len(loose)), ids[loose], size[loose], None, None)
    yield rows(len(open_), np.arange(len(open_)), None, size[open_], ids[open_], slot[open_])


def resolved(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """From (task, pieces left, gaps left) of every task: (task, first rank, last rank, task of the gaps, rank of the
    first one's gap); later pieces get gaps of falling ranks."""
    stack, out = [], []
    for part, pieces, gaps in sorted(counts):
        done = 0
        while done < pieces and stack:
            owner, n = stack.pop()
            take = min(n, pieces - done)
            out.append((part, done, done + take - 1, owner, n - 1))
            done += take
            if n > take:
                stack.append((owner, n - take))
        if gaps:
            stack.append((part, gaps))
    return out


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """(pid, sequence_id, offset) of pieces (pid, size), sizes from 1 to capacity; sequences are numbered from 0.

    A round's tables are written to the shared folder. The driver gets the number of pieces and gaps of each
    length (2 * capacity numbers at most) and two counts of each task.
    """
    spark = pieces.sparkSession
    path = write_path(spark, "packing-placed")
    shape = "pid long, size int, sequence_id long, slot int"
    left, opened = persisted(pieces.select("pid", F.col("size").cast("int").alias("size")), "packing-left"), 0
    gaps = persisted(spark.createDataFrame([], "sequence_id long, free int"), "packing-gaps")
    for turn in itertools.count():
        tally = left.groupBy(F.lit(1).alias("kind"), "size").count().unionByName(gaps.groupBy(F.lit(0).alias("kind"), F.col("free").alias("size")).count()).collect()
        sizes = sorted(((r["size"], r["count"]) for r in tally if r["kind"] == 1), reverse=True)
        if not sizes:
            break
        longest, shortest, widest = sizes[0][0], sizes[-1][0], max((r["size"] for r in tally if r["kind"] == 0), default=0)
        now = gaps.where(F.col("free") >= shortest)
        if longest > widest:
            new = sum(n for s, n in sizes if s > widest and 2 * s > capacity) or math.ceil(sum(s * n for s, n in sizes if s > widest) / capacity)
            now = now.unionByName(spark.range(opened, opened + new).select(F.col("id").alias("sequence_id"), F.lit(capacity).alias("free")))
            opened += new
        k = F.greatest(F.lit(1), F.floor(F.col("free") / longest)).cast("int")
        slots = now.withColumn("k", k).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        slots = slots.select(F.lit(0).alias("kind"), F.col("sequence_id").alias("id"), F.when(F.col("slot") == F.col("k") - 1, F.col("free") - longest * (F.col("k") - 1)).otherwise(longest).cast("int").alias("size"), "slot")
        both = slots.unionByName(left.select(F.lit(1).alias("kind"), F.col("pid").alias("id"), "size", F.lit(0).alias("slot"))).withColumn("h", F.xxhash64("id", "slot"))
        n_rows = 2 * sum(n for _, n in sizes) + sum(r["count"] for r in tally if r["kind"] == 0)
        order = [F.desc("size"), F.asc("kind"), F.asc("h")]  # of equal lengths gaps come first: they hold the pieces
        both = both.repartitionByRange(max(1, min(shuffle_partitions(spark), math.ceil(n_rows / SWEEP_ROWS))), *order).sortWithinPartitions(*order)
        found = persisted(both.select("kind", "id", "size", "slot").mapInArrow(swept, SWEPT), "packing-swept")
        loose, open_ = found.where("sequence_id is null"), found.where("pid is null")
        ranked = found.where("rank is not null").groupBy("part").agg(F.count("pid").alias("pieces"), F.count("sequence_id").alias("gaps")).collect()
        runs = resolved([(r["part"], r["pieces"], r["gaps"]) for r in ranked])
        placed = found.where("rank is null").select("pid", "size", "sequence_id", "slot")
        if runs:
            table = F.broadcast(spark.createDataFrame(runs, "part int, first long, last long, owner int, top long"))  # two rows for each task at most
            asked = loose.join(table, "part").where("rank between first and last").select("pid", "size", "owner", (F.col("top") - F.col("rank") + F.col("first")).alias("rank"))
            offered = open_.select(F.col("part").alias("owner"), "rank", "sequence_id", "slot")
            placed = placed.unionByName(asked.join(offered, ["owner", "rank"]).select("pid", "size", "sequence_id", "slot"))
        placed.write.parquet(f"{path}/round={turn}")
        placed = spark.read.schema(shape).parquet(f"{path}/round={turn}")
        after = loose.select("pid", "size")
        after = persisted(after.join(placed.select("pid"), "pid", "left_anti") if runs else after, "packing-left")
        shrunk = now.unionByName(placed.select("sequence_id", (-F.col("size")).alias("free"))).groupBy("sequence_id").agg(F.sum("free").cast("int").alias("free")).where("free > 0")
        shrunk = persisted(shrunk, "packing-gaps")
        dropped(left, gaps, found)
        left, gaps = after, shrunk
        log.info("round %d: %d pieces of up to %d tokens, %d sequences", turn, sum(n for _, n in sizes), longest, opened)
    dropped(left, gaps)
    if not opened:
        return spark.createDataFrame([], "pid long, sequence_id long, offset long")
    before = Window.partitionBy("sequence_id").orderBy("round", "slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema(f"{shape}, round int").parquet(path)
    return rows.select("pid", "sequence_id", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))


def pieces_of(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length): whole pieces, and before them a shorter first one if need be."""
    at = n % capacity or min(n, capacity)
    yield 0, at
    while at < n:
        yield at, capacity
        at += capacity


def tokenized(docs: DataFrame, vocabulary: str, capacity: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, pid): pid numbers the pieces, by task and place."""

    def run(batches):
        enc = encoder(vocabulary)
        pid = TaskContext.get().partitionId() << 36
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows: list[tuple] = []
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(enc.encode_to_numpy(t or "", allowed_special="all"), END_OF_TEXT).astype("<u4")
                    for p, (start, n) in enumerate(pieces_of(len(ids), capacity)):
                        raw = ids[start : start + n].tobytes()
                        rows.append((d, p, start, n, zlib.crc32(raw), raw, pid))
                        pid += 1
                cols = list(zip(*rows)) if rows else [()] * 7
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "pid"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, pid long")


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset): every token of every document, packed.

    A document is its text's ids and then id 0; a null or empty text is that one id; the string of the special token
    is its id. Longer ones than capacity are cut, a shorter piece first. Rows that repeat, and null ids, are documents
    of their own. An empty table gives no rows. Ties (pieces of one length) go by a hash of the piece's number. Only
    the two named columns are read. with_ids=False leaves the ids out. Whole pieces are sequences of their own
    (negative numbers).

    The corpus is tokenised once, into a table in the shared folder; the rounds move numbers and lengths of pieces
    only. At the end each piece is joined with its place.
    """
    made = tokenized(docs, vocabulary or public_tokenizers.path(VOCABULARY), capacity, doc_id, text)
    made = persisted(made if with_ids else made.drop("ids"), "pieces")
    names = [c for c in made.columns if c != "pid"]
    short = made.where(F.col("length") < capacity)
    places = best_fit(short.select("pid", F.col("length").alias("size")), capacity)
    whole = made.where(F.col("length") == capacity).select(*names, (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.join(places.hint("shuffle_hash"), "pid").select(*names, "sequence_id", "offset").unionByName(whole)
