"""Kernels over whole projects: activities and links of a project meet once, many projects at a time.

A project always fits one task; projects are the axis that scales. One shuffle by project brings
both tables together (their own partitioning is reused where it fits), and a kernel gets a chunk of
some ten thousand rows of whole projects, so its NumPy steps run over many projects at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHUNK_ROWS = 20_000


def graph_apply(acts: DataFrame, links: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]], schema: str, columns: list[str], link_columns: list[str] | None = None, order: str = "seq") -> DataFrame:
    """kernel(activities, links) for chunks of whole projects; it returns its rows, or yields them in parts.

    activities has project_id, id, p (number of the project in the chunk) and the columns asked for, in
    order within the project; links has src and dst (positions of activities), rel, lag, ord and
    its own columns. Links to unknown activities and to themselves are dropped.
    """
    link_columns = link_columns or []
    node = F.struct("id", *columns)
    link = F.struct("source", "target", "rel", "lag", "ord", *link_columns)
    rows = acts.select("project_id", node.alias("node"), F.lit(None).cast(links.select(link.alias("l")).schema["l"].dataType).alias("link"), F.lit(0).alias("kind"), F.col(order).cast("long").alias("o"))
    more = links.select("project_id", F.lit(None).cast(acts.select(node.alias("n")).schema["n"].dataType).alias("node"), link.alias("link"), F.lit(1).alias("kind"), F.col("ord").cast("long").alias("o"))
    # a window, not repartition(): Spark drops a repartition() where both sides are partitioned alike, and may then read either side
    # otherwise (local or split reads of joins), since nothing asks for whole projects any more; a window does ask
    both = rows.unionByName(more).withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy("kind", "o")))
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for t in whole_projects(batches):
            kind = t["kind"].to_numpy()
            if not (kind == 0).any():  # links of projects without activities alone
                continue
            a = _frame(t, "node", kind == 0)
            e = _frame(t, "link", kind == 1)
            a["p"] = pd.factorize(a["project_id"])[0]
            index = pd.MultiIndex.from_arrays([a["project_id"], a["id"]])
            e["src"] = index.get_indexer(pd.MultiIndex.from_arrays([e["project_id"], e["source"]])) if len(e) else np.zeros(0, int)
            e["dst"] = index.get_indexer(pd.MultiIndex.from_arrays([e["project_id"], e["target"]])) if len(e) else np.zeros(0, int)
            e = e[(e.src >= 0) & (e.dst >= 0) & (e.src != e.dst)].reset_index(drop=True)
            out = kernel(a, e)
            for part in [out] if isinstance(out, pd.DataFrame) else out:
                yield from pa.Table.from_arrays([pa.array(part[f.name], f.type, from_pandas=True) for f in target], schema=target).to_batches()

    return both.mapInArrow(run, schema)


def project_apply(rows: DataFrame, kernel: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, columns: list[str], order: str) -> DataFrame:
    """kernel(rows) for chunks of whole projects, without links: project_id and the columns asked for, in order within the project."""
    own = rows.where("project_id is not null").select("project_id", *columns)
    whole = own.withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy(order)))

    def run(batches):
        for t in whole_projects(batches):
            yield from kernel(t)

    return whole.mapInArrow(run, schema)


def _frame(t: pa.Table, column: str, rows: np.ndarray) -> pd.DataFrame:
    part = t.filter(pa.array(rows))
    body = part[column].combine_chunks()
    out = pd.DataFrame({f.name: (body.chunk(0) if isinstance(body, pa.ChunkedArray) else body).field(i).to_pandas() for i, f in enumerate(body.type)}) if part.num_rows else pd.DataFrame({f.name: [] for f in body.type})
    out.insert(0, "project_id", part["project_id"].to_pandas().to_numpy() if part.num_rows else [])
    return out


def whole_projects(batches, least: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t["project_id"].to_numpy()
        other = np.flatnonzero(ids != ids[-1])
        if len(other):
            cut = int(other[-1]) + 1
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            n = t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
