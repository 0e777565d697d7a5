"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.runtime import returns_memory, written

#: Edges that a task contracts at once.
AT_ONCE = 200_000


def _pairs(*pairs: tuple[Column | str, Column | str]) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.explode(F.array(*[F.struct(col(a).alias("u"), col(b).alias("v")) for a, b in pairs])).alias("e")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node links its greater neighbours to the least node about it. Small star: each node links
    itself and its smaller neighbours to the least of them. The least neighbour is a pre-aggregated minimum and the
    join back is an equi-join that adaptive execution splits, so no neighbourhood is gathered in one place."""
    if large:
        near = edges.select(_pairs(("u", "v"), ("v", "u"))).select("e.*")
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return joined.select(_pairs(("v", "m"), ("u", "m"))).select("e.*").where("u <> v").distinct()


def contracted(u: list[int], v: list[int]) -> tuple[list[int], list[int]]:
    """The same connections as edges from each node to the least node that these edges join it to."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        up = root.setdefault(x, x)
        while up != x:
            root[x] = up = root[up]
            x, up = up, root[up]
        return x

    for a, b in zip(u, v, strict=True):
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    nodes = [x for x in root if top(x) != x]
    return nodes, [top(x) for x in nodes]


@returns_memory
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts AT_ONCE edges of a partition at a time, before anything is shuffled."""
    us, vs, held = [], [], 0

    def flush() -> pa.RecordBatch:
        u, v = contracted(np.concatenate(us).tolist(), np.concatenate(vs).tolist())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        us.append(batch.column("u").to_numpy(zero_copy_only=False))
        vs.append(batch.column("v").to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= AT_ONCE:
            yield flush()
            us, vs, held = [], [], 0
    if held:
        yield flush()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of long node ids to (node, component): the least node id reachable. Nodes without an edge to
    another node are not returned. Null ends, loops and repeated edges are ignored; no edges give no rows.
    Each partition contracts its own edges before a round; rounds go on until an alternation leaves the edge table
    unchanged (row count and checksum)."""
    now, mark = edges.where("u is not null and v is not null and u <> v").select("u", "v"), None
    while True:
        now = written(_star(_star(now.mapInArrow(_contract, "u long, v long"), True), False), "cc")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    return now.select(_pairs(("u", "v"), ("v", "v"))).select(F.col("e.u").alias("node"), F.col("e.v").alias("component")).distinct()
