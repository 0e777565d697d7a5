"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its own documents best-fit decreasing. Nearly full bins are final; underfull bins become items
of the next round, where groups of partitions are packed again, eight to one, until one group is left. A group holds
at most GROUP_ITEMS bins: where more are open, groups stay as many as that takes and bins are dealt out anew each round,
until a round merges hardly any.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.kernels import blocks
from tidebook.llm.runtime import id_text, small_batches, written
from tidebook.llm.vocab import vocabulary

#: Partitions whose underfull bins meet in one group of the next round.
FAN_IN = 8
#: A bin at this share of its capacity is final.
NEARLY_FULL = 0.995
#: Open bins of one group, and the share of open bins that a round must merge for another to follow.
GROUP_ITEMS, LEAST_MERGED = 200_000, 0.01


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing (ties: earlier item first): each item's bin and offset, and the fill of every bin.

    A bit mask over the free spaces in use finds the least one that is large enough."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask ^= 1 << space
        else:
            space, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = space - size
        if left:
            by_space[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _local(path: str, end_id: int, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = vocabulary(path)
        end = np.array([end_id], np.uint32).tobytes()
        docs, pieces, crcs, lengths = [], [], [], []
        for batch in batches:
            for part, _, _ in blocks(batch, "text"):
                for doc, raw in zip(part.column("doc_id").to_pylist(), memory.ids(part.column("text").fill_null("").to_pylist()), strict=True):
                    raw += end
                    for a in range(0, len(raw), 4 * capacity):
                        one = raw[a : a + 4 * capacity]
                        docs.append(doc)
                        pieces.append(a // (4 * capacity))
                        crcs.append(zlib.crc32(one))
                        lengths.append(len(one) // 4)
        if not docs:
            return
        sizes, number = np.array(lengths, np.int64), np.array(pieces, np.int64)
        bins, offsets, fills = best_fit(sizes, capacity)
        first = TaskContext.get().partitionId() << 32
        table = pa.table([pa.array(docs, pa.int64()), pa.array(number, pa.int32()), pa.array(number * capacity), pa.array(sizes), pa.array(crcs, pa.int64()), pa.array(first + bins), pa.array(offsets), pa.array(fills[bins])], ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])
        yield from table.to_batches(max_chunksize=10_000)

    return run


def _merge(capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).sort_by("bin")
        for group in np.unique(table.column("group").to_numpy()):
            own = table.filter(pc.equal(table.column("group"), group))
            old, fill = own.column("bin").to_numpy(), own.column("fill").to_numpy()
            bins, offsets, fills = best_fit(fill, capacity)
            # a merged bin takes the name of its first item
            name = np.zeros(len(fills), np.int64)
            name[bins[offsets == 0]] = old[offsets == 0]
            yield from pa.table([pa.array(old), pa.array(name[bins]), pa.array(offsets), pa.array(fills[bins]), pa.array(np.full(len(old), group, np.int64))], ["bin", "into", "shift", "fill", "group"]).to_batches(max_chunksize=10_000)

    return run


def packed(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    A document is its whole text's ids and ``end_id``; only longer ones are cut, into pieces of ``capacity``. Null and
    empty texts are the end id alone; null and repeated ids are packed like others; an empty table gives no rows.
    The texts are read once and never shuffled; a round moves only underfull bins (two numbers each). Bins that no
    item of their group fits stay as they are, so a round's groups shrink to what can still be combined.
    """
    spark = docs.sparkSession
    small_batches(spark)
    placed = written(id_text(docs, id_col, text_col).mapInArrow(_local(path, end_id, capacity), SCHEMA), "pieces")
    full = int(capacity * NEARLY_FULL)
    # no bin accepts less than the smallest open bin: fuller ones than that allows are final too
    open_bins = placed.where((F.col("offset") == 0) & (F.col("fill") < full)).select("bin", "fill", F.shiftright("bin", 32).alias("group"))
    count, groups, least = open_bins.agg(F.count(F.lit(1)), F.max("group"), F.min("fill")).first()
    moved: DataFrame | None = None
    n, merged = 0 if groups is None else groups + 1, True
    while n > 1 and merged:
        before, n = n, max(-(-n // FAN_IN), -(-count // GROUP_ITEMS))
        # whole groups meet while they get fewer; after that bins meet others by a hash that changes with the round
        group = F.floor(F.col("group") * n / before) if n < before else F.pmod(F.xxhash64("bin", F.lit(count)), F.lit(n))
        items = open_bins.where(F.col("fill") <= capacity - least).withColumn("group", group.cast("long"))
        step = written(items.repartition(n, "group").mapInArrow(_merge(capacity), "bin long, into long, shift long, fill long, group long"), "merged")
        if moved is None:
            moved = step.select("bin", "into", "shift")
        else:  # the items of a later round are bins that the first round made
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            both = moved.join(later, "into", "left")
            moved = written(both.select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "moved")
        open_bins = step.where((F.col("shift") == 0) & (F.col("fill") < full)).select(F.col("into").alias("bin"), "fill", "group")
        left, least = open_bins.agg(F.count(F.lit(1)), F.min("fill")).first()
        merged = least is not None and (n < before or count - left >= LEAST_MERGED * count)
        count = left
    if moved is None:
        return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    out = placed.join(moved, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
