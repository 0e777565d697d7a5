"""Maximal repeats of whole tables with all their occurrences: the groups that ``suffix_dedup`` settles by hash.

A maximal repeat begins where the bytes before its occurrences differ, and its first window of LEAST bytes holds the same
anchor at the same place in each of them. So the occurrences of each shared anchor, with the bytes to their left, give
the places where maximal repeats begin, in groups that no repeat crosses. The suffixes of a group are compared a chunk
of bytes at a time, each longer than the last: the common-prefix interval tree of the chunks gives the repeats that end
inside them, and suffixes with equal chunks go on together while the bytes before them differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.runtime import id_text, partitions, returns_memory, small_batches, written
from tidebook.llm.suffix_array import NOTHING, intervals
from tidebook.llm.suffix_dedup import _KEY, LEAST, PARTS, SIDE, _announce, _by_part, _expand, _from_six, _gather, _identified, _pack, _shared, _six, _squeeze, _unpack, anchors

#: Bytes compared in the first round, how much longer each next chunk is, and the longest one.
CHUNK, LONGER, CHUNK_MOST = 128, 4, 1 << 16
#: Bytes of chunks sorted at once, unless one group has more.
AT_ONCE = 1 << 24
#: Places of group numbers below the part's number.
PART_BITS = 40
_CONTEXT = {"h": None, "doc": np.int64, "owner": np.int32, "place": np.int64, "far": np.uint8, "near": np.uint8, "left": np.uint8}
_STATE = {"group": np.int64, "owner": np.int32, "doc": np.int64, "begin": np.int64, "before": np.int16}


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)


def _schema(names: list[str]) -> str:
    return ", ".join(f"{c} {({'part': 'int', 'pack': 'long'}).get(c, 'binary')}" for c in names)


def _kinds(names: list[str]) -> list[pa.DataType]:
    return [{"part": pa.int32(), "pack": pa.int64()}.get(c, pa.binary()) for c in names]


def _cuts(x: np.ndarray) -> list[int]:
    """Where runs of equal values begin, and the end."""
    return [*np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist(), len(x)] if len(x) else [0]


def _contexts(n: int) -> Callable:
    names = ["part", "pack", *_CONTEXT]

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, raw, lists in zip(*(batch.column(c).to_pylist() for c in ("pack", "rows", "keys")), strict=True):
                if not lists:
                    continue
                buf, off, ids, known = _identified(_unpack(raw))
                place, owner, h = anchors(buf, off)
                size = np.diff(off)
                # the windows of an anchor: from after the last that the anchor before holds, to its own last
                last = np.minimum(place, off[owner] + size[owner] - LEAST)
                alone = np.concatenate([[True], owner[1:] != owner[:-1]])
                lo = np.maximum(off[owner], place - SIDE)
                turn = np.where(alone, off[owner], 0)
                with np.errstate(over="ignore"):
                    low = h >> np.uint64(21)
                beats = low[1:] < low[:-1]  # a lesser hash holds each window that reaches it; else the one before holds on
                held = np.where(beats, place[1:] - SIDE, place[:-1] + 1)
                turn[1:] = np.where(alone[1:], turn[1:], held)
                lo = np.maximum(lo, turn)
                last[:-1] = np.where(alone[1:], last[:-1], np.minimum(last[:-1], turn[1:] - 1))
                keep = known[owner] & np.isin(h & np.uint64(_KEY), np.concatenate([_from_six(x) for x in lists])) & (lo <= last)
                place, owner, h, lo, last = place[keep], owner[keep], h[keep], lo[keep], last[keep]
                part = ((h >> np.uint64(48)) % np.uint64(n)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut, rows = _cuts(part[order]), []
                for a, b in zip(cut, cut[1:]):  # noqa: B905
                    i = order[a:b]
                    inside = place[i] - off[owner[i]]
                    left = np.minimum(inside, SIDE + 1)
                    fields = (ids[owner[i]], owner[i].astype(np.int32), inside, (place - lo)[i].astype(np.uint8), (place - last)[i].astype(np.uint8), _gather(buf, place[i] - left, left))
                    rows.append((int(part[i[0]]), pack, _six(h[i] & np.uint64(_KEY)), *(_squeeze(x.tobytes()) for x in fields)))
                if rows:
                    yield _batch(rows, names, _kinds(names))

    return run


def _read(rows: list[dict], fields: dict) -> dict[str, np.ndarray]:
    out = {c: np.concatenate([_from_six(r[c]) if t is None else np.frombuffer(_expand(r[c]), t) for r in rows]) for c, t in fields.items()}
    return out


def _state_rows(pack: np.ndarray, state: dict[str, np.ndarray]) -> list[tuple]:
    order = np.argsort(pack, kind="stable")
    cut = _cuts(pack[order])
    return [(int(pack[order[a]]), *(_squeeze(state[c][order[a:b]].astype(t).tobytes()) for c, t in _STATE.items())) for a, b in zip(cut, cut[1:])]  # noqa: B905


def _varied(group: np.ndarray, doc: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows (sorted by group) of groups that several documents hold and that differ in the byte before."""
    first = np.array(_cuts(group)[:-1], np.int64)
    low, high = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
    good = (np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)) & ((low != high) | (low == NOTHING))
    return np.repeat(good, np.diff(np.append(first, len(group))))


@returns_memory
def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where maximal repeats can begin, grouped by anchor and the bytes between."""
    for rows in _by_part(batches):
        x = _read(rows, _CONTEXT)
        pack = np.concatenate([np.full(len(r["h"]) // 6, r["pack"], np.int64) for r in rows])
        width = np.minimum(x["place"], SIDE + 1)
        end = np.cumsum(width)
        group = np.unique(x["h"], return_inverse=True)[1].astype(np.int64)
        at, number, found = np.arange(len(group)), 0, []
        for o in range(SIDE + 1):
            some = at[(x["far"][at] >= o) & (x["place"][at] >= o)]
            if not len(some):
                break
            at = some[np.argsort(group[some], kind="stable")]
            before = np.where(x["place"][at] > o, x["left"][np.maximum(end[at] - o - 1, 0)].astype(np.int64), NOTHING)
            here = x["near"][at] <= o
            mine = at[here]
            if len(mine):
                good = _varied(group[mine], x["doc"][mine], before[here])
                mine, b = mine[good], before[here][good]
                if len(mine):
                    names = np.unique(group[mine], return_inverse=True)[1]
                    found.append((mine, names + number, x["place"][mine] - o, b))
                    number += int(names.max()) + 1
            group[at] = np.unique(group[at] * 257 + before + 1, return_inverse=True)[1]
        if found:
            row, name, start, b = (np.concatenate(c) for c in zip(*found, strict=True))
            state = {"group": name + (rows[0]["part"] << PART_BITS), "owner": x["owner"][row], "doc": x["doc"][row], "begin": start, "before": b}
            yield _batch(_state_rows(pack[row], state), ["pack", *_STATE], _kinds(["pack", *_STATE]))


def _chunks(depth: int, size: int) -> Callable:
    names = ["part", "pack", *_STATE, "room", "bytes"]

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["states"]:
                    continue
                buf, off, _, _ = _identified(_unpack(row["rows"]))
                for s in row["states"]:  # one a part
                    x = _read([s], _STATE)
                    lo = np.minimum(off[x["owner"]] + x["begin"] + depth, off[x["owner"] + 1])
                    room = np.minimum(off[x["owner"] + 1] - lo, size)
                    yield _batch([(int(x["group"][0] >> PART_BITS), row["pack"], *(s[c] for c in _STATE), _squeeze(room.astype(np.int32).tobytes()), _squeeze(_gather(buf, lo, room).tobytes()))], names, _kinds(names))

    return run


_GROWN = "group_id long, length long, doc_id long, start long, pack long, " + ", ".join(f"`{c}` binary" for c in _STATE)


def _grow(depth: int, size: int) -> Callable:
    kinds = [pa.int64()] * 5 + [pa.binary()] * len(_STATE)
    names = ["group_id", "length", "doc_id", "start", "pack", *_STATE]

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            x = _read(rows, _STATE | {"room": np.int32, "bytes": np.uint8})
            buf, room = x.pop("bytes"), x["room"].astype(np.int64)
            pack = np.concatenate([np.full(len(_expand(r["room"])) // 4, r["pack"], np.int64) for r in rows])
            at = np.cumsum(room) - room
            order = np.argsort(x["group"], kind="stable")
            cut, number, going = np.array(_cuts(x["group"][order])), 0, []
            a, step = 0, max(1, AT_ONCE // size)
            while a < len(cut) - 1:
                b = max(a + 1, int(np.searchsorted(cut, cut[a] + step, "right")) - 1)
                i = order[cut[a] : cut[b]]
                a = b
                width = max(int(room[i].max()), 1)
                cells = np.zeros((len(i), width), np.uint8)
                cells[np.arange(width) < room[i][:, None]] = _gather(buf, at[i], room[i])
                by = np.lexsort((room[i], cells.view(f"S{width}").reshape(-1), x["group"][i]))
                i, cells = i[by], cells[by]
                differ = cells[1:] != cells[:-1]
                common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
                common = depth + np.minimum(common, np.minimum(room[i][1:], room[i][:-1]))
                common = np.concatenate([[0], np.where(x["group"][i][1:] == x["group"][i][:-1], common, 0)])
                doc, out = x["doc"][i], []
                for length, p, q in intervals(common, x["before"][i].astype(np.int64), min(LEAST, depth + size)):
                    if doc[p : q + 1].min() == doc[p : q + 1].max():
                        continue
                    if length == depth + size:
                        going.append((i[p : q + 1], np.full(q + 1 - p, number)))
                        number += 1
                        continue
                    if length < LEAST:
                        continue
                    m = i[p : q + 1]
                    least = m[np.lexsort((x["begin"][m], x["owner"][m], pack[m], x["doc"][m]))[0]]
                    name = xxhash.xxh64_intdigest(f"{pack[least]} {x['owner'][least]} {x['begin'][least]} {length}") - 2**63
                    out.append((np.full(len(m), name), np.full(len(m), length), x["doc"][m], x["begin"][m]))
                if out:
                    columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), t) for t in kinds[4:])], names)
            if going:
                row, group = (np.concatenate(c) for c in zip(*going, strict=True))
                state = {c: x[c][row] for c in _STATE} | {"group": group + (rows[0]["part"] << PART_BITS)}
                yield _batch([(None,) * 4 + r for r in _state_rows(pack[row], state)], names, kinds)

    return run


def repeat_groups(docs: DataFrame) -> DataFrame:
    """(group_id, length, doc_id, start) of every maximal repeat of at least LEAST bytes that several documents hold, one
    row an occurrence: in all documents, the smallest and exact copies included, and all within a document. Starts and
    lengths are bytes. Rows of equal doc_id are one document; rows without an id are left out.

    ``without_repeats`` removes what the occurrences outside each group's smallest document cover. Each round of longer
    chunks writes its groups and what goes on; rounds end when no suffixes go on."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    parts = n * PARTS
    packs = written(id_text(docs).where("doc_id is not null and text is not null").mapInArrow(_pack, "pack long, rows binary"), "packs").repartition(n, "pack")
    shared = packs.mapInArrow(_announce(parts), "part int, pack long, keys binary, several binary").repartition(n, "part").sortWithinPartitions("part").mapInArrow(_shared, "pack long, keys binary")
    shared = shared.groupBy("pack").agg(F.collect_list("keys").alias("keys"))
    around = packs.join(shared, "pack", "left").select("pack", "rows", "keys").mapInArrow(_contexts(parts), _schema(["part", "pack", *_CONTEXT]))
    state = written(around.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_starts, _schema(["pack", *_STATE])), "starts")
    depth, size, found = 0, CHUNK, None
    while True:
        states = state.groupBy("pack").agg(F.collect_list(F.struct(*_STATE)).alias("states"))
        chunks = packs.join(states, "pack").select("pack", "rows", "states").mapInArrow(_chunks(depth, size), _schema(["part", "pack", *_STATE, "room", "bytes"]))
        grown = written(chunks.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_grow(depth, size), _GROWN), "grown")
        ended = grown.where("group_id is not null").select("group_id", "length", "doc_id", "start")
        found = ended if found is None else found.unionByName(ended)
        state = grown.where("pack is not null").select("pack", *_STATE)
        if state.isEmpty():
            return found
        depth, size = depth + size, min(size * LONGER, CHUNK_MOST)
