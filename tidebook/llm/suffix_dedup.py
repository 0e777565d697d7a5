"""Removal of repeated passages by distributed enhanced suffix arrays.

Every window of LEAST bytes holds an anchor: its k-gram of the least hash (the leftmost of equals), a choice that
depends on the window's bytes alone. So two equal windows hold the same anchor at the same place, and all
equalities can be found among the surroundings of equal anchors:

1. Texts are packed into blocks of about a megabyte; each pack sends its anchors' hashes, once each, to where they are
   counted, and learns which of them other documents hold.
2. Each pack sends the surroundings of those anchors (up to LEAST bytes to either side, so that every window that
   holds the anchor is inside), once each however many of its documents hold them, with the smallest such document.
3. The suffixes of all surroundings of an anchor form an enhanced suffix array, in which a surrounding that several
   documents hold counts as several suffixes; the common-prefix interval tree gives the maximal repeats of at least
   LEAST bytes. A group names its length, its smallest document and its occurrences as (pack, surrounding, place).
4. Groups go back to the packs, which know the documents of each surrounding; occurrences outside a group's smallest
   document are removed. No byte is removed but through a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.kernels import BYTE_VALUE, blocks, mix, prefix_hash, range_hash, utf8
from tidebook.llm.runtime import partitions, returns_memory, small_batches, written
from tidebook.llm.suffix_array import NOTHING, intervals

LEAST = 50
K = 16
SIDE = LEAST - K
PACK_BYTES = 1 << 20
#: Parts of the anchors' hashes for each shuffle partition, at least, and surroundings of a part.
PARTS = 6
PER_PART = 250_000
#: Longest stretch hashed at once: positions within it fit PLACE_BITS.
PLACE_BITS = 21
STRETCH = 1 << 18
_options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


@returns_memory
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, _ in blocks(batch, "text", PACK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=_options) as out:
                out.write_batch(part)
            raw = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(raw) - 2**63], pa.int64()), pa.array([raw], pa.binary())], ["pack", "rows"])


def _unpack(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches()[0]


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, text and k-gram hash of every anchor of the concatenated texts, in order of place."""
    places, owners, hashes = [], [], []
    a, n = 0, len(off) - 1
    while a < n:  # whole texts up to STRETCH bytes, or stretches of a longer one that share LEAST - 1 bytes
        if off[a + 1] - off[a] > STRETCH:
            for lo in range(int(off[a]), int(off[a + 1]) - LEAST + 1, STRETCH - LEAST + 1):
                hi = min(lo + STRETCH, int(off[a + 1]))
                p, h = _anchors(buf[lo:hi], np.array([0, hi - lo]))
                places.append(p + lo)
                owners.append(np.full(len(p), a))
                hashes.append(h)
            a += 1
            continue
        b = max(a + 1, int(np.searchsorted(off, off[a] + STRETCH, "right")) - 1)
        b = min(b, n)
        p, h = _anchors(buf[off[a] : off[b]], off[a : b + 1] - off[a])
        places.append(p + off[a])
        owners.append(np.searchsorted(off, p + off[a], "right") - 1)
        hashes.append(h)
        a = b
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, owner, h = np.concatenate(places), np.concatenate(owners), np.concatenate(hashes)
    once = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    return place[once], owner[once], h[once]


def _anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(buf)
    if size < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = prefix_hash(BYTE_VALUE[buf])
    grams = size - K + 1
    at = np.arange(grams)
    with np.errstate(over="ignore"):
        h = mix(range_hash(c, at, at + K))
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (h & ~low) | at.astype(np.uint64)
    width, target = 1, LEAST - K + 1
    while 2 * width <= target:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < target:
        more = target - width
        least = np.minimum(least[:-more], least[more:])
    # windows that begin in a text and end in it
    whole = np.zeros(size + 1, np.int32)
    lengths = np.diff(off)
    long = lengths >= LEAST
    np.add.at(whole, off[:-1][long], 1)
    np.add.at(whole, off[1:][long] - LEAST + 1, -1)
    inside = np.cumsum(whole)[: len(least)] > 0
    place = (least[inside] & low).astype(np.int64)
    if len(place):
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    return place, h[place]


_KEY = (1 << 48) - 1


def _six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _identified(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, ids and which rows have an id."""
    buf, off = utf8(batch.column("text"))
    ids = batch.column("doc_id")
    return buf, off, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


def _own_anchors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, off, ids, known = _identified(batch)
    place, owner, h = anchors(buf, off)
    keep = known[owner] if len(owner) else np.zeros(0, bool)
    return buf, off, ids, place[keep], owner[keep], h[keep]


def _announce(n: int) -> Callable:
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, raw in zip(batch.column("pack").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                _, _, ids, _, owner, h = _own_anchors(_unpack(raw))
                if not len(h):
                    continue
                order = np.lexsort((ids[owner], h))
                h, doc = h[order], ids[owner][order]
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                several = np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)
                h = h[start]
                part = ((h >> np.uint64(48)) % np.uint64(n)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, h, several = part[order], h[order], several[order]
                cut = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist(), len(part)]
                rows = [(int(part[a]), pack, _six(h[a:b] & np.uint64(_KEY)), np.packbits(several[a:b]).tobytes()) for a, b in zip(cut, cut[1:])]  # noqa: B905
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "pack", "keys", "several"])

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one part at a time, of rows sorted by part."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[-1]["part"] != row["part"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


@returns_memory
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of each pack's anchors another document holds, a part of the anchors' hashes at a time."""
    for rows in _by_part(batches):
        keys = [_from_six(r["keys"]) for r in rows]
        several = [k[np.unpackbits(np.frombuffer(r["several"], np.uint8))[: len(k)].astype(bool)] for r, k in zip(rows, keys, strict=True)]
        every = np.sort(np.concatenate(keys + several))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        if not len(twice):
            continue
        packs, found = [], []
        for r, k in zip(rows, keys, strict=True):
            at = np.searchsorted(twice, k)
            at[at == len(twice)] = 0
            own = k[twice[at] == k]
            if len(own):
                packs.append(r["pack"])
                found.append(_six(own))
        yield pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array(found, pa.binary())], ["pack", "keys"])


def _hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges whose starts and ends ascend, a stretch of the buffer at a time."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + STRETCH, "right")))
        base = start[a]
        out[a:b] = range_hash(prefix_hash(BYTE_VALUE[buf[base : end[b - 1]]]), start[a:b] - base, end[a:b] - base)
        a = b
    return out


def _classes(h: np.ndarray, alike: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the number of its class of equal surroundings of one anchor, the rows by class, and where classes
    begin among them."""
    order = np.lexsort((alike, h))
    first = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (alike[order][1:] != alike[order][:-1])])
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(first) - 1
    return number, order, np.flatnonzero(first)


def _gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, concatenated."""
    ends = np.cumsum(length)
    return buf[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)]


def _alike(buf: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each surrounding and of the anchor's place in it."""
    with np.errstate(over="ignore"):
        return mix(_hash_ranges(buf, start, start + length) + place.astype(np.uint64) * np.uint64(1 << 20) + length.astype(np.uint64))


def _surroundings(rows: pa.RecordBatch, lists: list[bytes]):
    """Of a pack's shared anchors: bytes, offsets, document and place of each surrounding, the anchor's hash and place
    in it, and the classes of equal ones."""
    buf, off, ids, place, owner, h = _own_anchors(rows)
    keep = np.isin(h & np.uint64(_KEY), np.concatenate([_from_six(x) for x in lists]))
    place, owner, h = place[keep], owner[keep], h[keep]
    if not len(h):
        return None
    lo, hi = np.maximum(off[owner], place - SIDE), np.minimum(off[owner + 1], place + LEAST)
    return buf, off, ids[owner], lo, hi, h, place - lo, _classes(h, _alike(buf, lo, hi - lo, place - lo))


_SURROUND = "part int, pack long, h binary, number binary, doc binary, several binary, length binary, place binary, bytes binary"


def _surround(n: int) -> Callable:
    names = [c.split(" ")[0] for c in _SURROUND.split(", ")]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 7

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, raw, lists in zip(*(batch.column(c).to_pylist() for c in ("pack", "rows", "keys")), strict=True):
                found = _surroundings(_unpack(raw), lists) if lists else None
                if found is None:
                    continue
                buf, _, doc, lo, hi, h, place, (_, order, first) = found
                least, most = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
                one = order[first]  # one surrounding of each class
                part = ((h[one] >> np.uint64(48)) % np.uint64(n)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                cut = [*np.flatnonzero(np.concatenate([[True], part[by][1:] != part[by][:-1]])).tolist(), len(part)]
                rows = []
                for a, b in zip(cut, cut[1:]):  # noqa: B905
                    c = by[a:b][np.argsort(lo[one[by[a:b]]])]
                    i = one[c]
                    size = hi[i] - lo[i]
                    numbers = (c.astype(np.int32), np.diff(least[c], prepend=0), np.packbits(least[c] < most[c]), size.astype(np.uint8), place[i].astype(np.uint8), _gather(buf, lo[i], size))
                    rows.append((int(part[c[0]]), pack, _six(h[i] & np.uint64(_KEY)), *(_squeeze(x.tobytes()) for x in numbers)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _repeats(buf: np.ndarray, start: np.ndarray, length: np.ndarray, h: np.ndarray, place: np.ndarray, doc: np.ndarray, several: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal repeats among distinct surroundings of equal anchors, as (surrounding, place, length, smallest document)
    of each occurrence that isn't the smallest document's alone. ``before``: how many bytes before the anchor the
    suffixes begin that count here.

    ``doc`` is a surrounding's smallest document, ``several`` whether others hold it too. Suffixes can only share LEAST
    bytes if they begin at the same distance from their anchor, and those that do are neighbours by a hash of these
    bytes; the array orders each such group by the bytes that follow. Left out beforehand are suffixes that one
    document alone holds, and groups before which all have the same byte: a longer repeat to the left holds them. A
    suffix alone in its group, held by several documents, is a leaf whose copies make an interval of their own."""
    shift = place[:, None] - before[None, :]
    seg, which = np.nonzero((shift >= 0) & (length[:, None] - shift >= LEAST))
    none = (np.zeros(0, np.int64),) * 4
    if not len(seg):
        return none
    shift = shift[seg, which]
    at = start[seg] + shift
    c = prefix_hash(BYTE_VALUE[buf])
    with np.errstate(over="ignore"):
        key = mix(range_hash(c, at, at + LEAST) + h[seg] * np.uint64(0x9E3779B97F4A7C15) + before[which].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    size = np.diff(np.append(first, len(order)))
    left = np.where(shift > 0, buf[at - 1].astype(np.int64), NOTHING)
    d, x = doc[seg][order], left[order]
    low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    shared = np.logical_or.reduceat(several[seg][order], first) | (np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first))
    wanted = shared & ((low != high) | (low == NOTHING))
    leaf = order[first[wanted & (size == 1)]]
    out = [np.column_stack([seg[leaf], shift[leaf], (length[seg] - shift)[leaf], doc[seg][leaf]])]
    wanted &= size > 1
    chosen = order[np.repeat(wanted, size)]
    if len(chosen):
        group = np.repeat(np.arange(int(wanted.sum())), size[wanted])
        room = (length[seg] - shift)[chosen]
        width = -(-int(room.max()) // 8) * 8
        cells = np.zeros((len(chosen), width), np.uint8)
        columns = np.arange(width)
        mask = columns < room[:, None]
        cells[mask] = buf[np.minimum(at[chosen][:, None] + columns, len(buf) - 1)[mask]]
        rows = cells.view(">u8").astype(np.uint64)[:, LEAST // 8 :]  # the bytes before are the group's
        by = np.lexsort((*rows.T[::-1], group))
        cells, chosen, room, group = cells[by], chosen[by], room[by], group[by]
        differ = cells[1:] != cells[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common = np.minimum(common, np.minimum(room[1:], room[:-1]))
        common = np.concatenate([[0], np.where(group[1:] == group[:-1], common, 0)])
        docs, many, lefts = doc[seg[chosen]], several[seg[chosen]], left[chosen]
        found = [(n, a, b) for n, a, b in intervals(common, lefts, LEAST)]
        # copies of a whole suffix that nothing stands before are an interval of their own
        longest = np.maximum(common, np.append(common[1:], 0))
        found += [(int(room[k]), k, k) for k in np.flatnonzero(many & (lefts == NOTHING) & (room > longest)).tolist()]
        if found:
            n, a, b = np.array(found, np.int64).T
            least = np.array([docs[i : j + 1].min() for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            k = _gather(np.arange(len(chosen)), a, b - a + 1)
            n, least = np.repeat(n, b - a + 1), np.repeat(least, b - a + 1)
            keep = (docs[k] > least) | many[k]
            out.append(np.column_stack([seg[chosen[k]], shift[chosen[k]], n, least])[keep])
    return tuple(np.concatenate(out).T)


#: Surroundings whose suffixes are sorted at once.
AT_ONCE = 6_000
_FIELDS = {"number": np.int32, "doc": np.int64, "several": np.uint8, "length": np.uint8, "place": np.uint8, "bytes": np.uint8}


@returns_memory
def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups' occurrences by pack, a part of the anchors' hashes at a time: numbers of surroundings, places in
    them, lengths, and the groups' smallest documents."""
    for rows in _by_part(batches):
        found = _settled(rows)
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["pack", "groups"])


def _settled(rows: list[dict]) -> list[tuple[int, bytes]]:
    fields: dict[str, list] = {k: [] for k in ("pack", "h", *_FIELDS)}
    for row in rows:
        h = _from_six(row["h"])
        fields["pack"].append(np.full(len(h), row["pack"], np.int64))
        fields["h"].append(h)
        for k, t in _FIELDS.items():
            x = np.frombuffer(_expand(row[k]), t)
            fields[k].append(np.cumsum(x) if k == "doc" else np.unpackbits(x)[: len(h)].astype(bool) if k == "several" else x if k == "bytes" else x.astype(np.int64))
    pack, h, own, doc, several, length, place, buf = (np.concatenate(fields.pop(k)) for k in list(fields))
    at = np.cumsum(length) - length
    number, order, first = _classes(h, _alike(buf, at, length, place))
    least = np.minimum.reduceat(doc[order], first)
    several = np.logical_or.reduceat(several[order], first) | (least < np.maximum.reduceat(doc[order], first))
    one = order[first]  # a surrounding of each class, by anchor
    h, at, length, place = h[one], at[one], length[one], place[one]
    # an anchor counts if several documents hold it, in one surrounding or in several
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    counts = np.diff(np.append(begin, len(h)))
    keep = np.flatnonzero(np.repeat((counts > 1) | several[begin], counts))
    found, a, every = [], 0, np.arange(SIDE + 1)
    while a < len(keep):
        b = min(a + AT_ONCE, len(keep))
        while a < b < len(keep) and h[keep[b]] == h[keep[b - 1]] and h[keep[b]] != h[keep[a]]:
            b -= 1
        while b < len(keep) and h[keep[b]] == h[keep[b - 1]]:
            b += 1
        i = keep[a:b]
        ends = np.cumsum(length[i])
        got = (_gather(buf, at[i], length[i]), ends - length[i], length[i], h[i], place[i], least[i], several[i])
        # an anchor in very many surroundings: suffixes of one distance from it at a time
        for before in np.array_split(every, 1 if len(i) <= 2 * AT_ONCE else len(every)):
            seg, shift, size, smallest = _repeats(*got, before)
            found.append((i[seg], shift, size, smallest))
        a = b
    if not found:
        return []
    cls, shift, size, smallest = (np.concatenate(x) for x in zip(*found, strict=True))
    members = np.diff(np.append(first, len(order)))
    row = order[_gather(np.arange(len(order)), first[cls], members[cls])]
    shift, size, smallest = (np.repeat(x, members[cls]) for x in (shift, size, smallest))
    by = np.lexsort((own[row], pack[row]))
    row, shift, size, smallest = row[by], shift[by], size[by], smallest[by]
    cut = [*np.flatnonzero(np.concatenate([[True], pack[row][1:] != pack[row][:-1]])).tolist(), len(row)] if len(row) else [0]
    return [(int(pack[row[x]]), _squeeze(np.diff(own[row[x:y]], prepend=0).astype(np.int32).tobytes() + shift[x:y].astype(np.uint8).tobytes() + size[x:y].astype(np.uint8).tobytes() + np.diff(smallest[x:y], prepend=0).astype(np.int64).tobytes())) for x, y in zip(cut, cut[1:])]  # noqa: B905


def _occurrences(rows: pa.RecordBatch, keys: list[bytes], groups: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in the pack's bytes, of each occurrence outside its group's smallest document."""
    _, _, doc, lo, _, _, _, (_, order, first) = _surroundings(rows, keys)
    members = np.diff(np.append(first, len(order)))
    starts, ends = [], []
    for raw in map(_expand, groups):
        n = len(raw) // 14
        number, shift, size, smallest = np.cumsum(np.frombuffer(raw, np.int32, n)), np.frombuffer(raw, np.uint8, n, 4 * n), np.frombuffer(raw, np.uint8, n, 5 * n), np.cumsum(np.frombuffer(raw[6 * n :], np.int64))
        i = order[_gather(np.arange(len(order)), first[number], members[number])]
        shift, size, smallest = (np.repeat(x.astype(np.int64), members[number]) for x in (shift, size, smallest))
        later = doc[i] > smallest
        starts.append((lo[i] + shift)[later])
        ends.append((lo[i] + shift + size)[later])
    return np.concatenate(starts), np.concatenate(ends)


def _cut(digests: bool, schema: pa.Schema) -> Callable:
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, keys, groups in zip(*(batch.column(c).to_pylist() for c in ("rows", "keys", "groups")), strict=True):
                rows = _unpack(raw)
                buf, off = utf8(rows.column("text"))
                change = np.zeros(len(buf) + 1, np.int32)
                if groups:
                    a, b = _occurrences(rows, keys, groups)
                    change += np.bincount(a, minlength=len(change)).astype(np.int32)
                    change -= np.bincount(b, minlength=len(change)).astype(np.int32)
                gone = np.cumsum(change)[:-1] > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                # a run ends with its document
                edge = off[1:-1][off[1:-1] < len(buf)]
                begins[edge] |= gone[edge]
                n_gone, n_begins = (np.concatenate([[0], np.cumsum(x)])[off] for x in (gone, begins))
                kept, at = buf[~gone], off - n_gone
                if digests:
                    whole = kept.tobytes()
                    shas = [hashlib.sha256(whole[at[i] : at[i + 1]]).hexdigest() for i in range(len(off) - 1)]
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(off)), pa.array(np.diff(n_gone)), pa.array(np.diff(n_begins)), pa.array(shas)], schema=schema)
                    continue
                whole = kept.tobytes()
                texts = [whole[at[i] : at[i + 1]].decode(errors="ignore") if n else t for i, (n, t) in enumerate(zip(np.diff(n_gone).tolist(), rows.column("text").to_pylist(), strict=True))]
                columns = [pa.array(texts, pa.string()) if c == "text" else rows.column(c) for c in rows.schema.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(n_gone)), pa.array(np.diff(n_begins))], schema=schema)

    return run


def without_repeats(docs: DataFrame, digests: bool = False) -> DataFrame:
    """Remove from each document every byte covered by a 50-byte string that also starts in a document with a smaller
    doc_id, judged on the input. ``docs`` has doc_id and text (and any other columns but n_removed and n_spans).

    Returns the rows with text cut (code points that lose bytes go whole), n_removed bytes and n_spans, the maximal
    removed runs; with ``digests`` doc_id, n_bytes, n_removed, n_spans and kept_sha256, of the bytes that stay.

    Null texts count as empty and stay null; rows without an id are neither cut nor sources; rows of equal doc_id are
    one document, in which repeats stay; texts under 50 bytes never change; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text") if digests else docs
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    n = partitions(spark)
    parts = n * PARTS  # a task takes its parts one after the other, so it holds one at a time
    packs = docs.mapInArrow(_pack, "pack long, rows binary").repartition(n, "pack")
    shared = packs.mapInArrow(_announce(parts), "part int, pack long, keys binary, several binary").repartition(n, "part").sortWithinPartitions("part").mapInArrow(_shared, "pack long, keys binary")
    shared = written(shared.groupBy("pack").agg(F.collect_list("keys").alias("keys")), "shared")
    size = shared.agg(F.sum(F.aggregate("keys", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)))).first()[0] or 0
    parts = max(parts, -(-size // (6 * PER_PART)))
    # left joins leave the packs as they are, so that their one shuffle serves all three steps
    around = packs.join(shared, "pack", "left").select("pack", "rows", "keys").mapInArrow(_surround(parts), _SURROUND)
    groups = around.repartition(max(n, -(-parts // PARTS)), "part").sortWithinPartitions("part").mapInArrow(_settle, "pack long, groups binary")
    groups = groups.groupBy("pack").agg(F.collect_list("groups").alias("groups"))
    both = packs.join(shared, "pack", "left").join(groups, "pack", "left").select("rows", "keys", "groups")
    if digests:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])
    else:
        schema = T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])
    return both.mapInArrow(_cut(digests, to_arrow_schema(schema)), schema)
