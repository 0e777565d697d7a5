"""All removals come through the array's groups; hot anchors; many surroundings of one anchor."""

import hashlib
import random

import numpy as np
import pytest
from tests.llm.conftest import words
from tidebook.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    for i, t in sorted(rows):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = {}
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        out[i] = (int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def corpus():
    rng, line = random.Random(3), words(77, 14)
    rows = [(i, words(i, 20) + rng.choice([" ", "\n"]) + line[rng.randrange(20) :] + " " + words(1000 + i, 12)) for i in range(300)]
    rows += [(300 + i, words(7, 60)) for i in range(40)] + [(400 + i, words(7, 58) + f" {i}") for i in range(40)]
    rows += [(500, "ab" * 400), (501, "ab" * 200 + "c" + "ab" * 200), (502, "x" * 49), (503, "x" * 120), (504, "x" * 60)]
    return rows


def cut(spark, rows):
    return {r.doc_id: (r.n_removed, r.kept_sha256) for r in sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), digests=True).collect()}


def test_hot_anchors_and_copies(spark):
    rows = corpus()
    assert cut(spark, rows) == brute(rows)


@pytest.mark.parametrize("at_once", [1, 40])
def test_one_distance_at_a_time(at_once, monkeypatch):
    """However few surroundings are sorted at once, the groups stay the same."""
    texts = [t.encode() for _, t in corpus()]

    def groups():
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array([t.decode() for t in texts])})
        raw = next(iter(sd._pack(iter([batch])))).column("rows")[0].as_py()
        keys = [sd._six(np.unique(sd._own_anchors(sd._unpack(raw))[5] & np.uint64(sd._KEY)))]
        rows = next(iter(sd._surround(1)(iter([pa.RecordBatch.from_pydict({"pack": pa.array([5]), "rows": pa.array([raw]), "keys": pa.array([keys])})]))))
        got = sd._settled(rows.to_pylist())
        a, b = sd._occurrences(sd._unpack(raw), keys, [g for _, g in got])
        return set(zip(a.tolist(), b.tolist(), strict=True))

    whole = groups()
    monkeypatch.setattr(sd, "AT_ONCE", at_once)
    assert groups() == whole and whole


def test_nothing_is_removed_without_groups(spark, monkeypatch):
    """Copies too are removed only through the array."""
    import pyarrow as pa

    rows = [(i, words(7, 60)) for i in range(4)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows]), "text": pa.array([t for _, t in rows])})
    raw = next(iter(sd._pack(iter([batch])))).column("rows")[0].as_py()
    keys = [sd._six(np.unique(sd._own_anchors(sd._unpack(raw))[5] & np.uint64(sd._KEY)))]
    around = next(iter(sd._surround(1)(iter([pa.RecordBatch.from_pydict({"pack": pa.array([5]), "rows": pa.array([raw]), "keys": pa.array([keys])})])))).to_pylist()
    assert sd._settled(around)
    monkeypatch.setattr(sd, "_repeats", lambda *_: (np.zeros(0, np.int64),) * 4)
    assert sd._settled(around) == []
