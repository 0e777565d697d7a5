"""Links that pivots miss, large mixed buckets, hot classes, repeated ids."""

import random
import re

import pytest
from tests.llm.conftest import words
from tidebook.llm import minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    root = {i: i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def look_alikes(n: int, per: int):
    """Documents that share much of one template, in chains of near-duplicates: many components in each bucket."""
    rng, base, rows = random.Random(5), words(40, 120).split(), []
    for g in range(n):
        own = base[:]
        for p in rng.sample(range(120), 8):
            own[p] = f"g{g}x{p}"
        for k in range(per):
            mine = own[:]
            for p in range(k, 120, 60):
                mine[p] = f"d{g}y{k}z{p}"
            rows.append((1000 * g + k, " ".join(mine)))
    return rows


@pytest.mark.parametrize(("block", "many", "salt"), [(512, 4096, 8192), (4, 4096, 8), (4, 6, 8)])
def test_mixed_buckets(spark, monkeypatch, block, many, salt):
    rows = look_alikes(14, 5)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "MANY", many)
    monkeypatch.setattr(minhash, "PER_SALT", salt)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_hot_class_and_repeated_ids(spark):
    base, other = words(50, 80), words(51, 80)
    rows = [(i, base) for i in range(5, 400)] + [(i, base.upper()) for i in range(400, 500)] + [(5, other), (900, other + " end"), (901, None), (901, base)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), text_hash=True).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.n_shingles} == {5}
    assert [(r.doc_id, r.component_id, r.kept) for r in got if not r.n_shingles] == [(901, 901, True)]
    assert len({r.text_hash for r in got if r.doc_id == 5}) == 2


def test_contracted():
    from tidebook.llm.components import contracted

    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    u, v = contracted(*zip(*edges, strict=True))
    groups = {}
    for a, b in edges:
        both = groups.get(a, {a}) | groups.get(b, {b})
        groups |= dict.fromkeys(both, both)
    assert dict(zip(u, v, strict=True)) == {x: min(g) for x, g in groups.items() if min(g) != x}
