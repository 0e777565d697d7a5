"""Repeat groups against the local suffix array of all texts, and the removals that follow from them."""

import random

from tests.llm.conftest import words
from tidebook.llm import repeat_groups as R
from tidebook.llm.suffix_array import maximal_repeats
from tidebook.llm.suffix_dedup import without_repeats


def _texts() -> dict[int, str]:
    rng = random.Random(4)
    long, passage = words(1, 900), words(2, 40)
    texts = {1: long, 2: long, 3: long[:2500] + "#" + long[2501:], 4: passage + " é " + words(3, 50), 5: words(4, 30) + passage, 6: passage[:-3] + "\x00\x00", 7: "", 8: passage[:-3] + "\x00", 9: "ab" * 60, 10: "b" + "ab" * 45}
    for i in range(11, 26):
        a, b = sorted(rng.sample(range(len(long)), 2))
        texts[i] = words(i, 5) + long[a:b] + passage[rng.randrange(60) :] + words(i + 50, 20)
    return texts


def _check(spark, texts):
    docs = spark.createDataFrame([*texts.items(), (None, texts[1]), (99, None)], "doc_id long, text string").repartition(3)
    rows = R.repeat_groups(docs).collect()
    groups: dict[int, list] = {}
    for r in rows:
        groups.setdefault((r.group_id, r.length), []).append((r.doc_id, r.start))
    ids = sorted(texts)
    want = []
    for n, places in maximal_repeats([texts[i].encode() for i in ids], R.LEAST):
        places = sorted((ids[i], p) for i, p in places)
        if places[0][0] != places[-1][0]:
            want.append((n, places))
    assert sorted((n, sorted(places)) for (_, n), places in groups.items()) == sorted(want) and len({g for g, _ in groups}) == len(groups)
    gone = {i: set() for i in ids}
    for (_, n), places in groups.items():
        for doc, p in places:
            if doc > min(places)[0]:
                gone[doc] |= set(range(p, p + n))
    cut = {r.doc_id: r.n_removed for r in without_repeats(docs.where("doc_id < 99"), digests=True).collect()}
    assert cut == {i: len(x) for i, x in gone.items()}


def test_all_groups_and_occurrences(spark):
    _check(spark, _texts())


def test_small_packs_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 16)
    monkeypatch.setattr(R, "AT_ONCE", 200)
    _check(spark, {i: t for i, t in _texts().items() if i < 16})
