"""The pipeline against its stages' brute-force forms."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import words
from tokenizers import Tokenizer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def one_of_each(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [(i, t) for i, t in rows if top(i) == i]


def without_passages(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        grams = [b[p : p + 50] for p in range(len(b) - 49)]
        for p, g in enumerate(grams):
            if g in seen:
                gone[p : p + 50] = True
        seen.update(grams)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]).decode(errors="ignore")
        if not gone.any() or kept:
            out.append((i, kept))
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    shared = words(900, 70)
    good = [(i, words(i, 120) + "." + (f"\n{shared}" if i % 4 == 0 else "")) for i in range(80)]
    copies = [(100 + i, t.replace("an", "AN", 2)) for i, t in good[:15]] + [(200 + i, good[i][1]) for i in range(5)]
    bad = [(300 + i, " ".join(w.upper() + "!!" for w in words(i + 5000, 60).split())) for i in range(60)]
    odd = [(400, None), (401, ""), (402, shared)]
    rows = good + copies + bad + odd
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_run(spark, corpus):
    import corpus_pipeline as cp

    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(cp.STAGES)
    accepted = stages["quality_classifier"](spark, docs, folder)
    assert accepted.columns == docs.columns
    ids = {r.doc_id for r in accepted.collect()}
    assert {i for i, _ in rows if i < 300} <= ids and not ids & set(range(300, 360))
    want = one_of_each([(i, t) for i, t in rows if i in ids])
    kept = stages["minhash_near_dedup"](spark, accepted, folder)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in want}
    want = dict(without_passages(want))
    cut = stages["suffix_array_dedup"](spark, kept, folder)
    assert cut.columns == docs.columns
    got = {r.doc_id: r.text or "" for r in cut.collect()}
    assert got == want and all(r.n_chars == len(r.text or "") for r in cut.collect())
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = cp.run(spark, folder).collect()
    ids_of = {i: [*lib.encode(t, add_special_tokens=False).ids, 1] for i, t in want.items()}
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in out) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids_of.items())
    fills = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 4096


def test_stage_order():
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
