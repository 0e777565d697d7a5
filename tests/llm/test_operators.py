"""Every text operator against brute force on a small table with nulls, empties, long texts, ties and repeated rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tests.llm.conftest import odd_rows
from tokenizers import Tokenizer

ROWS = [(i, t) for i, t, *_ in odd_rows()]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets():
    out = []
    for _, t in ROWS:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def test_near_duplicates(odd, empty):
    from tidebook.llm.minhash import near_duplicates

    shingles = sets()
    near = defaultdict(set)
    for (i, _), a in zip(ROWS, shingles, strict=True):
        for (j, _), b in zip(ROWS, shingles, strict=True):
            if i is not None and j is not None and a and 100 * len(a & b) >= 75 * len(a | b):
                near[i].add(j)

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    want = sorted([(i, len(s), None if i is None else least(i), i is None or least(i) == i) for (i, _), s in zip(ROWS, shingles, strict=True)], key=str)
    got = sorted([tuple(r) for r in near_duplicates(odd).collect()], key=str)
    assert got == want
    assert near_duplicates(empty).count() == 0


def test_chains_that_pivots_miss(spark):
    """Long chains of near-duplicates: neighbours are linked, ends are not."""
    from tests.llm.conftest import words
    from tidebook.llm.minhash import near_duplicates

    base = words(4, 400).split()
    rows = [(k, " ".join(base[:10 * (40 - k)] + [f"w{k}x{j}" for j in range(3)] + base[10 * (40 - k):])) for k in range(40)]
    step = [(100 + k, " ".join(base[6 * k : 6 * k + 120])) for k in range(40)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows + step, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(40)} == {0}
    assert {got[100 + k] for k in range(40)} == {100}


def test_components(spark):
    from tidebook.llm.components import connected_components

    edges = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 70), (70, 50), (80, 80), (None, 3), (5, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 60: 50, 70: 50}


def brute_cut():
    ids = sorted({i for i, _ in ROWS if i is not None})
    grams = {i: {(t or "").encode()[p : p + 50] for j, t in ROWS if j == i for p in range(len((t or "").encode()) - 49)} for i in ids}
    out = []
    for i, t in ROWS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            before = set().union(*[grams[j] for j in ids if j < i])
            for p in range(len(b) - 49):
                if b[p : p + 50] in before:
                    gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(odd, empty):
    from tidebook.llm.suffix_dedup import without_repeats

    assert sorted([tuple(r) for r in without_repeats(odd, digests=True).collect()], key=str) == brute_cut()
    whole = without_repeats(odd.drop("spans")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in whole) == sorted((str(x[0]), x[2]) for x in brute_cut())
    assert without_repeats(empty, digests=True).count() == 0


def test_maximal_repeats_by_brute_force():
    import random

    from tidebook.llm.suffix_array import maximal_repeats

    rng = random.Random(3)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 4))]
        places = defaultdict(set)
        for k, t in enumerate(texts):
            for a in range(len(t)):
                for b in range(a + 1, len(t) + 1):
                    places[t[a:b]].add((k, a))
        want = set()
        for s, at in places.items():
            if len(at) > 1 and len(s) >= 2:
                right = {texts[k][a + len(s) : a + len(s) + 1] or (k, a) for k, a in at}
                left = {texts[k][a - 1 : a] if a else (k, a) for k, a in at}
                if len(right) > 1 and len(left) > 1:
                    want.add((len(s), tuple(sorted(at))))
        assert {(n, tuple(at)) for n, at in maximal_repeats(texts, 2)} == want


def test_quality(spark, odd, empty):
    from tidebook.llm.quality import accepted, quality_scores

    good = [(100 + i, " ".join(f"word{(i * j) % 17} and" for j in range(1, 30)) + ".") for i in range(60)]
    bad = [(200 + i, " ".join(f"W{(i * j) % 13}!!" for j in range(1, 30))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == 120 + len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [(r.score, r.doc_id < 200) for r in rows if r.held_out and r.doc_id >= 100]
    assert len(unseen) > 10 and all((s >= 0.7) == g for s, g in unseen)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    none = quality_scores(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_scores(empty, labels).count() == 0
    assert accepted(odd, labels.limit(0)).count() == 0 and accepted(odd, labels.limit(0), threshold=0.5).columns == odd.columns


def test_held_out_labels_do_not_train(spark):
    from tidebook.llm.quality import quality_scores

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, f"good text {i % 7}" if i % 2 else f"BAD!! {i % 5}") for i in range(400)], "doc_id long, text string")
    one = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    two = spark.createDataFrame([(i, (i + (i in set(held))) % 2) for i in range(400)], "doc_id long, quality int")
    assert sorted(map(tuple, quality_scores(docs, one).collect())) == sorted(map(tuple, quality_scores(docs, two).collect()))


def test_sentencepieces(odd, empty):
    from tidebook.llm.sentencepieces import encoded

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted([(r.doc_id, list(r.ids), r.decoded) for r in encoded(odd, path).collect()], key=str)
    assert got == sorted([(i, sp.encode(t or ""), t or "") for i, t in ROWS], key=str)
    digests = encoded(odd, path, digests=True).collect()
    assert all(r.round_trip for r in digests)
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(np.array(sp.encode(t or ""), "<u4").tobytes()) for _, t in ROWS)
    assert encoded(empty, path).count() == 0


def test_unigram_shortest_path():
    from tidebook.llm.sentencepieces import Model, PieceTransducer

    m = Model.__new__(Model)
    m.kind, m.dummy_prefix, m.trims, m.unknown, m.byte_ids, m.rules = "unigram", True, False, 0, None, {}
    m.pieces, m.scores, m.types = ["<unk>", "▁a", "b", "▁ab", "c", "bc", "▁"], [0, -1.0, -1.0, -2.5, -3.0, -1.5, -9.0], [2, 1, 1, 1, 1, 1, 1]
    m.normal = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == 1}
    t = PieceTransducer(m)
    ids = lambda s: np.frombuffer(t.encode(s), np.uint32).tolist()
    assert ids("abc") == [1, 5] and ids("ab") == [1, 2] and ids("") == [] and ids("zzb") == [6, 0, 2]


def test_fingerprints(odd, empty):
    from tidebook.llm.fingerprints import WORDS, fingerprints

    cut = re.compile(rf"[^ \t\n\x0b\x0c\r]{{1,64}}(?:[ \t\x0b\x0c\r]+[^ \t\n\x0b\x0c\r]{{1,64}}){{0,{WORDS - 1}}}")
    order = sorted(((i, t or "") for i, t in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        a, b, c = (set(cut.findall(x)) for x in (t, edited, following))
        like = [1.0 if not x and not y else round(1 - len(x ^ y) / (len(x) + len(y)), 9) for x, y in ((a, b), (a, c))]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *like))
    rows = fingerprints(odd).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows], key=str) == sorted(want, key=str)
    prints = defaultdict(set)
    for r in rows:
        prints[dict(order).get(r.doc_id)].add(r.fingerprint)
    assert all(len(p) == 1 for t, p in prints.items() if t is not None)
    assert fingerprints(empty).count() == 0


def test_sketch_retries_larger(spark):
    """A difference far beyond the smallest sketch is recovered whole."""
    from pyspark.sql import functions as F

    from tidebook.llm.fingerprints import SIZES, sketch, with_difference

    a, b = list(range(0, 900)), list(range(450, 1200))
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(*[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"])
    df = df.withColumns({"ca": sketch(F.col("a"), SIZES[0]), "cb": sketch(F.col("b"), SIZES[0])})
    row = with_difference(df, "d", "a", "b", "ca", "cb").select("a", "b", "d").first()
    assert not row.d.cells
    assert {(f.s, f.k) for f in row.d.found} == {(1, k) for k in set(row.a) - set(row.b)} | {(-1, k) for k in set(row.b) - set(row.a)}


def test_media(odd, empty):
    from tidebook.llm.matroska import media_round_trip

    rows = media_round_trip(odd).collect()
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows], key=str) == sorted(want, key=str)
    assert media_round_trip(empty).count() == 0


@pytest.mark.parametrize("lacing", ["none", "fixed", "ebml", "xiph"])
def test_lacing(lacing):
    from tidebook.llm import matroska as m

    frames = [b"x" * 300] if lacing == "none" else [b"ab" * 50] * 4 if lacing == "fixed" else [b"a" * 600, b"b" * 20, b"c" * 255, b"", b"d" * 9000]
    body = m.number(m.TIMESTAMP, 70) + m.element(m.SIMPLE, m._block(-3, frames, 2, lacing)) + m.element(m.GROUP, m.element(m.BLOCK, m._block(5, [b"zz"], 1, "none")))
    raw = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm")) + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + m.element(0xEC, b"void") + bytes.fromhex("1F43B675") + b"\xff" + body
    media = m.parse(raw)
    assert media.doc_type == "webm" and m.samples(raw, media, 2) == b"".join(frames) and m.samples(raw, media, 1) == b"zz"
    assert [(t, key) for n, t, _, _, key in media.packets if n == 2] == [(67_000_000, True)] * len(frames)
    with pytest.raises(ValueError):
        m.parse(raw[:40] + b"\x00" * 10)


def test_cues_point_at_clusters():
    from tidebook.llm import matroska as m

    payload = bytes(range(256)) * 3000
    raw = m.store(payload)
    media = m.parse(raw)
    assert m.samples(raw, media) == payload and len(media.cues) == 3
    assert all(raw[at : at + 4] == bytes.fromhex("1F43B675") for _, _, at in media.cues)
    assert [t for _, t, *_ in media.packets] == [k * 8_000_000 for k in range(len(media.packets))]
    assert media.tracks[1] | {"rate": 0} == {"number": 1, "type": 2, "codec": "A_PCM/INT/LIT", "rate": 0, "channels": 1, "bits": 8}


def test_packing(odd, empty):
    from tidebook.llm.packing import packed

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = packed(odd, path).collect()
    want = []
    for i, t in ROWS:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, a // 4096, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for a in range(0, len(ids), 4096)]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == sorted(want, key=str)
    full = defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(full) == -(-sum(w[3] for w in want) // 4096)
    assert packed(empty, path).count() == 0


def test_best_fit_decreasing():
    from tidebook.llm.packing import best_fit

    bins, offsets, fills = best_fit(np.array([6, 5, 4, 3, 2, 10, 1]), 10)
    assert fills.tolist() == [10, 10, 10, 1] and offsets[5] == 0 and len(set(bins[[0, 2]])) == 1


def test_token_files(spark, odd, empty):
    from tidebook.llm.runtime import new_path
    from tidebook.llm.token_files import read_token_files, token_file_round_trip, write_token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    order = sorted(((i, t or "") for i, t in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, at = [], 0
    for i, t in order:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted([tuple(r) for r in token_file_round_trip(odd, path).collect()], key=lambda r: r[1]) == want
    folder = new_path(spark, "tokens")
    manifest = write_token_files(odd, folder, path, 0)
    assert {m[3] for m in manifest} == {2} and sum(m[2] for m in manifest) == at
    assert sum(len(r.ids) for r in read_token_files(spark, folder, manifest).collect()) == at
    assert token_file_round_trip(empty, path).count() == 0


def test_token_counts(odd, empty):
    from tidebook.llm.token_counts import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = []
    for i, t in ROWS:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted([tuple(r) for r in token_counts(odd, path).collect()], key=str) == sorted(want, key=str)
    assert token_counts(empty, path).count() == 0


def test_chat(spark):
    from tidebook.llm.chat import escape, formatted, render, unescape

    extra = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", extra, 1), (-7, 1, "assistant", extra, 1), (1, 1, "assistant", None, 1), (1, 0, None, "a\\b<|im_end|>\n", 1), (2, 0, "as\nsistant", "", 1), (2, 0, "as\nsistant", "", 1), (None, 0, "assistant", "é🙂\\[INST]", 1), (3, None, "assistant", "x" * 90_000, 1), (3, 5, "assistant", "\\", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in formatted(df, digests=True).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r for r in formatted(df).collect()}
    spans = whole[-7].loss_spans
    assert unescape(whole[-7].formatted[spans[0].start : spans[0].end]) == extra
    assert "[INST]" not in whole[-7].formatted and all(unescape(escape(t)) == t for t in ("\\", "[\\INST]", "<<SYS>>", "<s></s>", "\\n"))
    late = render([("user", "a"), ("assistant", "b"), ("user", "c")], lambda turns: "".join(f"[{r}]{t if k == len(turns) - 1 else t.upper()};" for k, (r, t) in enumerate(turns)))
    assert late.rewritten == [1, 2] and late.spans == []
    assert formatted(df.limit(0), digests=True).count() == 0


def test_queries_run(spark):
    from tests.conftest import SMALL
    from tidebook.llm.queries import QUERIES

    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 11))
    assert QUERIES["op7_matroska"](spark, SMALL).count() == 200


def test_anchors_of_long_texts_do_not_depend_on_stretches(monkeypatch):
    from tidebook.llm import suffix_dedup

    rng = np.random.default_rng(0)
    buf = rng.integers(97, 101, 120_000).astype(np.uint8)
    buf[30_000:30_400] = 97
    off = np.array([0, 10, 49, 99, 110_000, 120_000])
    whole = suffix_dedup.anchors(buf, off)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 10_000)
    assert all(np.array_equal(a, b) for a, b in zip(whole, suffix_dedup.anchors(buf, off), strict=True))
    places = np.concatenate([whole[0], [10**9]])
    starts = np.concatenate([np.arange(off[k], off[k + 1] - 49) for k in range(5) if off[k + 1] - off[k] >= 50])
    assert (places[np.searchsorted(places, starts)] <= starts + 50 - suffix_dedup.K).all()
