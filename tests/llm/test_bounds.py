"""Former caps and switches, other file systems, the registered queries themselves."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
import pytest
from tests.llm.conftest import words


def test_packing_in_bounded_groups(spark, monkeypatch):
    """Many partitions, few bins a group: several merge rounds, gapless sequences, near the lower bound."""
    from tidebook.llm import packing

    monkeypatch.setattr(packing, "GROUP_ITEMS", 6)
    docs = spark.createDataFrame([(i, words(i, 30 + 97 * i % 900)) for i in range(150)], "doc_id long, text string").repartition(40)
    rows = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    full = defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r.length for r in rows) // 4096)
    assert len({r.doc_id for r in rows}) == 150 and least <= len(full) <= 1.2 * least + 1


def test_training_by_brute_force():
    """Weights equal a plain loop over all coordinates with the published update rule."""
    from tidebook.llm import quality as q

    texts = [words(i, 12) + ("." if i % 2 else "!!") for i in range(30)]
    rows = []
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        rows.append((q.features(raw, np.array([0, len(raw)]))[0], i % 2))
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(max(q.PASSES, -(-q.LEAST_UPDATES // len(rows)))):
        for index, label in rows:
            x = defaultdict(float, {1 << q.BITS: 1.0})
            for i in index.tolist():
                x[i] += q.SCALE / len(index)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA
                z[i] += g - s * w[i]
                n[i] += g * g
    got = q.fitted(iter(rows))
    assert all(abs(got[i] - weight(i)) < 1e-3 for i in z) and np.count_nonzero(got) <= len(z)
    raw = np.frombuffer(texts[3].encode(), np.uint8)
    index, off = q.features(raw, np.array([0, len(raw)]))
    assert abs(q._sums(got, index, off)[0] - q.SCALE * float(np.mean([got[i] for i in index]))) < 1e-4


def test_training_sample_is_bounded(spark, monkeypatch):
    from tidebook.llm import quality as q

    docs = spark.createDataFrame([(i % 50, words(i, 20)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, label int")
    few = q.trained(docs, labels, rows=10)
    assert np.array_equal(few, q.trained(docs.repartition(7), labels, rows=10)) and not np.array_equal(few, q.trained(docs, labels))


def test_token_files_elsewhere(spark, tmp_path, monkeypatch):
    """Schemeless folders, and a file system that can't be memory-mapped: only ranges are read."""
    from tidebook.llm import token_files as tf

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, words(i, 40)) for i in range(60)] + [(60, None)], "doc_id long, text string")
    folder = f"{tmp_path}/tokens"
    manifest = tf.write_token_files(docs, folder, path, 0)
    want = sorted(map(tuple, tf.read_token_files(spark, folder, manifest, digests=True).collect()))
    assert len(want) == 61 and tf.whole_uri(spark, folder) == f"file://{folder}"
    reads = []

    class Counted(tf.Ranges):
        def __getitem__(self, at):
            out = super().__getitem__(at)
            reads.append((self.file is not None, out.nbytes))
            return out

    monkeypatch.setattr(tf, "Ranges", Counted)
    monkeypatch.setattr(tf, "_store", lambda uri: (pafs.SubTreeFileSystem(folder, pafs.LocalFileSystem()), "."))
    monkeypatch.setattr(tf, "READ_IDS", 100)
    rows = pa.RecordBatch.from_pydict({c: pa.array([m[k] for m in manifest if m[1]]) for k, c in enumerate(("part", "docs", "ids", "width", "base"))})
    got = [tuple(r.values()) for b in tf._reader("x", False)(iter([rows])) for r in b.to_pylist()]
    assert sorted(got) == want and all(r[0] for r in reads) and max(r[1] for r in reads) < 2000


def test_own_folder_only_on_one_machine():
    from tidebook.llm import runtime

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert runtime.shared_dir(Session).startswith("file:")
    Session.conf.get = staticmethod(lambda *_: "hdfs://shared/checkpoints")
    assert runtime.shared_dir(Session) == "hdfs://shared/checkpoints"


def test_engine_mismatch_fails():
    from tidebook.llm.vocab import Vocabulary

    v = Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    v.id_of = v.id_of + 1
    with pytest.raises(RuntimeError):
        v.ids(["plain text"])


def test_registered_formatting_has_the_extra_conversation(spark):
    import hashlib

    from tests.conftest import SMALL
    from tidebook.llm.queries import QUERIES

    rows = {r.conv_id: r for r in QUERIES["op1_chat_formatting"](spark, SMALL).collect()}
    extra = "</s>[INST] ok [/INST]"
    assert rows[-7].loss_sha256 == hashlib.sha256(extra.encode()).hexdigest() and rows[-7].loss_chars == len(extra)
    ids = {r[0] for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().collect()}
    assert set(rows) == ids | {-7}


def test_registered_counts(spark):
    from tests.conftest import SMALL
    from tidebook.llm.queries import QUERIES
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = {i: [*lib.encode(t, add_special_tokens=False).ids] for i, t in docs.items()}
    counts = {r.doc_id: r.n_tokens for r in QUERIES["op10_token_counts"](spark, SMALL).collect()}
    assert counts == {i: len(x) for i, x in want.items()}
    files = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_files"](spark, SMALL).collect()}
    assert files == {i: (len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in want.items()}
