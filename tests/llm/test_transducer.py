"""The compiled transducers give the library's ids and counts on arbitrary texts."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tidebook.llm import token_counts
from tidebook.llm.sentencepieces import piece_transducer
from tidebook.llm.vocab import Vocabulary
from tokenizers import Tokenizer

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LIBRARY = Tokenizer.from_file(BYTES)
TEXT = st.one_of(st.text(max_size=60), st.text(alphabet="aeinorst THE'sdl \n\t.,!123éüß中🙂", max_size=80))


@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_count(text):
    assert token_counts.counter(BYTES).text(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk", [7, 23, 1 << 16])
def test_counts_in_chunks(chunk, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    lib, counter, rng = Tokenizer.from_file(BYTES), token_counts.counter(BYTES), random.Random(chunk)
    letters = [*"abeeinorst THE  \n\n\t.,'12éüß中🙂　́", "'s", " the", "<|endoftext|>", "ing"]
    for _ in range(800):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(70)))
        assert counter.text(text) == len(lib.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_vocabulary(path):
    lib, vocabulary, rng = Tokenizer.from_file(path), Vocabulary(path), random.Random(1)
    letters = [*"abeeinorst THE  \n\n\t.,'12éüßÄ½²ªł中🙂　́İΣ", "'s", "'LL", " the", "<|endoftext|>", "ing"]
    for _ in range(60):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(20)]
        for t, x in zip(texts, vocabulary.ids(texts), strict=True):
            assert np.frombuffer(x, np.uint32).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    assert vocabulary.engine is not None


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_pieces(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t = piece_transducer(PIECES)
    ids = t.encode(text)
    assert np.frombuffer(ids, np.uint32).tolist() == sp.encode(text)
    assert t.decode(ids) == sp.decode(sp.encode(text))


@pytest.mark.parametrize("most, together", [(1_000_000, 16_384), (50, 7)])
def test_pieces_of_many_texts(most, together, monkeypatch):
    """Words take the determinised arcs together; those are built once, and anew beyond a bound."""
    from tidebook.llm import sentencepieces as S

    monkeypatch.setattr(S, "MOST_ARCS", most)
    monkeypatch.setattr(S, "TOGETHER", together)
    monkeypatch.setattr(S, "MANY", 5)
    sp, t, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), S.PieceTransducer(S.Model(PIECES)), random.Random(3)
    t.composition._clear(4)  # a table that has to grow
    letters = [*"aeinorsthd", "ing", "the", " ", " ", " ", "\n", "THE", ".", ",", "12", "é", "ß", "中", "🙂", "▁", "  ", "x" * 90]
    texts = ["", " ", "a", "  a ", "▁", "中", "thé" * 2000, *("".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(300))]
    built, arc = [], t.composition._arc
    monkeypatch.setattr(t.composition, "_arc", lambda *k: built.append(k) or arc(*k))
    for _ in range(2):
        assert [np.frombuffer(x, np.uint32).tolist() for x in t.encode_all(texts)] == sp.encode(texts)
    assert len(set(built)) == len(built) if most > 50 else len(set(built)) < len(built)
    assert len(t.composition.keys) >= 2 * t.composition.arcs == 2 * int((t.composition.keys >= 0).sum())
    words = sorted({w for x in texts for w in S.WORDS.findall(t.normalise(x)) if len(w) <= S.LONG})
    ids, counts = t._at_once(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.path(w) for w in words]


def _message(number: int, value: bytes) -> bytes:
    size, out = len(value), bytes([number << 3 | 2])
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return out + bytes([size]) + value


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf"])
def test_character_maps(rule, tmp_path):
    """The published normaliser rules, put before the same pieces, as the library runs them."""
    from tidebook.llm.sentencepieces import Model, PieceTransducer, _fields

    with open(PIECES, "rb") as f:
        pieces = [(k, v) for k, v in _fields(f.read()) if k != 3]
    rules = dict(_fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
    path = tmp_path / "mapped.model"
    path.write_bytes(b"".join(_message(k, v) for k, v in pieces) + _message(3, rules))
    sp, t = sentencepiece.SentencePieceProcessor(model_file=str(path)), PieceTransducer(Model(str(path)))
    rng = random.Random(6)
    letters = [*"abestT  \n\t.'12éüßÄ½²ªł中🙂　́İΣﬁﾊﾞ①ＡＢ™…", "e\u0301", "が", "カ\u3099", " the", "\u200b", "\x00"]
    for _ in range(600):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert np.frombuffer(t.encode(text), np.uint32).tolist() == sp.encode(text), repr(text)


def test_fits_like_merging():
    t = token_counts.counter(BYTES).transducer
    rng, ids, seen = random.Random(2), list(t.texts), 0
    while seen < 2000:
        i, j = rng.choice(ids), rng.choice(ids)
        a, b = t.texts[i], t.texts[j]
        if len(a) + len(b) < 14:
            seen += 1
            symbols = [x[k : k + 1] for x in (a, b) for k in range(len(x))]
            assert (t.encoder.merge(symbols) == [a, b]) == t.fits(i, j)
