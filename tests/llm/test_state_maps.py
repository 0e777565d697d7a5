"""Chunk state maps against the library: every low code point, long words, small chunks, few states."""

import random

import public_tokenizers
import pytest
from tidebook.llm import token_counts, transducer
from tokenizers import Tokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTES)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["ab\x1c cd", " b\x1c cd", " a\x1c b", " a\x1c b ", "\nab\x1c cd\n", "\x1cab\x1c cd\n", "\x85 a\xa0b", "'r", "a'r", "a're", "'rex", "''s", " 's", "\n's", "'", "a\n\n'll", "x'l l"])
def test_separators(text):
    assert token_counts.counter(BYTES).text(text) == library(text)


@pytest.mark.parametrize("chunk", [1, 2, 7, 29, 1 << 14])
def test_low_code_points(chunk, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "LOOK", 3)
    counter, rng = token_counts.counter(BYTES), random.Random(chunk)
    some = [*map(chr, range(256)), *"   \n\n''''aaeest", "'s", "'re", " the", "ing", "<|endoftext|>", "　", "中", "👍"]
    for k in range(1500):
        letters = some if k % 2 else rng.sample(some, 6)
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert counter.text(text) == library(text), repr(text)


def test_long_words_and_few_states(monkeypatch):
    rng = random.Random(4)
    words = ["a" * 30_000, "ab" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(40_000)), "中文" * 9000, "!?" * 9000, " " * 30_000, "\n \t" * 9000 + "x"]
    want = [library(w) for w in words]
    counter = token_counts.Counter(BYTES)
    assert [counter.text(w) for w in words] == want
    few = token_counts.Counter(BYTES)
    few.transducer = transducer.byte_level_transducer.__wrapped__(BYTES)
    monkeypatch.setattr(transducer, "MOST_STATES", 10)
    monkeypatch.setattr(token_counts, "CHUNK", 1000)
    assert [few.text(w) for w in words] == want and len(few.transducer.states) == 10


def test_maps_compose():
    """The map of a whole is the composition of its parts' maps, from whatever state."""
    counter, rng = token_counts.counter(BYTES), random.Random(9)
    for _ in range(300):
        x, y, before = ("".join(rng.choice("ab 's'r\n!1") for _ in range(rng.randrange(9))) for _ in range(3))
        state = counter.walk(token_counts.START, before)[0]
        both = token_counts.compose(token_counts.chunk_map(counter, x), token_counts.chunk_map(counter, y))
        whole = token_counts.chunk_map(counter, x + y)
        assert both(state) == whole(state) == counter.walk(state, x + y)


def test_characters_of_other_unicode_versions():
    """Where the pattern's classes and the library's differ, the library's count."""
    counter = token_counts.Counter(BYTES)
    for c in map(chr, [*range(0x500, 0x600), *range(0xA700, 0xA800), *range(0x1C80, 0x1D00), *range(0x10000, 0x10100)]):
        text = f"ab{c}1 {c}!{c} x{c}'s"
        assert counter.text(text) == library(text), hex(ord(c))
    assert token_counts.KINDS_OF.odd
