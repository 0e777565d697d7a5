"""Encoding whole texts to the ids of the tokenizers library, by the merges of a vocabulary file.

The library defines the ids. Plain texts (Latin letters, ASCII, single line ends and spaces as white space) are cut by
the file's own pattern and merged by the rank engine of tiktoken, which is compiled from the same file's merges and
several times faster; all other texts, and texts with special strings, go to the library itself, as do whole files
of a form that isn't known here. The first plain text of every call is encoded both ways: should they ever differ, the
task fails, so that no ids of two kinds are ever mixed.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import cache

import numpy as np

from tidebook.llm.transducer import byte_alphabet

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words in one generation of a worker's memory; two generations are kept.
REMEMBERED = 200_000
#: Code points whose classes and lower case are the same everywhere and which need no normalisation.
STRANGE = re.compile("[^\n -~¡-įı-ɏ]")
#: Fixed value: the word pattern of files that drop white space, the only one compiled here.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A byte that no UTF-8 holds stands for the end of a word.
WORD_END = b"\xff"


def units(text: str) -> list[str] | None:
    """The words of a text whose only white space is single spaces and line ends between words; a word that follows
    a line end keeps it, the others (but the first) are meant with their space. None: the text isn't of this form."""
    words = text.split()
    if " ".join(words) != text.replace("\n", " "):
        return None
    return text.replace("\n", " \n").split(" ") if words else []


def plain_words() -> re.Pattern:
    """The word pattern over plain texts, with the letters and numbers among plain code points listed."""
    plain = [chr(c) for c in range(0x250) if not STRANGE.match(chr(c))]
    letters, numbers = (re.escape("".join(c for c in plain if unicodedata.category(c)[0] == k)) for k in "LN")
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^ \n{letters}{numbers}]+")


class Vocabulary:
    """ids(texts): the little-endian unsigned 32-bit ids of each text, as ``tokenizer.encode`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        pre, model, normal = shape.get("pre_tokenizer") or {}, shape["model"], shape.get("normalizer") or {}
        self.special = sorted(t["content"] for t in shape.get("added_tokens", []))
        steps = pre.get("pretokenizers", [pre])
        self.spaced = [p.get("type") for p in steps] == ["ByteLevel"] and bool(pre.get("use_regex")) and not normal and not pre.get("add_prefix_space")
        changes = [n.get("type") for n in normal.get("normalizers", [])]
        self.worded = [p.get("type") for p in steps] == ["Split", "ByteLevel"] and changes == ["NFC", "Replace", "Lowercase"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space") and model.get("end_of_word_suffix") == "</w>" and steps[0]["pattern"].get("Regex") == WORDS
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix"))
        plain = plain and (self.spaced and not model.get("end_of_word_suffix") or self.worded)
        self.engine = self._engine(model, steps) if plain else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _engine(self, model: dict, steps: list[dict]):
        import tiktoken

        to_byte, suffix = byte_alphabet(), model.get("end_of_word_suffix") or ""

        def raw(piece: str) -> bytes:
            ended = bool(suffix) and piece.endswith(suffix)
            return bytes(to_byte[c] for c in (piece[: -len(suffix)] if ended else piece)) + (WORD_END if ended else b"")

        ids = {raw(p): i for p, i in model["vocab"].items() if p not in self.special}
        order = [bytes([b]) for b in range(256)] + ([bytes([b]) + WORD_END for b in range(255)] if suffix else [])
        order += [raw(a) + raw(b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        ranks = {p: r for r, p in enumerate(dict.fromkeys(order))}
        self.id_of = np.array([ids.get(p, 0) for p in ranks], np.uint32)
        if self.worded:
            self.pattern = plain_words()
            self.id_list = self.id_of.tolist()
        # Fixed value: the byte-level pre-tokenizer's pattern
        cut = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("own", pat_str=cut, mergeable_ranks=ranks, special_tokens={})

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", [self.id_list[k] for k in self.engine._core_bpe.encode_single_piece(word.encode() + WORD_END)]).tobytes()
        if len(word) <= 64:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def _by_engine(self, text: str) -> bytes:
        if self.spaced:
            return self.id_of[self.engine.encode_ordinary(text)].tobytes() if text else b""
        known, word = self.young, self._word
        out = []
        for w in self.pattern.findall(text.lower()):
            ids = known.get(w)
            if ids is None:
                ids = word(w)
                known = self.young
            out.append(ids)
        return b"".join(out)

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.engine is None:
            return self._by_library(texts)
        plain = [not STRANGE.search(t) and not any(s in t for s in self.special) for t in texts]
        out = [self._by_engine(t) if p else b"" for t, p in zip(texts, plain, strict=True)]
        rest = [i for i, p in enumerate(plain) if not p]
        probe = plain.index(True) if any(plain) else None
        found = self._by_library([texts[i] for i in rest] + ([texts[probe]] if probe is not None else []))
        if probe is not None and found[-1] != out[probe]:
            raise RuntimeError("the rank engine and the tokenizers library give different ids")
        for i, x in zip(rest, found, strict=False):
            out[i] = x
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each file and Python worker."""
    return Vocabulary(path)


def file_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
