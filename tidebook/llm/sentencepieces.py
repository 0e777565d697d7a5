"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model compiles to a chain of transducers. The normaliser's arcs are the model's character map (a trie that is left by
its longest match), then a machine that drops extra spaces, then one that marks spaces and puts the dummy prefix. The
lexicon's arcs spell pieces and return to the start with a piece as output; a letter without a piece has an arc of its
own, whose outputs are the byte pieces or the unknown piece. Encoding composes the input with the chain and takes
the shortest path in the tropical semiring. In a unigram model an arc weighs the piece's negated score. A byte-pair
model's lexicon is composed with an acceptor of adjacent pieces, whose arcs weigh nothing where the pair encodes its
own text and infinitely much elsewhere: one path of finite weight is left to every place, so no weights need be carried
and the composition is determinised while texts are read, its arcs being built when first met. White space starts a word,
as no piece of a usable model crosses from a word into it, so shortest paths are found word by word, once a distinct
word of a block.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidebook.llm.kernels import blocks
from tidebook.llm.runtime import id_text, small_batches
from tidebook.llm.transducer import MOST_STATES, JoinEncoder, PairEncoder

SPACE = "▁"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
REMEMBERED = 350_000
#: Letters of a word beyond which it is neither remembered nor encoded together with others.
LONG = 64
#: Words that are encoded together, and words whose ids are put together at once.
TOGETHER, MANY = 16_384, 1 << 18
#: Arcs of a determinised composition that a worker keeps; beyond them it starts anew.
MOST_ARCS = 1_000_000
#: Fixed value: what the library subtracts from the least score for an unknown character in a unigram model.
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message (varints, and bytes of strings and messages)."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return n, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            size, i = varint(i)
            value, i = raw[i : i + size], i + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, i = raw[i : i + size], i + size
        yield key >> 3, value


def character_map(raw: bytes) -> dict[str, str]:
    """The rewriting rules of a precompiled map: a double-array trie over the bytes of what is rewritten, whose values
    are places in a block of zero-ended replacements. Fixed values: the layout of the trie's 32-bit units."""
    if not raw:
        return {}
    size = struct.unpack_from("<I", raw)[0]
    units, block = struct.unpack_from(f"<{size // 4}I", raw, 4), raw[4 + size :]
    first = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    rules: dict[str, str] = {}
    todo = [(first(units[0]), b"", 0)]
    while todo:
        at, key, ends = todo.pop()
        if ends:
            value = units[at] & 0x7FFFFFFF
            rules[key.decode()] = block[value : block.index(0, value)].decode()
        for c in range(1, 256):
            if (at ^ c) < len(units) and units[at ^ c] & 0x800000FF == c:
                todo.append((at ^ c ^ first(units[at ^ c]), key + bytes([c]), units[at ^ c] & 0x100))
    return rules


class Model:
    """Pieces and normaliser of a model file. The format's field numbers and piece types."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(_fields(b"".join(v for k, v in top if k == 2)))
        normal = dict(_fields(b"".join(v for k, v in top if k == 3)))
        self.kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
        if self.kind is None or trainer.get(24):
            raise ValueError("unigram and byte-pair models without suffix white space compile")
        self.rules = character_map(normal.get(2, b""))
        self.dummy_prefix, self.trims = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        for piece in (dict(_fields(v)) for k, v in top if k == 1):
            self.pieces.append(piece[1].decode())
            self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
            self.types.append(piece.get(3, 1))
        self.unknown = self.types.index(2)
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if trainer.get(35) else None
        self.normal = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == 1}
        if 4 in self.types or any(SPACE in p.lstrip(SPACE) for p in self.normal):
            raise ValueError("models with user-defined pieces or pieces across words don't compile")


class Normaliser:
    """The composition of the character map, the machine of extra spaces and the marking of spaces."""

    def __init__(self, rules: dict[str, str], trims: bool, dummy_prefix: bool):
        #: states of the map's trie: arcs by letter, and the output of the match that ends there
        self.arcs: list[dict[str, int]] = [{}]
        self.outputs: list[str | None] = [None]
        for key, value in rules.items():
            state = 0
            for c in key:
                state = self.arcs[state].setdefault(c, len(self.arcs))
                if state == len(self.arcs):
                    self.arcs.append({})
                    self.outputs.append(None)
            self.outputs[state] = value
        #: where every match is one letter the trie is one state, whose arcs are a table
        self.table = {ord(k): v for k, v in rules.items()} if all(len(k) == 1 for k in rules) else None
        self.trims, self.dummy_prefix = trims, dummy_prefix

    def mapped(self, text: str) -> str:
        if self.table is not None:
            return text.translate(self.table) if self.table else text
        out, i, n = [], 0, len(text)
        while i < n:
            state, j, end, found = 0, i, i + 1, text[i]
            while j < n and (state := self.arcs[state].get(text[j], 0)):
                j += 1
                if self.outputs[state] is not None:
                    end, found = j, self.outputs[state]
            out.append(found)
            i = end
        return "".join(out)

    def trimmed(self, text: str) -> str:
        """Two states: between words, where spaces are dropped, and in a word, whose following space is held back."""
        return " ".join(w for w in text.split(" ") if w)

    def __call__(self, text: str) -> str:
        text = self.mapped(text)
        if self.trims:
            text = self.trimmed(text)
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)


class Weights(dict):
    """Weights of the lexicon's arcs by (state of the acceptor, token), filled as they are asked for."""

    def __init__(self, scores: dict[int, float] | None, encoder: PairEncoder | None, texts: dict[int, str]):
        super().__init__()
        self.scores, self.encoder, self.texts = scores, encoder, texts
        self.sides: dict[int, tuple[list, list] | None] = {}

    def sides_of(self, token: int) -> tuple[list, list] | None:
        if token not in self.sides:
            self.sides[token] = self.encoder.sides(list(self.texts[token]))
        return self.sides[token]

    def __missing__(self, arc: tuple[int, int]) -> float:
        before, token = arc
        if self.scores is not None:
            weight = -self.scores[token]
        else:  # a pair weighs nothing if its joined text is encoded as that pair
            one, two = self.sides_of(before) if before >= 0 else None, self.sides_of(token)
            weight = 0.0 if two is not None and (before < 0 or one is not None and not self.encoder.meet(one[1], two[0])) else inf
        if len(self) > 4 * MOST_STATES:
            self.clear()
        self[arc] = weight
        return weight


class Composition:
    """The lexicon composed with the acceptor of pairs, determinised as its arcs are asked for.

    A state names, in turns, the lexicon's state and the acceptor's for every place where a token may have begun and
    still go on; the last of them tells the token that ends there on the one path of finite weight. State 0 is the start,
    to which a letter of no piece returns. Arcs lie in a table with open places, by state and letter, so that many words
    take a step at once.
    """

    def __init__(self, lexicon: list[tuple[dict, int, int]], weights: Weights):
        self.lexicon, self.weights = lexicon, weights
        self._clear(1 << 20)

    def _clear(self, places: int) -> None:
        self.numbers: dict[tuple[int, ...], int] = {(0, -1): 0}
        self.states: list[tuple[int, ...]] = [(0, -1)]
        self.ends = np.full(1, -1, np.int64)
        self._places(places)

    def _places(self, places: int) -> None:
        self.keys, self.to, self.arcs = np.full(places, -1, np.int64), np.zeros(places, np.int32), 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Where the search for keys begins (Fixed value: the multiplier of a Fibonacci hash)."""
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _put(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Distinct arcs that aren't there yet."""
        if 2 * (self.arcs + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, to = np.concatenate([self.keys[old], keys]), np.concatenate([self.to[old], to])
            self._places(1 << (4 * len(keys)).bit_length())
        self.arcs += len(keys)
        place = self._place(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[place] < 0)
            self.keys[place[free]] = keys[free]
            put = self.keys[place] == keys
            self.to[place[put]] = to[put]
            keys, to, place = keys[~put], to[~put], (place[~put] + 1) & (len(self.keys) - 1)

    def _arc(self, live: tuple[int, ...], letter: str) -> int:
        token, there = -1, []
        for at, before in zip(live[::2], live[1::2], strict=True):
            node = self.lexicon[at][0].get(letter)
            if node is None:
                continue
            if token < 0 and node[1] >= 0 and self.weights[before, node[1]] < inf:
                token = node[1]
            if node[0]:
                there += node[2], before
        if token < 0:
            return 0
        live = (*there, 0, token)
        number = self.numbers.get(live)
        if number is None:
            number = self.numbers[live] = len(self.states)
            self.states.append(live)
        return number

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The states after one letter each."""
        keys = states.astype(np.int64) << 21 | letters
        place = self._place(keys)
        found = self.keys[place]
        to = self.to[place]
        todo = np.flatnonzero(found != keys)
        missing = []
        place, found = place[todo], found[todo]
        while len(todo):
            missing.append(todo[found < 0])
            todo, place = todo[found >= 0], (place[found >= 0] + 1) & (len(self.keys) - 1)
            found = self.keys[place]
            hit = found == keys[todo]
            to[todo[hit]] = self.to[place[hit]]
            todo, place, found = todo[~hit], place[~hit], found[~hit]
        if missing and len(missing := np.concatenate(missing)):
            new, which = np.unique(keys[missing], return_inverse=True)
            made = np.array([self._arc(self.states[k >> 21], chr(k & 0x1FFFFF)) for k in new.tolist()], np.int32)
            self._put(new, made)
            to[missing] = made[which]
        return to

    def tokens(self, words: list[str], length: np.ndarray, own_arc: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens along the words' paths, one word after the other, and how many each has; length: by token."""
        if self.arcs > MOST_ARCS:
            self._clear(1 << 20)
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        order = np.argsort(-size, kind="stable")
        begin, size = (np.cumsum(size) - size)[order], size[order]
        passed = np.zeros((int(size[0]) + 1, len(words)), np.int32)
        for j in range(int(size[0])):
            m = int(np.searchsorted(-size, -j))
            passed[j + 1, :m] = self.step(passed[j, :m], letters[begin[:m] + j])
        if len(self.ends) < len(self.states):
            self.ends = np.concatenate([self.ends, np.array([live[-1] for live in self.states[len(self.ends) :]], np.int64)])
        rounds, at, left = [], size.copy(), np.flatnonzero(size)
        count = np.zeros(len(words), np.int64)
        while len(left):
            token = self.ends[passed[at[left], left]]
            back = length[token]
            alone = np.flatnonzero(token < 0)
            if len(alone):
                new, which = np.unique(letters[begin[left[alone]] + at[left[alone]] - 1], return_inverse=True)
                token[alone], back[alone] = np.array([own_arc(chr(c)) for c in new.tolist()], np.int64)[which], 1
            rounds.append((left, token))
            count[left] += 1
            at[left] -= back
            left = left[at[left] > 0]
        counts = np.empty_like(count)
        counts[order] = count
        last = np.cumsum(counts)[order] - 1
        out = np.empty(int(counts.sum()), np.int64)
        for i, (left, token) in enumerate(rounds):
            out[last[left] - i] = token
        return out, counts


def spread(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Runs of values, given by their first places and lengths, one after the other."""
    ends = np.cumsum(count)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)]


class PieceTransducer:
    """encode(text) and decode(ids) of one model."""

    def __init__(self, model: Model):
        self.model = model
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.normalise = Normaliser(model.rules, model.trims, model.dummy_prefix)
        self.paired = model.kind == "bpe"
        texts = {i: p for p, i in model.normal.items()}
        #: outputs of each token: a piece's id, or what a letter without a piece falls back to
        self.outputs: dict[int, list[int]] = {i: [i] for i in texts}
        self.letters: dict[str, int] = {}
        if self.paired:
            # a letter that is no piece itself may still be merged
            for c in sorted({c for p in model.normal for c in p} - model.normal.keys()):
                texts[self._own_arc(c)] = c
        self.length = {i: len(p) for i, p in texts.items()}
        self.longest = max(self.length.values())
        #: the lexicon's states: arcs by letter, the token with which an arc goes back to the start, and a number
        self.lexicon: tuple[dict, int, int] = ({}, -1, 0)
        ends = {p: i for i, p in texts.items()}
        nodes = {"": self.lexicon}
        for p in sorted(ends):
            for j in range(1, len(p) + 1):
                if p[:j] not in nodes:
                    nodes[p[:j]] = nodes[p[: j - 1]][0][p[j - 1]] = ({}, ends.get(p[:j], -1), len(nodes))
        scores = {i: model.scores[i] for i in model.normal.values()}
        self.penalty = UNKNOWN_PENALTY - min(scores.values())
        self.weights = Weights(None if self.paired else scores, JoinEncoder({p: -scores[i] for p, i in model.normal.items()}) if self.paired else None, texts)
        self.lengths = np.array([self.length.get(t, 1) for t in range(len(model.pieces) + len(self.letters))])
        self._flatten()
        self.composition = Composition(list(nodes.values()), self.weights) if self.paired else None

    def _own_arc(self, letter: str) -> int:
        """The token of a letter that is no piece: numbered after the pieces."""
        token = self.letters.get(letter)
        if token is None:
            ids = self.model.byte_ids
            token = self.letters[letter] = len(self.model.pieces) + len(self.letters)
            self.outputs[token] = [ids[b] for b in letter.encode()] if ids else [self.model.unknown]
        return token

    def path(self, word: str) -> list[int]:
        """The outputs of the shortest path through the word composed with the lexicon."""
        size, paired, weights, root = len(word), self.paired, self.weights, self.lexicon
        distance, state, token = [inf] * (size + 1), [-1] * (size + 1), [-1] * (size + 1)
        distance[0] = 0.0
        for i in range(size):
            here, before = distance[i], state[i]
            if here == inf:
                continue
            node, j, single = root, i, False
            for c in word[i : i + self.longest]:
                node = node[0].get(c)
                if node is None:
                    break
                j += 1
                arc = node[1]
                if arc >= 0:
                    single |= j == i + 1
                    there = here + weights[before, arc]
                    if there < distance[j]:
                        distance[j], token[j] = there, arc
                        if paired:
                            state[j] = arc
            if not single and here + self.penalty < distance[i + 1]:
                distance[i + 1], token[i + 1], state[i + 1] = here + self.penalty, self._own_arc(word[i]), -1
        path, i, length = [], size, self.length
        while i:
            path.append(token[i])
            i -= length.get(token[i], 1)
        return [k for t in reversed(path) for k in self.outputs[t]]

    def _word(self, word: str) -> bytes:
        ids = self.memory.get(word) or self.older.get(word) or array("I", self.path(word)).tobytes()
        if len(word) <= LONG:
            if len(self.memory) >= REMEMBERED:
                self.older, self.memory = self.memory, {}
            self.memory[word] = ids
        return ids

    def _by_path(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has: one shortest path at a time."""
        found = [self._word(w) for w in words]
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _at_once(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same in the determinised composition, for many words at once."""
        tokens, counts = self.composition.tokens(words, self.lengths, self._own_arc)
        if len(self.flat[2]) < len(self.model.pieces) + len(self.letters):
            self._flatten()
        ids, first, size = self.flat
        made = np.concatenate([[0], np.cumsum(size[tokens])])
        ends = np.cumsum(counts)
        return spread(ids, first[tokens], size[tokens]), made[ends] - made[ends - counts]

    def _flatten(self) -> None:
        """Outputs by token as one run of ids, with the tokens' first places in it and numbers of ids."""
        outputs = [self.outputs.get(t, []) for t in range(len(self.model.pieces) + len(self.letters))]
        size = np.array([len(x) for x in outputs])
        self.flat = np.array([k for x in outputs for k in x], np.uint32), np.cumsum(size) - size, size

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, where each word's begin among them, and how many it has."""
        short = [i for i, w in enumerate(words) if self.paired and len(w) <= LONG]
        rest = [i for i, w in enumerate(words) if not self.paired or len(w) > LONG]
        parts = [self._at_once([words[i] for i in short[j : j + TOGETHER]]) for j in range(0, len(short), TOGETHER)]
        parts.append(self._by_path([words[i] for i in rest]))
        count, first = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        count[short + rest] = counts = np.concatenate([n for _, n in parts])
        first[short + rest] = np.cumsum(counts) - counts
        return np.concatenate([x for x, _ in parts]), first, count

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Each distinct word is encoded once."""
        texts = [self.normalise(t) for t in texts]
        # where every space starts a word, texts are cut at spaces
        plain = [t[:1] == SPACE != t[-1:] and SPACE * 2 not in t for t in texts]
        cut = pc.split_pattern(pa.array([t[1:] for t, p in zip(texts, plain, strict=True) if p], pa.large_string()), SPACE)
        others = [WORDS.findall(t) for t, p in zip(texts, plain, strict=True) if not p]
        some, more = cut.flatten().dictionary_encode(), pa.array([w for x in others for w in x], pa.large_string()).dictionary_encode()
        words = [SPACE + w for w in some.dictionary.to_pylist()] + more.dictionary.to_pylist()
        if not words:
            return [b""] * len(texts)
        which = np.concatenate([some.indices.to_numpy(), more.indices.to_numpy().astype(np.int64) + len(some.dictionary)])
        ids, first, count = self._ids(words)
        raw = b"".join(spread(ids, first[w], count[w]).tobytes() for w in (which[i : i + MANY] for i in range(0, len(which), MANY)))
        ends = np.concatenate([[0], 4 * np.cumsum(count[which])])[np.concatenate([[0], np.cumsum([*pc.list_value_length(cut).to_pylist(), *map(len, others)])])].tolist()
        found = [raw[a:b] for a, b in pairwise(ends)]
        in_order = iter(found), iter(found[sum(plain) :])
        out = [next(in_order[not p]) for p in plain]
        return out if self.model.byte_ids else [self._merge_unknown(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _merge_unknown(self, raw: bytes) -> bytes:
        ids = array("I", raw)
        return array("I", [k for i, k in enumerate(ids) if k != self.model.unknown or not i or ids[i - 1] != k]).tobytes()

    @property
    def surfaces(self) -> list[bytes]:
        if not hasattr(self, "_surfaces"):
            m = self.model
            self._surfaces = [bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else " ⁇ ".encode() if t == 2 else p.replace(SPACE, " ").encode() for p, t in zip(m.pieces, m.types, strict=True)]
        return self._surfaces

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 give U+FFFD; the dummy prefix goes."""
        out = b"".join(map(self.surfaces.__getitem__, array("I", ids))).decode(errors="replace")
        return out[1:] if self.model.dummy_prefix and out[:1] == " " else out


@cache
def piece_transducer(path: str) -> PieceTransducer:
    return PieceTransducer(Model(path))


def _encode(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = piece_transducer(path)
        for batch in batches:
            for part, _, _ in blocks(batch, "text"):
                texts = part.column("text").fill_null("").to_pylist()
                ids = t.encode_all(texts)
                back = [t.decode(x) for x in ids]
                columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if keep:
                    columns += [pa.array([array("I", x).tolist() for x in ids], pa.list_(pa.int32())), pa.array(back, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])
                else:
                    columns += [pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == y for x, y in zip(texts, back, strict=True)], pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return run


def encoded(docs: DataFrame, path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row; with ``digests`` (doc_id, n_tokens, ids_crc32 of the ids as
    little-endian unsigned 32-bit integers, decoded_sha256, round_trip: the decoded text is the text).

    Null or empty texts have no ids and decode to the empty text. Null and repeated ids pass through, other columns
    are ignored. One narrow pass, no shuffle; a worker remembers a bounded number of arcs or words.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean" if digests else "doc_id long, n_tokens long, ids array<int>, decoded string"
    return id_text(docs, id_col, text_col).mapInArrow(_encode(path, not digests), schema)
