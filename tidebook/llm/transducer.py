"""Deterministic transducers for byte-pair encodings, determinised while texts are read.

A sequence of tokens is the encoding of its text exactly when each token encodes itself and each adjacent pair
encodes its own text, so the last token of a prefix's encoding follows from the last tokens of shorter prefixes.
A state holds, for every place where a token may have begun and still go on, the node of the vocabulary's trie,
the token that ends at that place and its count against the present one. States are finitely many; transitions
are built when first met and kept. Each transition carries the change of the token count.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from functools import cache

#: States that are numbered; texts that leave them are followed state by state.
MOST_STATES = 100_000


class PairEncoder:
    """Merges a short sequence of symbols: the reference that pairs and tokens are tested with."""

    def __init__(self, rank: dict[tuple[Hashable, Hashable], int]):
        self.rank = rank

    def merge(self, symbols: list) -> list:
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = self.rank_of(symbols[i], symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def rank_of(self, a, b):
        return self.rank.get((a, b))

    def tree(self, symbols: list) -> tuple | None:
        """The tree (text, time, left, right) of a sequence that merges into one symbol, else None. A node's time is
        the largest rank in it: no merge that needs it comes earlier."""
        nodes = [(s, -1, None, None) for s in symbols]
        while len(nodes) > 1:
            ranks = [self.rank_of(a[0], b[0]) for a, b in zip(nodes, nodes[1:])]  # noqa: B905
            known = [r for r in ranks if r is not None]
            if not known:
                return None
            i = ranks.index(min(known))
            a, b = nodes[i : i + 2]
            nodes[i : i + 2] = [(a[0] + b[0], max(ranks[i], a[1], b[1]), a, b)]
        return nodes[0]

    def sides(self, symbols: list) -> tuple[list, list] | None:
        """The nodes along the left and the right side of a token's tree, each with its time and its parent's."""
        root = self.tree(symbols)
        if root is None:
            return None
        out = []
        for side in (2, 3):
            node, until, path = root, float("inf"), []
            while node:
                path.append((node[0], node[1], until))
                until, node = node[1], node[side]
            out.append(path)
        return out[0], out[1]

    def meet(self, right: list, left: list) -> bool:
        """Whether some node at the right side of one token merges with one at the left side of the next token
        before either is taken by its own parent (of equal merges the one further left comes first)."""
        for a, born, gone in right:
            for b, born_b, gone_b in left:
                r = self.rank_of(a, b)
                if r is not None:
                    t = max(r, born, born_b)
                    if t < gone and t <= gone_b:
                        return True
        return False


class JoinEncoder(PairEncoder):
    """Any two symbols merge whose joined text is a piece; the piece's rank orders the merges."""

    def rank_of(self, a, b):
        return self.rank.get(a + b)


class Transducer:
    """pieces: texts (bytes or str) to ids; symbols of a text are its elements (bytes: integers, str: characters)."""

    def __init__(self, pieces: dict, encoder: PairEncoder):
        self.encoder = encoder
        self.texts: dict[int, object] = {i: p for p, i in pieces.items()}
        self.length = {i: len(p) for p, i in pieces.items()}
        self.children: list[dict] = [{}]
        self.ends: list[int] = [-1]
        for p, i in pieces.items():
            node = 0
            for c in p:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.ends.append(-1)
            self.ends[node] = i
        self._fits: dict[tuple[int, int], bool] = {}
        self._sides: dict[int, tuple[list, list] | None] = {}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.moves: list[dict] = [{}]

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's joined text is a, b; for a = -1, whether b encodes itself."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 4 * MOST_STATES:
                self._fits.clear()
            one, two = self.sides_of(a) if a >= 0 else None, self.sides_of(b)
            known = self._fits[a, b] = two is not None and (a < 0 or one is not None and not self.encoder.meet(one[1], two[0]))
        return known

    def sides_of(self, token: int) -> tuple[list, list] | None:
        if token not in self._sides:
            text = self.texts[token]
            self._sides[token] = self.encoder.sides([text[i : i + 1] for i in range(len(text))])
        return self._sides[token]

    def step(self, live_now: tuple, c) -> tuple[tuple, int, int]:
        """The state after a symbol, the change of the token count and the last token."""
        last = None
        live = []
        for node, before, count in live_now:
            node = self.children[node].get(c)
            if node is None:
                continue
            token = self.ends[node]
            if last is None and token >= 0 and self.fits(before, token):
                last = (token, count + 1)
            if self.children[node]:
                live.append((node, before, count))
        if last is None:
            raise ValueError(f"no token ends with symbol {c!r}")
        token, change = last
        return (*((n, b, k - change) for n, b, k in live), (0, token, 0)), change, token

    def move(self, state: int | tuple, c) -> tuple[int | tuple, int]:
        """The state after a symbol and the change of the token count. Once MOST_STATES states are built no more are
        numbered: further ones are passed on as they are, until a numbered one is met again."""
        kept = state.__class__ is int
        known = self.moves[state].get(c) if kept else None
        if known is not None:
            return known
        live, change, _ = self.step(self.states[state] if kept else state, c)
        to = self.number.get(live)
        if to is None and len(self.states) < MOST_STATES:
            to = self.number[live] = len(self.states)
            self.states.append(live)
            self.moves.append({})
        if to is None:
            return live, change
        if kept:
            self.moves[state][c] = to, change
        return to, change

    def run(self, state: int | tuple, text: Sequence) -> tuple[int | tuple, int]:
        """The state after some symbols and the change of the token count."""
        n, moves = 0, self.moves
        for c in text:
            state, change = (moves[state].get(c) if state.__class__ is int else None) or self.move(state, c)
            n += change
        return state, n

    def count(self, text: Sequence) -> int:
        """Tokens in the encoding of one pre-token; every symbol of the text must be a piece."""
        return self.run(0, text)[1]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def byte_level_transducer(path: str) -> Transducer:
    """Compiled from a tokenizers file whose model is byte-level BPE without word ends."""
    import json

    with open(path, encoding="utf-8") as f:
        shape = json.load(f)
    pre, model = shape.get("pre_tokenizer") or {}, shape["model"]
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or shape.get("normalizer") or model.get("end_of_word_suffix") or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("only plain byte-level BPE files compile")
    to_byte = byte_alphabet()
    raw = lambda s: bytes(to_byte[c] for c in s)
    merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
    special = {t["content"] for t in shape.get("added_tokens", [])}
    t = Transducer({raw(p): i for p, i in model["vocab"].items() if p not in special}, PairEncoder(rank))
    t.special = sorted(special)
    return t


def scan(maps: list, compose) -> list:
    """Inclusive prefix scan in a logarithmic number of rounds; within a round all compositions are independent."""
    out, step = list(maps), 1
    while step < len(out):
        out = [out[i] if i < step else compose(out[i - step], out[i]) for i in range(len(out))]
        step *= 2
    return out


