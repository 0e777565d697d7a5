"""Token counts from a compiled tokenizer: state maps of each text's chunks, composed by a prefix scan.

The machine reads characters. Its state is the kind of pre-token that is open, the transducer's state in it and the
characters whose pre-token the next ones decide. A chunk's map gives, for a state before the chunk, the state after it
and the tokens between. At a break the open pre-token ends whatever came before, so maps of all states meet there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from tidebook.llm.kernels import blocks
from tidebook.llm.runtime import id_text, small_batches
from tidebook.llm.transducer import byte_level_transducer, scan
from tidebook.llm.vocab import units

#: Fixed value: how byte-level vocabularies of this family cut a text before merging.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The pattern's endings after an apostrophe that opens a pre-token.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
KINDS = regex.compile(r"(\s)|(\p{L})|(\p{N})")
#: Before a space or line end between words.
WORD_BREAK = regex.compile(r"(?<=\S)(?=[ \n]\S)")
#: Two characters between which every pre-token ends; the second opens one as at a text's start.
BREAK = regex.compile(r"\S\s|\p{L}[^\s\p{L}\p{N}']")
LAST_BREAK = regex.compile("(?r)" + BREAK.pattern)
#: Characters of a chunk, and those before an unbroken chunk from which its entry state is guessed.
CHUNK, LOOK = 1 << 14, 64
REMEMBERED = 250_000

#: What is open (a kind, an apostrophe "'" or nothing), the transducer's state, and characters not yet taken.
State = tuple[str, int | tuple, str]
START: State = ("", 0, "")


class Kinds(dict):
    """w, l, n or o: white space, letter, number or other, as the library's own pre-tokenizer has it. ``odd`` are the
    characters met that this process's patterns take for another kind, being of another Unicode version."""

    def __init__(self):
        super().__init__()
        self.odd: set[str] = set()
        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str

    def __missing__(self, c: str) -> str:
        spans = [s for _, s in self.cut(f"a{c}1{c}!{c} x")]
        kind = "l" if (0, 2) in spans else "n" if (1, 4) in spans else "o" if (3, 6) in spans else "w"
        found = KINDS.match(c)
        if kind != ("wln"[found.lastindex - 1] if found else "o"):
            self.odd.add(c)
        self[c] = kind
        return kind

    def regular(self, text: str) -> bool:
        """Whether the patterns see this text as the library does."""
        if text.isascii():
            return True
        letters = set(text)
        for c in letters - self.keys():
            self[c]
        return not self.odd or self.odd.isdisjoint(letters)


KINDS_OF = Kinds()


class Counter(dict):
    """Counts of words (meant with the space before them, or starting with a line end) met before, in two generations."""

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, int] = {}
        self.transducer = byte_level_transducer(path)
        special = sorted(self.transducer.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def unit(self, text: str) -> int:
        """Tokens of a text that begins and ends at breaks: the pattern's pieces, each run through the transducer."""
        return sum(self.transducer.count(p.encode()) for p in PATTERN.findall(text))

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.unit(word if word[:1] == "\n" else " " + word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n

    def between(self, text: str) -> int:
        """Tokens of a text that begins and ends at breaks."""
        first = 0 if text[:1] in (" ", "\n") and KINDS_OF[text[1:2] or " "] != "w" else None
        if first is None:
            found = WORD_BREAK.search(text)
            first = found.start() if found else len(text)
        n, text = self.unit(text[:first]), text[first:]
        words = units("." + text)
        if words is None:
            return n + sum(self[u[1:] if u[0] == " " else u] for u in WORD_BREAK.split(text) if u)
        return n + sum(map(self.__getitem__, words[1:]))

    def step(self, state: State, c: str) -> tuple[State, int]:
        """The state after a character and the tokens that came with it."""
        (mode, at, held), kind, run = state, KINDS_OF[c], self.transducer.run
        n = 0
        if mode == "w":  # the last white space of a run is held back: a space opens the next pre-token
            if kind == "w":
                at, n = run(at, held.encode())
                return ("w", at, c), n
            if held == " ":
                at, n = run(0, (held + c).encode())
                return (kind, at, ""), n
            n = run(0, held.encode())[1]
            mode = ""
        elif mode == "'":
            if held + c in ENDINGS:
                return START, run(at, (held + c).encode())[1]
            if not held and c in "rvl":
                return (mode, at, c), 0
            if held:  # no ending: the letter opens a pre-token
                at, n = run(0, held.encode())
            mode, held = ("l" if held else "o"), ""
        if kind == "w":
            return ("w", 0, c), n
        now, more = run(at if kind == mode else 0, c.encode())
        return ("'" if not mode and c == "'" or mode in "ln" and c == "'" else kind, now, ""), n + more

    def finish(self, state: State) -> int:
        """Tokens of what a state holds back, where a text ends."""
        mode, at, held = state
        return self.transducer.run(at if mode == "w" else 0, held.encode())[1]

    def walk(self, state: State, text: str) -> tuple[State, int]:
        n = 0
        for c in text:
            state, more = self.step(state, c)
            n += more
        return state, n

    def segment(self, text: str) -> int:
        """Tokens of a text without special strings."""
        maps: list[StateMap] = []
        regular = KINDS_OF.regular(text)
        for i in range(0, len(text), CHUNK):
            maps.append(chunk_map(self, text[i : i + CHUNK], regular))
            # tabulated before the scan: the state that the chunk before surely or probably leaves
            maps[-1](START if not i else maps[-2].leaves if maps[-2].leaves else self.walk(START, text[max(0, i - LOOK) : i])[0])
        if not maps:
            return 0
        state, n = scan(maps, compose)[-1](START)
        return n + self.finish(state)

    def text(self, text: str) -> int:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) // 2 + sum(map(self.segment, parts[::2]))
        return self.segment(text)


class StateMap:
    """From the state before a stretch to (the state after it, its tokens): a table that fills as states are asked for.
    ``leaves``: the state after it where that is the same for all."""

    def __init__(self, find: Callable[[State], tuple[State, int]], leaves: State | None = None):
        self.table: dict[State, tuple[State, int]] = {}
        self.find, self.leaves = find, leaves

    def __call__(self, state: State) -> tuple[State, int]:
        found = self.table.get(state)
        if found is None:
            found = self.table[state] = self.find(state)
        return found


def chunk_map(counter: Counter, chunk: str, regular: bool = True) -> StateMap:
    """``regular``: the patterns may be used; else the chunk is walked from each state that is asked for."""
    first = BREAK.search(chunk) if regular else None
    if first is None:
        return StateMap(lambda state: counter.walk(state, chunk))
    a, b = first.start() + 1, LAST_BREAK.search(chunk).start() + 1
    leaves, tail = counter.walk(START, chunk[b:])
    rest = counter.between(chunk[a:b]) + tail

    def find(state: State) -> tuple[State, int]:
        state, n = counter.walk(state, chunk[:a])
        return leaves, n + counter.finish(state) + rest

    return StateMap(find, leaves)


def compose(x: StateMap, y: StateMap) -> StateMap:
    def find(state: State) -> tuple[State, int]:
        between, n = x(state)
        after, m = y(between)
        return after, n + m

    both = StateMap(find, y.leaves)
    for state in x.table:
        both(state)
    return both


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path).text
        for batch in batches:
            for part, _, off in blocks(batch, "text"):
                n = [tokens(t) for t in part.column("text").fill_null("").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(off[1:] - off[:-1]), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row: tokens of the whole text under a byte-level BPE file.

    Special strings inside texts count one token each, as the library's default has it. A null or empty text has
    0 bytes and 0 tokens; null and repeated ids pass through; other columns are ignored; one narrow pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(_count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
