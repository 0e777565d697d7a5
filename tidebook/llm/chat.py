"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive prefixes of a conversation are
rendered and consecutive outputs compared: what a prefix adds is its last turn's span. A template whose output for a
prefix is not a prefix of the next output rewrites history; this is detected and reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.runtime import partitions, small_batches

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

START, END, CUT = "<|im_start|>", "<|im_end|>\n", "\n"
#: Strings that mark turns in this or other chat formats and so must not occur bare inside a text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_control = re.compile("|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL))


def escape(text: str) -> str:
    r"""Double every backslash, then put one after the first character of every control string: ``[\INST]``."""
    return _control.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    r"""A backslash pair is one backslash; a single backslash was put there and goes."""
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n|)", lambda m: {"\\": "\\", "n": "\n", "": ""}[m[1]], role)


def _piece(turn: Turn) -> str:
    return START + escape_role(turn[0]) + CUT + escape(turn[1]) + END


class Marked:
    """The template used here: start mark, role, line end, escaped text, end mark. Pieces of the turns seen last are
    remembered, so rendering every prefix escapes each turn once."""

    def __init__(self):
        self.turns: list[Turn] = []
        self.pieces: list[str] = []

    def __call__(self, turns: Sequence[Turn]) -> str:
        same = 0
        while same < min(len(turns), len(self.turns)) and self.turns[same] is turns[same]:
            same += 1
        self.turns, self.pieces = list(turns), self.pieces[:same] + [_piece(t) for t in turns[same:]]
        return "".join(self.pieces)


@dataclass
class Formatted:
    text: str
    #: start and end of each turn in text, in code points; empty if the template rewrites history
    spans: list[tuple[int, int]]
    #: numbers of the turns at which an earlier output was rewritten
    rewritten: list[int]


def render(turns: Sequence[Turn], template: Template) -> Formatted:
    """Render every prefix, locate the turns by comparing consecutive outputs, and note rewritten history. Where an
    output doesn't go on from the one before, its turn begins at their first difference; later turns are compared
    with the new output, and no span is kept for the conversation."""
    before, spans, rewritten = template(()), [], []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        start = len(before)
        if not now.startswith(before):
            rewritten.append(k - 1)
            start = len(commonprefix((before, now)))
        spans.append((start, len(now)))
        before = now
    return Formatted(before, [] if rewritten else spans, rewritten)


def read_back(text: str, span: tuple[int, int]) -> tuple[str, str, tuple[int, int]]:
    """Role, text and the span of the (escaped) text of one rendered turn, parsed from the output alone."""
    a, b = span
    if not text.startswith(START, a) or not text.endswith(END, a, b):
        raise ValueError("the span doesn't hold a marked turn")
    cut = text.index(CUT, a + len(START), b)
    inner = (cut + len(CUT), b - len(END))
    return unescape_role(text[a + len(START) : cut]), unescape(text[inner[0] : inner[1]]), inner


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    now, turns, some = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if some and conv != now:
                yield now, turns
                turns = []
            now, some = conv, True
            turns.append((role or "", text or ""))
    if some:
        yield now, turns


SCHEMA = "conv_id long, n_turns long, formatted string, spans array<struct<start:long,end:long>>, loss_spans array<struct<start:long,end:long>>, rewritten array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_turns long"


def _format(make: Callable[[], Template], loss_role: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64())] + ([("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten_turns", pa.int64())] if digests else [("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("rewritten", pa.list_(pa.int64()))]))
        for conv, turns in _conversations(batches):
            done = render(turns, make())
            all_turns, loss, loss_spans, n = hashlib.sha256(), hashlib.sha256(), [], 0
            for span in done.spans:
                if digests or loss_role:
                    role, text, inner = read_back(done.text, span)
                    all_turns.update(f"{role}\n{text}\n".encode())
                    if role == loss_role:
                        loss.update(text.encode())
                        n += len(text)
                        loss_spans.append({"start": inner[0], "end": inner[1]})
            if digests:
                rows.append({"conv_id": conv, "n_turns": len(done.spans), "turns_sha256": all_turns.hexdigest(), "loss_chars": n, "loss_sha256": loss.hexdigest(), "formatted_chars": len(done.text), "rewritten_turns": len(done.rewritten)})
            else:
                rows.append({"conv_id": conv, "n_turns": len(turns), "formatted": done.text, "spans": [{"start": a, "end": b} for a, b in done.spans], "loss_spans": loss_spans, "rewritten": done.rewritten})
            size += len(done.text)
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def formatted(conversations: DataFrame, make_template: Callable[[], Template] = Marked, loss_role: str = "assistant", digests: bool = False) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text): the rendered string, each turn's span, the spans
    of the loss role's (escaped) texts and the turns that rewrote history. With ``digests``, read back from the
    output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and rewritten_turns. The loss mask and
    the digests need the marked template or one of its form; others are used with ``loss_role=""``.

    Turns go by turn, then role, then text (nulls first), repeated rows stay; null roles and texts are empty; null
    conv_ids form one conversation; other columns are ignored; an empty table gives no rows. Conversations are dealt
    by conv_id and streamed in order: a task holds one at a time. A template sees whole prefixes, so one conversation
    costs its turns times its length; sequence digests need its turns in one place.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(make_template, loss_role, digests), DIGESTS if digests else SCHEMA)
