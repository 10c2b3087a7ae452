"""Conversations of typed content parts as training text.

A visitor writes each part: text with its control strings escaped, anything
else as a numbered placeholder whose reference and expanded tokens are put
down. What is written can be read back: turns, parts and loss mask.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


#: A turn is ``<turn role>``, its parts and END; a part that isn't text is a
#: placeholder, ``<image 3>``. In texts a backslash goes before each backslash
#: and each ``<`` that would begin such a mark.
END = "</turn>\n"
KINDS = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<number:long,turn:long,kind:string,ref:string,at:long,tokens:long>"
_CONTROL = re.compile(r"\\|<(?=/?turn|%s)" % "|".join(KINDS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"[\\>]")
_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>", re.DOTALL)
_MARK = re.compile(r"\\.|</turn>\n|<(?:%s) \d+>" % "|".join(KINDS), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Rates:
    """What attachments expand to: an image a token for each patch begun, audio
    so many a second, documents so many a page; one at least."""

    patch: int = 28
    audio_second: float = 25.0
    page: int = 1024


@dataclass
class Writer:
    """Visits the parts of a conversation, turn by turn. ``pieces`` holds what
    was written since ``take``; offsets are those of the whole conversation."""

    rates: Rates
    learned: frozenset[str]
    chars: int = 0
    number: int = 0
    turn: int = 0
    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attached: list[dict] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.chars += len(text)

    def turn_of(self, role: str, parts: list[dict]) -> None:
        self.put("<turn " + _ROLE.sub(r"\\\g<0>", role) + ">")
        for part in parts:
            kind = part["kind"] or "text"
            self.visit(kind)(part, role)
        self.put(END)
        self.turn += 1

    def visit(self, kind: str) -> Callable[[dict, str], None]:
        found = getattr(self, "on_" + kind, None) if kind in ("text", *KINDS) else None
        if found is None:
            raise ValueError(f"parts are text, {', '.join(KINDS)}; not {kind!r}")
        return found

    def on_text(self, part: dict, role: str) -> None:
        start = self.chars
        self.put(escape(part["text"] or ""))
        if role in self.learned and self.chars > start:
            self.spans.append((start, self.chars))

    def on_image(self, part: dict, role: str) -> None:
        across = lambda n: -(-max(n or 0, 1) // self.rates.patch)
        self.attach(part, across(part["width"]) * across(part["height"]))

    def on_audio(self, part: dict, role: str) -> None:
        self.attach(part, -int(-(part["seconds"] or 0.0) * self.rates.audio_second // 1))

    def on_document(self, part: dict, role: str) -> None:
        self.attach(part, max(part["pages"] or 0, 1) * self.rates.page)

    def attach(self, part: dict, tokens: int) -> None:
        self.number += 1
        self.attached.append({"number": self.number, "turn": self.turn, "kind": part["kind"], "ref": part["ref"], "at": self.chars, "tokens": max(1, tokens)})
        self.put(f"<{part['kind']} {self.number}>")

    def take(self) -> tuple[str, list[tuple[int, int]], list[dict]]:
        out = "".join(self.pieces), self.spans, self.attached
        self.pieces, self.spans, self.attached = [], [], []
        return out


def parse(text: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of each turn of formatted text, parts as (kind, text) or
    (kind, number)."""
    at = 0
    while at < len(text):
        head = _TURN.match(text, at)
        if not head:
            raise ValueError("formatted text doesn't go on with a turn")
        parts, begun = [], head.end()
        for mark in _MARK.finditer(text, begun):
            if mark[0][0] == "\\":
                continue
            if mark.start() > begun:
                parts.append(("text", unescape(text[begun : mark.start()])))
            begun = mark.end()
            if mark[0] == END:
                break
            kind, number = mark[0][1:-1].split(" ")
            parts.append((kind, number))
        else:
            raise ValueError("a turn has no end")
        yield unescape(head[1]), parts
        at = begun


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for first in range(0, b.num_rows, 64):  # never a whole batch as Python objects
            yield from b.slice(first, 64).to_pylist()


def format_conversations(
    rows: DataFrame, parts: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    learned: tuple[str, ...] = ("assistant",), rates: Rates | None = None, tokenizer: str | None = None, segment_chars: int = 1 << 22,
) -> DataFrame:
    """conv_id, segment, first_char, n_turns, formatted, loss, attachments,
    expanded_tokens and text_tokens of conversations given as a row a turn.

    ``parts`` is an array of ``PART``; parts without a kind are text, null
    parts or texts are empty, other kinds than those known are an error. Turns
    stand in order of ``turn`` (null first), then role and parts. ``loss``
    lists where texts of the ``learned`` roles stand, without placeholders;
    attachments are numbered through a conversation. All offsets are code
    points of the whole conversation. expanded_tokens are those of the
    placeholders, text_tokens (null without a ``tokenizer`` file) those of what
    is written between them. Rows without a conv_id are one conversation, a
    null role is an empty one, repeated rows are turns each; an empty table
    gives no rows. Other columns, of any name, go.

    One shuffle brings a conversation's turns together. Its rows are then
    sorted on disk and written as they stream by; beyond ``segment_chars`` a
    conversation goes on in a further row, begun with a turn, so neither a task
    nor a row holds more than that and one turn.
    """
    counts, rates = tokenizer, rates or Rates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size, conv_id, segment, first, turns = 0, None, 0, 0, 0
        writer: Writer | None = None

        def cut() -> None:
            nonlocal segment, first, turns, size
            text, spans, attached = writer.take()
            out.append({
                "conv_id": conv_id, "segment": segment, "first_char": first, "n_turns": turns, "formatted": text, "loss": [
                    {"start": a, "stop": b} for a, b in spans
                ],
                "attachments": attached, "expanded_tokens": sum(a["tokens"] for a in attached), "text_tokens": text_tokens(text, first, attached, counts),
            })
            size += len(text)
            segment, first, turns = segment + 1, writer.chars, 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            batch, size = pa.RecordBatch.from_pylist(out, schema=SEGMENT_ARROW), 0
            out.clear()
            return batch

        for r in _rows(batches):
            if writer is None or r["conv_id"] != conv_id:
                if turns:
                    cut()
                writer, conv_id, segment, first = Writer(rates, frozenset(learned)), r["conv_id"], 0, 0
            writer.turn_of(r["role"] or "", [p for p in r["parts"] or [] if p])
            turns += 1
            if writer.chars - first >= segment_chars:
                cut()
            if size >= 1 << 22 or len(out) >= 4096:
                yield flush()
        if turns:
            cut()
        if out:
            yield flush()

    own = rows.select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"),
        parts.cast(f"array<{PART}>").alias("parts")
    )
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts").mapInArrow(run, SEGMENT)


SEGMENT = f"conv_id long, segment long, first_char long, n_turns long, formatted string, loss array<struct<start:long,stop:long>>, attachments array<{ATTACHMENT}>, expanded_tokens long, text_tokens long"
_span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_attachment = pa.struct([("number", pa.int64()), ("turn", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
SEGMENT_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("first_char", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("loss", pa.list_(_span)), ("attachments", pa.list_(_attachment)), ("expanded_tokens", pa.int64()), ("text_tokens", pa.int64()),
])


def text_tokens(text: str, first: int, attached: list[dict], tokenizer: str | None) -> int | None:
    """Tokens of what stands between the placeholders, each stretch encoded by itself."""
    if tokenizer is None:
        return None
    from .tokens import encoder

    total, at = 0, 0
    for a in attached:
        total += len(encoder(tokenizer).ids(text[at : a["at"] - first]))
        at = a["at"] - first + len(f"<{a['kind']} {a['number']}>")
    return total + len(encoder(tokenizer).ids(text[at:]))


def read_turns(segments: DataFrame) -> DataFrame:
    """conv_id, segment, place (in the segment), role and parts (kind and text,
    or kind and the attachment's number) as read from the formatted text. A
    turn of no text has no parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
        schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("parts", kind)])
        for r in _rows(batches):
            found = [
                {"conv_id": r["conv_id"], "segment": r["segment"], "place": i, "role": role, "parts": [{"kind": k, "text": t} for k, t in parts]} for i,
                (role, parts) in enumerate(parse(r["formatted"]))
            ]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return segments.select("conv_id", "segment", "formatted").mapInArrow(
        run, "conv_id long, segment long, place long, role string, parts array<struct<kind:string,text:string>>"
    )


def digests(segments: DataFrame) -> DataFrame:
    """A row a conversation, of what its output says: n_turns, turns_sha256 (of
    role, newline, text, newline for each turn), loss_chars and loss_sha256 (of
    all text under the loss mask) and formatted_chars.

    ``segments`` come as ``format_conversations`` leaves them: those of one
    conversation follow each other in one partition. Only the hashes' state is
    kept between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        out: list[tuple] = []
        conv_id = turns = None
        for r in _rows(batches):
            if turns is None or r["conv_id"] != conv_id:
                if turns is not None:
                    out.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv_id, turns, loss, n_turns, loss_chars, chars = r["conv_id"], hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            text = r["formatted"]
            for role, parts in parse(text):
                turns.update(f"{role}\n{''.join(t for k, t in parts if k == 'text')}\n".encode())
                n_turns += 1
            for span in r["loss"]:
                learned = unescape(text[span["start"] - r["first_char"] : span["stop"] - r["first_char"]])
                loss.update(learned.encode())
                loss_chars += len(learned)
            chars += len(text)
            if len(out) >= 4096:
                yield _digest_batch(out)
                out = []
        if turns is not None:
            out.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if out:
            yield _digest_batch(out)

    return segments.select("conv_id", "segment", "first_char", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def text_part(text: Column) -> Column:
    """A text as the only part of a turn."""
    none = lambda t: F.lit(None).cast(t)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), none("string").alias("ref"),
            none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")
        )
    )
