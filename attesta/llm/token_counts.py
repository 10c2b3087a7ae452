"""Token counts of fields and sections, from one encoding of each document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import encoder

RULES = ("first", "last", "most")


def attribute(spans: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section. ``spans``: first character of each token and the one
    after its last; ``bounds``: where the sections start, and at last their end.

    Sections tile the text, so a search of the sorted bounds is the whole
    interval join. A token that crosses a boundary belongs to the section of
    its first character, of its last, or (``most``) to the one that holds most
    of its characters, the earlier one of equals. Tokens that are parts of one
    character all have its span.
    """
    starts, ends = spans[:, 0], spans[:, 1]
    n = len(bounds) - 1
    lo = np.searchsorted(bounds, starts, "right") - 1
    hi = np.searchsorted(bounds, np.maximum(ends, starts + 1), "left") - 1
    if rule == "first":
        at = lo
    elif rule == "last":
        at = hi
    else:
        at = lo.copy()
        for i in np.flatnonzero(hi > lo):
            own = np.diff(np.clip(bounds[lo[i] : hi[i] + 2], starts[i], ends[i]))
            at[i] = lo[i] + int(np.argmax(own))
    return np.bincount(np.clip(at, 0, n - 1), minlength=n)


def sections(text: str, mark: str = "\n") -> np.ndarray:
    """Bounds of the sections of a text: each runs up to and with its mark."""
    lengths = [len(x) + 1 for x in text.split(mark)]
    lengths[-1] -= 1
    return np.cumsum([0, *(x for x in lengths if x)] or [0, 0])


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", mark: str = "\n") -> DataFrame:
    """One row per section: doc_id, section (from 0), start and length in
    characters, tokens, doc_tokens. Sections are what ``mark`` (one character)
    ends, the lines by default; a document is encoded once as a whole, the
    tokens' spans are the tokenizer's own, and the tokens of its sections sum
    up to those of the whole text. ``rule``: see ``attribute``.

    Null and empty texts have one section of no characters and no tokens. Null
    ids and rows that repeat an id are documents like others; other columns of
    any name go. Empty table: no rows. No shuffle: each batch of rows is
    answered where it was read, and a long text is encoded in runs.
    """
    if rule not in RULES or len(mark) != 1:
        raise ValueError("rule must be one of first, last, most; mark one character")
    names = ["doc_id", "section", "start", "length", "tokens", "doc_tokens"]

    def run(it):
        enc = encoder(tokenizer)
        for b in it:
            out, rows = [[] for _ in names], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                bounds = sections(text, mark) if text else np.zeros(2, np.int64)
                spans = enc.spans(text) if text else np.empty((0, 2), np.int64)
                n = attribute(spans, bounds, rule)
                for to, x in zip(out, ([i] * len(n), np.arange(len(n)), bounds[:-1], np.diff(bounds), n, np.full(len(n), len(spans)))):
                    to.append(x)
                rows += len(n)
                if rows > 1 << 16:
                    yield pack(out)
                    out, rows = [[] for _ in names], 0
            if rows:
                yield pack(out)

    def pack(out):
        return pa.RecordBatch.from_arrays(
            [pa.array([i for x in out[0] for i in x], pa.int64()), *[pa.array(np.concatenate(x), pa.int64()) for x in out[1:]]], names
        )

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
