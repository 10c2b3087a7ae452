"""Token ids and character spans of public tokenizers inside tasks."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The usual splitting pattern of byte-level BPE (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here all versions of Unicode agree on letters and numbers.
SETTLED = "ԯ"
#: Texts beyond so many characters are encoded in runs of about that many.
RUN = 1 << 18
#: Words and blanks this long go to the tokenizer itself.
LONG = 4096
#: Pieces, and characters of them, whose spans a worker remembers.
PIECES, PIECE_CHARS = 500_000, 16 << 20

# Byte-level tokenizers never have a token across these places: they begin one
# at a blank between two other characters, and after a line's end between letters.
_CUT = re.compile(r"(?<=[A-Za-z]\n)(?=[A-Za-z])")
_BLANK, _ODD = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s | \s")
_BLANKS = re.compile(r"\s{%d}" % LONG)


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merges_by_id(model: dict, special: list[str]) -> bool:
    """Whether a vocabulary is byte-level BPE whose pairs merge in the order of
    their tokens' ids, as the faster engine takes for granted: one merge makes
    each token, a later one a greater id, and what no merge makes is a byte."""
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(k) for k in odd):
        return False
    vocab = model["vocab"]
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    ids = [vocab.get(t, -1) for t in made]
    rest = set(vocab) - set(made) - set(special)
    return ids[:1] != [-1] and all(a < b for a, b in zip(ids, ids[1:])) and rest == set(_byte_letters())


class Encoder:
    """Ids and spans as ``Tokenizer.from_file(path).encode(text,
    add_special_tokens=False)`` gives them.

    With a plain byte-level tokenizer whose pairs merge in the order of ids
    (``merges_by_id``) the ids of a run come from a faster engine with the same
    vocabulary, if the run has settled characters, no special token and no word
    or blank of LONG characters; all other runs, and any at which that engine
    fails, go through the tokenizer itself. Spans are
    the tokenizer's own: of the pieces between single blanks, which no token
    crosses; those met before are remembered. Other tokenizers take every text
    as one.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] for t in added
        )
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in added]
        self.fast = None
        if self.plain and merges_by_id(spec["model"], self.special):
            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def runs(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, run) of a text."""
        first = 0
        while self.plain and len(text) - first > RUN:
            cut = _CUT.search(text, first + RUN)
            if not cut:
                break
            yield first, text[first : cut.start()]
            first = cut.start()
        yield first, text[first:] if first else text

    def ids(self, text: str) -> np.ndarray:
        found = [self._ids(run) for _, run in self.runs(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def _ids(self, run: str) -> np.ndarray:
        settled = self.fast is not None and (run.isascii() or max(run, default="") <= SETTLED)
        if settled and max(map(len, run.split()), default=0) < LONG and not _BLANKS.search(run) and not any(s in run for s in self.special):
            try:
                return self.fast.encode_to_numpy(run, disallowed_special=()).astype("<u4", copy=False)
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # its panics aren't Exceptions
                pass
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4")

    def spans(self, text: str) -> np.ndarray:
        """(token, 2): first character of each token and the one after its last."""
        found = [(self._pieced(run) if self.plain else self._spans(run)) + first for first, run in self.runs(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def _spans(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(self.tokenizer.encode(text, add_special_tokens=False).offsets), np.int64).reshape(-1, 2)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = self.used = 0
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat = np.zeros((1 << 14, 2), np.int64)

    def _pieced(self, text: str) -> np.ndarray:
        pieces = _BLANK.split(text) if _ODD.search(text) else text.split(" ")
        head, pieces = self._spans(pieces[0]), pieces[1:]
        if not pieces:
            return head
        if len(self.known) > PIECES or self.chars > PIECE_CHARS:
            self._forget()
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(list(dict.fromkeys(pieces[i] for i in new.tolist())))
            at[new] = [self.known[pieces[i]] for i in new.tolist()]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        starts = len(text) - int(lengths.sum()) + np.cumsum(lengths) - lengths
        n = self.count[at]
        rows = np.arange(int(n.sum())) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
        return np.concatenate([head, self.flat[rows] + np.repeat(starts, n)[:, None]])

    def _learn(self, pieces: list[str]) -> None:
        """Spans of the pieces, each with the blank before it. Those that end
        in blanks can only end a text and are encoded alone, the others in one."""
        alone = [p for p in pieces if not p or p[-1].isspace()]
        joined = [p for p in pieces if p and not p[-1].isspace()]
        for group in (joined, *([p] for p in alone)):
            if group:
                spans = self._spans("".join(" " + p for p in group))
                ends = np.cumsum([len(p) + 1 for p in group])
                of = np.searchsorted(ends, spans[:, 0], "right")
                self._keep(group, np.bincount(of, minlength=len(group)), spans - np.concatenate(([0], ends))[of][:, None])

    def _keep(self, group: list[str], n: np.ndarray, spans: np.ndarray) -> None:
        k = len(self.known)
        while k + len(group) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + len(spans) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.first[k : k + len(group)] = self.used + np.cumsum(n) - n
        self.count[k : k + len(group)] = n
        self.flat[self.used : self.used + len(spans)] = spans
        self.used += len(spans)
        self.known.update(zip(group, range(k, k + len(group))))
        self.chars += sum(map(len, group))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)
