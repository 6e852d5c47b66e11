"""Tokenizers of the ``tokenizers`` library behind a cache of pieces.

A text is cut only where its tokenizer cuts as well, so the ids are those of the
whole text; each distinct piece goes through the library once while it is cached.
Cutting and collecting distinct pieces are Arrow kernels over whole batches.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts with these are not cut: white space but blank and line feed, and characters on whose class regex libraries differ.
_ODD = "[\\x00-\\x09\\x0b-\\x1f\\x7f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
#: Nor are, by tokenizers that keep white space, texts with runs of it.
_RUNS = "  |\\n\\n| \\n|\\n "
#: A stop or comma that ends a longer run of signs isn't cut off.
_SIGNS = "[^A-Za-z0-9\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}][.,][ \\n]"


class _Index(dict):
    """Numbers its keys in order of appearance and remembers new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


def _quoted(text: str) -> str:
    """A literal text as a pattern of RE2."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of all ranges (start, length), one after another."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


class PieceEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    A text that may hold one of the tokenizer's added tokens, in any case of its
    letters, is encoded whole by the library, which gives it its own id.  ``max_pieces`` bounds the cache, not the input.  When it is full, pieces that
    only one batch has held since the last time go: most words of a corpus are
    met once, and the rest are worth their place.
    """

    def __init__(self, path: str, max_pieces: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_space = self.tokenizer.encode(" ", add_special_tokens=False).ids == []
        self.hard = "|".join([_ODD, *([] if self.drops_space else [_RUNS]), *(f"(?i:{_quoted(t)})" for t in added)])
        self.mark, self.separator = ("7", " 7 ") if self.drops_space else ("\n", "\n")
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.max_pieces = max_pieces
        self.index = _Index()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 15, np.int64)
        self.lens = np.zeros(1 << 15, np.int64)
        self.seen = np.zeros(1 << 15, np.uint8)
        self.used = 0

    def _prune(self) -> None:
        """Keep the pieces that most batches held, at most half the cache."""
        names, n, least = list(self.index), len(self.index), 2
        while (self.seen[:n] >= least).sum() > self.max_pieces // 2 and least < 255:
            least += 1
        keep = np.flatnonzero(self.seen[:n] >= least)[: self.max_pieces // 2]
        lens = self.lens[keep]
        flat = self.flat[_ragged(self.starts[keep], lens)]
        self.index = _Index()
        self.index.update(zip([names[i] for i in keep.tolist()], range(len(keep)), strict=True))
        room = max(1 << 15, len(keep))
        self.flat, self.used = np.concatenate([flat, np.zeros(1 << 16, np.uint32)]), len(flat)
        self.lens, self.starts, self.seen = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.uint8)
        self.lens[: len(keep)], self.starts[: len(keep)], self.seen[: len(keep)] = lens, np.cumsum(lens) - lens, 1

    def _one(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """Pieces: cut before each blank, around each line feed and before a stop or comma that ends a word."""
        signs = pc.match_substring_regex(texts, _SIGNS)
        if self.drops_space:
            loose = texts
            for sign in ".,":
                for space in " \n":
                    loose = pc.replace_substring(loose, sign + space, f" {sign} ")
            return pc.split_pattern(pc.replace_substring(pc.if_else(signs, texts, loose), "\n", " "), " ")
        texts = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        loose = pc.replace_substring(pc.replace_substring(texts, ".\0", "\0.\0"), ",\0", "\0,\0")
        return pc.split_pattern(pc.if_else(signs, texts, loose), "\0")

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, in runs cut at a separator whose id no piece can hold: one call costs more than a word."""
        odd = {i for i, p in enumerate(pieces) if self.mark in p or not p.strip()}
        plain = [p for i, p in enumerate(pieces) if i not in odd] if odd else pieces
        runs = [self.separator.join(["", *plain[i : i + 64], ""]) for i in range(0, len(plain), 64)]
        parts = [np.fromiter(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        lens = np.diff(marks) - 1
        if parts:  # a run ends where the next one begins
            per_run = np.fromiter((min(64, len(plain) - i) + 1 for i in range(0, len(plain), 64)), np.int64)
            lens = np.delete(lens, np.cumsum(per_run)[:-1] - 1)
        ids = ids[ids != self.mark_id]
        if len(lens) != len(plain):
            raise AssertionError("the separator's id is in a piece")
        if not odd:
            return ids, lens
        ends = np.cumsum(lens)
        own = iter([ids[b - n : b] for b, n in zip(ends, lens, strict=True)])
        rows = [self._one(p) if i in odd else next(own) for i, p in enumerate(pieces)]
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        first = len(self.index) - len(new)
        got, lens = self._encode_new(new)
        need, count = self.used + int(lens.sum()), len(self.index)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat) // 2), np.uint32)])
        if count > len(self.lens):
            more = np.zeros(max(count, len(self.lens) // 2), np.int64)
            self.starts, self.lens, self.seen = np.concatenate([self.starts, more]), np.concatenate([self.lens, more]), np.concatenate([self.seen, more.astype(np.uint8)])
        self.flat[self.used : need] = got
        self.lens[first:count] = lens
        self.starts[first:count] = self.used + np.cumsum(lens) - lens
        self.used = need

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) one after another, and the number of ids of each text."""
        if len(self.index) > self.max_pieces:
            self._prune()
        texts = pc.fill_null(texts, "")
        hard = pc.match_substring_regex(texts, self.hard)
        cut = self._cut(pc.if_else(hard, "", texts))
        words = cut.flatten().dictionary_encode()
        codes = np.fromiter(map(self.index.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        if self.index.new:
            self._learn()
        self.seen[codes] = np.minimum(self.seen[codes], 254) + 1
        codes = codes[words.indices.to_numpy()]
        lens = self.lens[codes]
        ends = np.cumsum(lens)
        ids = self.flat[_ragged(self.starts[codes], lens)]
        edge = np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        sizes = np.diff(edge)
        whole = {i: self._one(texts[i].as_py()) for i in np.flatnonzero(hard.to_numpy(zero_copy_only=False)).tolist()}
        if whole:
            parts = [whole[i] if i in whole else ids[edge[i] : edge[i + 1]] for i in range(len(texts))]
            ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, sizes


@lru_cache(maxsize=2)
def encoder_for(path: str, max_pieces: int = 800_000) -> PieceEncoder:
    """The encoder of this Python worker; its cache serves all tasks that the worker runs."""
    return PieceEncoder(path, max_pieces)


def slices(texts: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` bytes, one text at least, to bound the arrays of a step."""
    at, total = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        total += n or 0
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
