"""Encoding texts stretch by stretch with memory of what was encoded before.

A stretch runs up to the next blank or line feed that follows a character other than white space.
There neither vocabulary joins anything: the byte-level pattern starts anew before white space, and no
sentence piece holds a line feed or a blank mark after another character (checked when a model is
loaded).  So the ids of a text are the ids of its stretches, and a stretch seen before costs a lookup.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: White space as the byte-level pattern understands it.
WHITE = "\t-\r \x85\xa0  -     　"
_OTHER = "\t\x0b-\r\x85\xa0  -     　"  # but for blank and line feed
_STRETCH = re.compile(f"[{WHITE}]*[^{WHITE}]+(?:[{_OTHER}][{WHITE}]*(?:[^{WHITE}]+|\\Z))*|[{WHITE}]+")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_RARE = tuple(re.findall(f"[{_OTHER}]", "".join(map(chr, range(0x3001))))) + ("\0",)
BLANK_MARK = "▁"


def stretches(text: str) -> list[str]:
    """``text`` cut at every place where tokens certainly end; joined, the parts are the text."""
    if any(pair in text for pair in _PAIRS) or any(sign in text for sign in _RARE):
        return _STRETCH.findall(text)
    # Every blank and line feed follows another character, so each of them begins a stretch.
    parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return parts if parts[0] else parts[1:]


def joins_freely(stretch: str) -> bool:
    """Whether the stretch may stand between others without changing anybody's tokens."""
    return stretch[0] in " \n" and not stretch[-1].isspace()


class ByteLevel:
    """A byte-level vocabulary of the ``tokenizers`` library; ``spec`` is the text of its file."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their strings inside texts are plain text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes per id: the file writes one character for each byte.
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.lengths[number] = len(token)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class SentencePieces:
    """A sentence-piece vocabulary; texts start with the blank that the model itself puts first."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.processor.get_piece_size()
        self.bytes = []
        for number in range(size):
            piece = self.processor.id_to_piece(number)
            if self.processor.is_byte(number):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                continue
            if "\n" in piece or BLANK_MARK in piece.lstrip(BLANK_MARK):
                raise ValueError(f"the model joins words: {piece!r}")
            self.bytes.append(piece.replace(BLANK_MARK, " ").encode())
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self._blank = self.processor.piece_to_id(BLANK_MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that begin with a blank, or with a line feed if they stood behind another stretch."""
        bare = [t[1:] if t[0] == " " else t for t in texts]
        found = []
        for text, ids in zip(texts, self.processor.encode(bare, num_threads=1)):
            if text == " ":
                ids = [self._blank]
            elif text[0] != " ":
                ids = ids[1:]  # the blank that the model put first
            found.append(np.array(ids, np.int64))
        return found

    def spells(self, ids: np.ndarray, text: bytes) -> bool:
        """Whether the pieces' bytes are the text."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())) == text


@lru_cache(maxsize=2)
def byte_level(spec: str) -> ByteLevel:
    return ByteLevel(spec)


@lru_cache(maxsize=2)
def sentence_pieces(model: bytes) -> SentencePieces:
    return SentencePieces(model)


def _parted(vocabulary, parts: list[str], runs: list[int], ids: list[np.ndarray], dtype: str) -> list[bytes] | None:
    """Ids of every part, from those of runs of so many parts; None if some part does not end where a token does."""
    every = np.concatenate(ids)
    ends = np.cumsum(np.fromiter(map(len, map(str.encode, parts)), np.int64, len(parts)))
    token_ends = np.concatenate([[0], np.cumsum(vocabulary.lengths[every])])
    run_ends = ends[np.cumsum(runs) - 1]
    cuts = np.searchsorted(token_ends, ends)
    if (token_ends[np.cumsum(list(map(len, ids)))] != run_ends).any() or (token_ends[cuts] != ends).any():
        return None
    data, stops = every.astype(dtype).tobytes(), (cuts * np.dtype(dtype).itemsize).tolist()
    return [data[start:stop] for start, stop in zip([0, *stops], stops)]


def encode_apart(vocabulary, parts: list[str], dtype: str = "<u2", run: int = 48) -> list[bytes]:
    """Ids of every stretch as bytes; those that may stand together are encoded ``run`` at a time."""
    found: list[bytes | None] = [None] * len(parts)
    free, alone = [], []
    for i, part in enumerate(parts):
        (free if joins_freely(part) else alone).append(i)
    runs = [free[s:s + run] for s in range(0, len(free), run)]
    left = [(runs, vocabulary.encode(["".join([parts[i] for i in own]) for own in runs]))] if runs else []
    while left:
        some, ids = left.pop()
        members = [i for own in some for i in own]
        split = _parted(vocabulary, [parts[i] for i in members], list(map(len, some)), ids, dtype)
        if split:
            for i, data in zip(members, split):
                found[i] = data
        elif len(some) > 1:
            half = len(some) // 2
            left += [(some[:half], ids[:half]), (some[half:], ids[half:])]
        else:  # something in it is not spelt by its own bytes
            alone += some[0]
    if alone:
        for i, ids in zip(alone, vocabulary.encode([parts[i] for i in alone])):
            found[i] = ids.astype(dtype).tobytes()
    return found


class Memo(dict):
    """Stretch -> what ``work`` makes of it, in two generations of at most ``limit`` entries together.

    When the younger one is full it becomes the older one, whose entries return when they are asked for;
    so what is asked for again and again remains.  One call's ``parts`` are always held, whatever their number.
    """

    def __init__(self, work: Callable[[list[str]], list], limit: int):
        super().__init__()
        self.work, self.limit, self.older = work, limit, {}

    def learn(self, parts: set[str]) -> None:
        """Afterwards every one of ``parts`` is known."""
        new = [part for part in parts if part not in self]
        if not new:
            return
        if 2 * (len(self) + len(new)) > self.limit:
            self.older = dict(self)
            self.clear()
            new = list(parts)
        back = {part: self.older[part] for part in new if part in self.older}
        self.update(back)
        new = [part for part in new if part not in back]
        for start in range(0, len(new), 20_000):
            some = new[start:start + 20_000]
            self.update(zip(some, self.work(some)))
