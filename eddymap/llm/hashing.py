"""Word and span hashes in whole-array arithmetic, shared by the operators on word sequences.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r`` in the UTF-8 form of a
text, which is what ``bytes.split()`` yields.  All sums wrap modulo 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the polynomial over words
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Memo word -> 64-bit hash; emptied when it holds ``limit`` words, so its memory is bounded."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Bytes that part words, as 1.
BLANKS = bytes(byte in b" \t\n\x0b\x0c\r" for byte in range(256))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words up to this many bytes are hashed in whole arrays, eight bytes at a time.
_SHORT_WORD = 64


def joined(texts: pa.Array) -> bytes:
    """The texts of a string column in lower case (A to Z alone) with a line end before and behind each; null is empty."""
    return b"\n".join([b"", *(text or b"" for text in texts.cast(pa.large_binary()).to_pylist()), b""]).lower()


def places(kinds: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of zeros starts and stops; the first and the last byte are not zero."""
    blank = np.frombuffer(kinds, np.uint8) != 0
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    return edges[::2], edges[1::2]


def text_bounds(texts: pa.Array, start: np.ndarray) -> np.ndarray:
    """How many of the words that start at ``start`` in :func:`joined` stand before each text, and in all."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.searchsorted(start, np.r_[0, np.cumsum(sizes + 1)])


def word_hashes(data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """One hash per word ``data[start:stop]``, the same wherever the word stands."""
    eights = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    size = stop - start
    h = mixed((eights[start] & _MASKS[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _ODD))
    done, at = 8, np.flatnonzero(size > 8)
    while len(at) and done < _SHORT_WORD:
        left = size[at] - done
        h[at] = mixed(h[at] * _ODD + (eights[start[at] + done] & _MASKS[np.minimum(left, 8)]))
        done, at = done + 8, at[left > 8]
    for i in at.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i]:stop[i]])
    return h


def powers(n: int, base: np.uint64 = _ODD) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)``."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` consecutive words, in order; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, power in enumerate(powers(size)):
        total += words[k:k + n] * power
    return mixed(total + np.uint64(size))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after the other, and where each begins and the last ends.

    Words are compared in lower case (A to Z alone); fewer words than ``size`` make one shingle, none none.
    """
    data = joined(texts)
    start, stop = places(data.translate(BLANKS))
    words, first = word_hashes(data, start, stop), text_bounds(texts, start)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    whole = shingle_hashes(words, size)[owner[:max(len(owner) - size + 1, 0)] == owner[size - 1:]]
    few = (n > 0) & (n < size)
    bounds = np.r_[0, np.cumsum(np.where(few, 1, np.maximum(n - size + 1, 0)))]
    out, by_size = np.empty(bounds[-1], np.uint64), np.ones(bounds[-1], bool)
    by_size[bounds[:-1][few]] = False
    out[by_size] = whole
    power = powers(size)
    for k in range(1, size):
        at = np.flatnonzero(n == k)
        if len(at):
            total = sum(words[first[at] + j] * power[j] for j in range(k))
            out[bounds[at]] = mixed(total + np.uint64(k))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return out[new], np.r_[0, np.cumsum(new)][bounds]


class Spans:
    """Prefix sums of a polynomial over word hashes: the hash of any span in one step."""

    def __init__(self, words: np.ndarray):
        self.back = powers(len(words) + 1, _BACK)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(len(words)), out=self.sums[1:])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of ``words[start:stop]`` for each pair, wherever it stands."""
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))
