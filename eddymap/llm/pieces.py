"""SentencePiece encoding as a max-plus scan, and decoding.

The best segmentation of a text is the one whose pieces have the highest sum of model scores
(Viterbi over the model's vocabulary; characters without a piece become byte pieces at a penalty).
Scores are scaled to integers, so sums are exact and associative.

A document longer than ``chunk`` characters is cut.  At a boundary the state is the number of
characters by which the piece in progress reaches beyond it.  Each chunk yields a transfer matrix: the
best score from every state at its start to every state at its end.  Matrices combine associatively by
``max`` and ``+``; their running products give the boundary states of the best path, between which
every chunk is traced back on its own.  Pieces never hold a blank mark after another character, so a
matrix is the sum of a head, a middle that all paths share, and a tail; a chunk without a blank mark
gets the full matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymap.llm.common import bounded_batches, row_print, rows_of

BLANK_MARK = "▁"
#: Stands for a blank mark that is part of the text itself, which becomes byte pieces; a lone surrogate
#: cannot be part of a text in Spark.
_LITERAL = "\udfff"
SCALE = 1024
NONE = -(1 << 60)


class _Memo(dict):
    """Ids of stretches; what is not held is worked out and not kept."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, stretch: str) -> bytes:
        return self.pieces._alone(stretch)


class Pieces:
    """A model's vocabulary with integer scores."""

    def __init__(self, model: bytes, cache: int = 800_000):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.text) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        normal = [i for i in range(len(self.text)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.text[i]: round(sp.get_score(i) * SCALE) for i in normal}
        self.id = {self.text[i]: i for i in normal}
        self.longest = max(map(len, self.id))
        # Blank marks of 16 characters have a score of their own, which says nothing about the others.
        self.penalty = min(s for p, s in self.score.items() if p.strip(BLANK_MARK)) - 10 * SCALE
        if any(BLANK_MARK in p.lstrip(BLANK_MARK) for p in self.id) or any("\n" in p for p in self.id):
            raise ValueError("pieces must not hold a blank mark after another character, nor a line end")
        self.worth = np.zeros(len(self.text), np.int64)  # score by id; of byte pieces the first of a character pays
        for piece, i in self.id.items():
            self.worth[i] = self.score[piece]
        for b, i in self.bytes.items():
            self.worth[i] = 0 if 0x80 <= b < 0xC0 else self.penalty
        raw = [bytes([self.of_byte[i]]) if i in self.of_byte else p.replace(BLANK_MARK, " ").encode() for i, p in enumerate(self.text)]
        self.sizes = np.array([len(b) for b in raw], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.memo = _Memo(self)
        self.limit = cache
        self._hash_pieces()

    def _hash_pieces(self, slots: int = 20) -> None:
        """A table from the hash of a piece to its number, with room for two pieces in a slot."""
        self.names = list(self.id)
        self.shift = np.uint64(64 - slots)
        for seed in range(3, 1000, 2):
            self.base = np.uint64(0x9E3779B97F4A7C15 * seed & (2 ** 64 - 1))
            keys = []
            for piece in self.names:
                h = 0
                for c in piece:
                    h = (h + ord(c)) * int(self.base) & (2 ** 64 - 1)
                keys.append(h)
            slot: dict[int, list[int]] = {}
            for k, h in enumerate(keys):
                slot.setdefault(h >> (64 - slots), []).append(k)
            if len(set(keys)) == len(keys) and max(map(len, slot.values())) <= 2:
                break
        none = len(keys)
        self.keys = np.array([*keys, 0], np.uint64)
        self.slot = np.full(1 << slots, none, np.int32)
        self.second = np.full(none + 1, none, np.int32)
        for at, found in slot.items():
            self.slot[at] = found[0]
            if len(found) == 2:
                self.second[found[0]] = found[1]
        self.number = np.array([*(self.id[p] for p in self.names), 0], np.uint32)
        self.points = np.array([*(self.score[p] for p in self.names), NONE], np.int64)

    def segment_all(self, texts: list[str]) -> list[bytes | None]:
        """Best ids of many stretches of one length at once; None where a character has no piece."""
        n, length = len(texts), len(texts[0])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).T.astype(np.uint64)
        best = np.full((length + 1, n), NONE, np.int64)
        back = np.zeros((length + 1, n), np.int64)  # number of the last piece, and where it starts
        best[0] = 0
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = (h + codes[j - 1]) * self.base
                found = self.slot[h >> self.shift]
                found = np.where(self.keys[found] == h, found, self.second[found])
                score = np.where(self.keys[found] == h, self.points[found], NONE) + best[i]
                better = score > best[j]
                np.copyto(best[j], score, where=better)
                np.copyto(back[j], found * np.int64(64) + i, where=better)
        ids = np.zeros((n, length), np.uint32)
        at, taken, every = np.full(n, length, np.int64), np.zeros(n, np.int64), np.arange(n)
        while (at > 0).any():
            rows = every[at > 0]
            taken[rows] += 1
            last = back[at[rows], rows]
            ids[rows, length - taken[rows]] = self.number[last >> 6]
            at[rows] = last & 63
        whole = (best[length] > NONE // 2).tolist()
        return [row[length - k:].tobytes() if ok else None for row, k, ok in zip(ids, taken.tolist(), whole)]

    def learn(self, split: list[list[str]]) -> None:
        """Put the stretches that are short and new into the memo."""
        new = set(filterfalse(self.memo.__contains__, chain.from_iterable(split)))
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
            new = set(chain.from_iterable(split))
        by_length: dict[int, list[str]] = {}
        for s in new:
            if len(s) <= 32:
                by_length.setdefault(len(s), []).append(s)
        for same in by_length.values():
            for s, ids in zip(same, self.segment_all(same)):
                self.memo[s] = self._alone(s) if ids is None else ids

    def _alone(self, text: str) -> bytes:
        _, back = self.forward(text, 0, len(text))
        return np.array(self.trace(text, back, 0, len(text)), np.uint32).tobytes()

    def ids_of(self, stretches: list[str]) -> np.ndarray:
        """Ids of stretches in a row; long ones are not remembered."""
        return np.frombuffer(b"".join(map(self.memo.__getitem__, stretches)), np.uint32)

    def forward(self, text: str, start: int, stop: int) -> tuple[list[int], list[int]]:
        """Best score and start of the last piece, for every end from ``start`` to the end of ``text``.

        Pieces begin before ``stop``.  Of equal scores the longest last piece wins.
        """
        n = len(text)
        best, back = [NONE] * (n + 1), [-1] * (n + 1)
        best[start] = 0
        score, longest = self.score, self.longest
        for i in range(start, stop):
            base = best[i]
            if base == NONE:
                continue
            if text[i] not in score and base + self.penalty > best[i + 1]:
                best[i + 1], back[i + 1] = base + self.penalty, i
            for j in range(i + 1, min(n, i + longest) + 1):
                s = score.get(text[i:j])
                if s is not None and base + s > best[j]:
                    best[j], back[j] = base + s, i
        return best, back

    def trace(self, text: str, back: list[int], start: int, stop: int) -> list[int]:
        out: list[int] = []
        while stop > start:
            i = back[stop]
            piece = text[i:stop]
            number = self.id.get(piece)
            if number is None:
                raw = (BLANK_MARK if piece == _LITERAL else piece).encode("utf-8", "surrogatepass")
                out.extend(self.bytes[b] for b in reversed(raw))
            else:
                out.append(number)
            stop = i
        return out[::-1]


def blanked(text: str) -> str:
    """The text with a blank mark for each space."""
    return text.replace(BLANK_MARK, _LITERAL).replace(" ", BLANK_MARK)


def marked(text: str) -> str:
    """The text as pieces see it, with a blank mark in front."""
    return BLANK_MARK + blanked(text)


_STRETCH = re.compile(f"{BLANK_MARK}*[^{BLANK_MARK}\n]+|{BLANK_MARK}+|\n")


def encode_texts(pieces: Pieces, texts: list[str]) -> list[np.ndarray]:
    """Ids of whole texts; an empty text has none."""
    split = [_STRETCH.findall(marked(t)) if t else [] for t in texts]
    pieces.learn(split)
    return [pieces.ids_of(stretches) for stretches in split]


def decode_all(pieces: Pieces, flat: np.ndarray, ends: list[int]) -> list[str]:
    """Texts of id lists that lie one after another in ``flat`` and end at ``ends``.

    Byte pieces are their bytes, blank marks become spaces, the first of which is dropped.
    """
    sizes = pieces.sizes[flat]
    stops = np.cumsum(sizes)
    at = np.arange(stops[-1] if len(stops) else 0) + np.repeat(pieces.places[flat] - (stops - sizes), sizes)
    data = pieces.blob[at].tobytes()
    edges = [0, *(int(stops[e - 1]) if e else 0 for e in ends)]
    return [data[a + 1:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    return decode_all(pieces, np.array(ids, np.int64), [len(ids)])[0]


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Pieces:
    """The vocabulary and its memo, kept by a worker from task to task."""
    return Pieces(model)


def _cuts(text: str, stop: int) -> tuple[int, int] | None:
    """First and last place up to ``stop`` that no piece crosses, or None: line ends and first blank marks."""
    first = last = -1
    for m in _STRETCH.finditer(text, 0, stop):
        if m.start() and (text[m.start()] in BLANK_MARK + "\n" or text[m.start() - 1] == "\n"):
            if not (text[m.start()] == BLANK_MARK and text[m.start() - 1] == BLANK_MARK):
                first, last = (m.start() if first < 0 else first), m.start()
    return (first, last) if first >= 0 else None


def transfer(pieces: Pieces, text: str, stop: int) -> np.ndarray:
    """Matrix of best scores from each entry state to each exit state; ``text`` reaches beyond ``stop``."""
    states = pieces.longest
    matrix = np.full((states, states), NONE, np.int64)
    cuts = _cuts(text, stop)
    if cuts is None:
        for a in range(min(states, stop + 1)):
            best, _ = pieces.forward(text, a, stop)
            for b in range(min(states, len(text) - stop + 1)):
                matrix[a, b] = max(best[stop + b], NONE)
        return matrix
    first, last = cuts
    middle = int(pieces.worth[pieces.ids_of(_STRETCH.findall(text[first:last]))].sum())
    end, _ = pieces.forward(text[last:], 0, stop - last)
    tail = [end[stop - last + b] if stop + b <= len(text) else NONE for b in range(states)]
    for a in range(min(states, first + 1)):
        head = pieces.forward(text[:first], a, first)[0][first]
        if head > NONE:
            for b in range(states):
                if tail[b] > NONE:
                    matrix[a, b] = head + middle + tail[b]
    for a in range(first + 1, min(states, stop + 1)):  # a piece that reaches past the first cut: none crosses it
        matrix[a, :] = NONE
    return matrix


def trace_chunk(pieces: Pieces, text: str, stop: int, enter: int, leave: int) -> list[int]:
    """Ids of the best path through a chunk between two boundary states."""
    end = stop + leave
    cuts = _cuts(text, stop)
    if cuts is None:
        return pieces.trace(text, pieces.forward(text[:end], enter, stop)[1], enter, end)
    first, last = cuts
    ids = pieces.trace(text, pieces.forward(text[:first], enter, first)[1], enter, first)
    ids += pieces.ids_of(_STRETCH.findall(text[first:last])).tolist()
    return ids + pieces.trace(text[last:], pieces.forward(text[last:end], 0, stop - last)[1], 0, end - last)


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    product = (left[:, :, None] + right[None, :, :]).max(1)
    return np.where(product < NONE // 2, NONE, product)


def boundary_states(matrices: list[np.ndarray]) -> tuple[list[int], int]:
    """States at all boundaries of the best path from state 0 to state 0, and its score."""
    ahead = [np.full(matrices[0].shape[0], NONE, np.int64)]
    ahead[0][0] = 0
    for m in matrices:
        ahead.append(combine(ahead[-1][None, :], m)[0])
    states = [0]
    for vector, m in zip(reversed(ahead[:-1]), reversed(matrices)):
        states.append(int(np.argmax(np.where((vector > NONE) & (m[:, states[-1]] > NONE), vector + m[:, states[-1]], NONE))))
    return states[::-1], int(ahead[-1][0])


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                     chunk: int = 32_768) -> DataFrame:
    """``id, ids, score`` for every row of ``docs``; the model's file (a few MB at most) goes to all tasks.

    Chunks of a document spread over tasks; only its matrices (2 kB a chunk) meet, so a document of
    the largest size Spark can hold needs some 130 MB there.  Null and empty texts have no pieces and
    score 0; rows may repeat; an empty table gives no rows; other columns are ignored.  Of
    segmentations that tie any one is returned; the score and the text they decode to are the same.
    """
    bounded_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    longest = Pieces(model).longest
    if chunk < 2 * longest:
        raise ValueError(f"chunk must be at least {2 * longest} characters")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model)
        for _, (ids, texts) in rows_of(batches):
            found = encode_texts(pieces, [t or "" for t in texts])
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.array([int(pieces.worth[x].sum()) for x in found], pa.int64())], names=["doc_id", "ids", "score"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (prints, texts) in rows_of(batches):
            for name, text in zip(prints, texts):
                whole = " " + text
                starts = list(range(0, len(whole), chunk))
                if len(starts) > 1 and len(whole) - starts[-1] < longest:
                    starts.pop()  # the last chunk holds at least as much as a piece can reach into it
                stops = [*starts[1:], len(whole)]
                for first in range(0, len(starts), 64):
                    part = range(first, min(first + 64, len(starts)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(part)), pa.array(part, pa.int32()),
                        pa.array([whole[starts[k]:stops[k] + longest - 1] for k in part]),
                        pa.array([stops[k] - starts[k] for k in part], pa.int32())], names=["name", "k", "part", "stop"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model)
        for _, (names, ks, parts, stops) in rows_of(batches, 64):
            pieces.learn([_STRETCH.findall(blanked(t)) for t in parts])
            yield pa.RecordBatch.from_arrays([
                pa.array(names), pa.array(ks, pa.int32()),
                pa.array([transfer(pieces, blanked(t), n).tobytes() for t, n in zip(parts, stops)], pa.binary())],
                names=["name", "k", "matrix"])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        states, score = boundary_states([np.frombuffer(m, np.int64).reshape(longest, longest) for m in group["matrix"]])
        return pd.DataFrame({"name": group["name"], "k": group["k"], "enter": states[:-1], "leave": states[1:], "total": score})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model)
        for _, (names, ks, parts, stops, enters, leaves, totals) in rows_of(batches, 64):
            pieces.learn([_STRETCH.findall(blanked(t)) for t in parts])
            found = [trace_chunk(pieces, blanked(t), n, a, b) for t, n, a, b in zip(parts, stops, enters, leaves)]
            yield pa.RecordBatch.from_arrays([
                pa.array(names), pa.array(ks, pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(totals, pa.int64())],
                names=["name", "k", "ids", "total"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    plain = rows.filter(~giant).mapInArrow(short, "doc_id long, ids array<int>, score long")
    named = rows.filter(giant).select("doc_id", row_print(F.col("doc_id"), F.col("text")).alias("name"), "text")
    cut_up = (
        named.groupBy("name").agg(F.first("text").alias("text"))
        .mapInArrow(split, "name string, k int, part string, stop int").repartition("name", "k")
    )
    states = (
        cut_up.mapInArrow(measure, "name string, k int, matrix binary").groupBy("name")
        .applyInPandas(fold, "name string, k int, enter int, leave int, total long")
    )
    traced = (
        cut_up.join(states, ["name", "k"]).select("name", "k", "part", "stop", "enter", "leave", "total")
        .mapInArrow(trace, "name string, k int, ids array<int>, total long")
        .groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.first("total").alias("score"))
        .select("name", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), "score")
    )
    long = named.select("doc_id", "name").join(traced, "name").select("doc_id", "ids", "score")
    return plain.unionByName(long).withColumnRenamed("doc_id", id_col)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, ids, text``: the texts that ids stand for.  Null ids give a null text, no ids an empty one."""
    bounded_batches(encoded.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = part.column(1)
                texts = decode_all(pieces, ids.flatten().to_numpy(), np.cumsum(ids.value_lengths().fill_null(0).to_numpy()).tolist())
                texts = [t if known else None for t, known in zip(texts, ids.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return (encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
            .mapInArrow(work, "doc_id long, ids array<int>, text string").withColumnRenamed("doc_id", id_col))
