"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line has a few features (``line_features``); the field scores a label per line and a pair of
labels per step, and Viterbi decoding finds the best sequence.  A document is kept if content lines
hold enough of its words.  The weights are fitted on a bounded sample of labelled documents, whose
lines take the document's label, by the gradient of the conditional likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymap.llm.common import bounded_batches, rows_of
from eddymap.llm.hashing import mixed

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
FEATURES = 9
CONTENT = 1


def line_features(line: str, words: list[bytes], seen_before: bool) -> list[float]:
    """What the field knows of a line with at least one word."""
    n, letters = len(words), len(line)
    symbols = sum(line.count(c) for c in SYMBOLS)
    upper = line.isupper()
    return [
        1.0,
        min(symbols / n, 2.0),
        1.0 if symbols * 3 > n else 0.0,
        1.0 if upper and letters > 3 else 0.0,
        1.0 if n >= 8 and 2 * len(set(words)) < n else 0.0,
        min(line.count("!") / n, 2.0),
        1.0 if seen_before else 0.0,
        1.0 if n < 4 else 0.0,
        1.0 if line.rstrip()[-1:] in ".!?" and not symbols else 0.0,
    ]


@dataclass
class LineField:
    """Weights: one row of features per label, and a score per pair of labels in turn."""

    emit: np.ndarray
    step: np.ndarray
    share: float = 0.5

    def decode(self, features: list[list[float]]) -> list[int]:
        """The label sequence of highest score (Viterbi); ties go to boilerplate."""
        if not features:
            return []
        scores = (np.asarray(features) @ self.emit.T).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            from_a, from_b = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + s00 if from_a else b + s10) + x, (a + s01 if from_b else b + s11) + y
        label = int(b > a)
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1]

    def content_share(self, features: list[list[float]], sizes: list[int]) -> float:
        """Share of the words that stand in content lines; 1 if there are none."""
        total = sum(sizes)
        return sum(n for n, label in zip(sizes, self.decode(features)) if label == CONTENT) / total if total else 1.0


def fit(sequences: list[np.ndarray], labels: list[int], rounds: int = 60, rate: float = 0.5,
        decay: float = 1e-3) -> LineField:
    """Gradient ascent on the mean log-likelihood per line; the label of a document is that of its lines.

    All sequences step forward together, the longest first, so that a step is one operation on those that
    are long enough for it.
    """
    emit, step = np.zeros((2, FEATURES)), np.zeros((2, 2))
    ranked = sorted((i for i, x in enumerate(sequences) if len(x)), key=lambda i: -len(sequences[i]))
    if not ranked:
        return LineField(emit, step)
    x = np.concatenate([sequences[i] for i in ranked])
    y, sizes = np.array([labels[i] for i in ranked]), np.array([len(sequences[i]) for i in ranked])
    ends, lines = np.cumsum(sizes), len(x)
    starts = ends - sizes
    at = [starts[:np.count_nonzero(sizes > t)] + t for t in range(sizes[0])]
    later = np.concatenate([at[0][:0], *at[1:]])  # every line that follows another
    truth = np.eye(2)[np.repeat(y, sizes)]
    stays = np.diag(np.bincount(y, sizes - 1.0, minlength=2))
    for _ in range(rounds):
        scores = x @ emit.T
        ahead, behind = scores.copy(), np.zeros((lines, 2))
        for now in at[1:]:
            before = ahead[now - 1]
            ahead[now] += np.logaddexp(before[:, :1] + step[0], before[:, 1:] + step[1])
        for now in reversed(at[1:]):
            onward = scores[now] + behind[now]
            behind[now - 1] = np.logaddexp(onward[:, :1] + step[:, 0], onward[:, 1:] + step[:, 1])
        total = np.repeat(np.logaddexp(*ahead[ends - 1].T), sizes)[:, None]
        single = np.exp(ahead + behind - total)
        pairs = np.exp(ahead[later - 1][:, :, None] + step + (scores + behind)[later][:, None, :]
                       - total[later][:, :, None]).sum(0)
        emit, step = (emit + rate * 10 * ((truth - single).T @ x / lines - decay * emit),
                      step + rate * ((stays - pairs) / lines - decay * step))
    return LineField(emit, step)


def document_lines(text: str) -> tuple[list[list[float]], list[int], int]:
    """Features and word counts of the lines with a word, and how many of them repeat an earlier line."""
    features, sizes, repeats, seen = [], [], 0, set()
    for line in text.split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        if words:
            again = line in seen
            repeats += again
            seen.add(line)
            features.append(line_features(line, words, again))
            sizes.append(len(words))
    return features, sizes, repeats


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Number of words inside a window of ``size`` words that the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    codes = np.zeros(n, np.uint64)
    for k in range(size):
        codes = mixed(codes * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n] + np.uint64(1))
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


_RULES = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
    ("content_share", pa.float64()), ("kept", pa.bool_())])


def judge_document(text: str | None, field: LineField) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    features, sizes, repeats = document_lines(text)
    again = repeated_words(words)
    failed = len(words) < 10 or 100 * again > 20 * len(words)
    share = field.content_share(features, sizes)
    return (len(words), len(text) - sum(text.count(c) for c in BLANKS), sum(text.count(c) for c in SYMBOLS),
            repeats, again, failed, share, not failed and share >= field.share)


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", max_docs: int = 600) -> LineField:
    """Fit on the ``max_docs`` labelled documents with the smallest hashed ids, on all their lines in order.

    The content share a document must reach is then set on the same whole texts, where the labels are met
    best, among cuts that keep 98 % of the good ones.  Without labels of both kinds every line counts as
    content.  An id with several labels takes the smallest, one with several texts the first in order.  The
    driver receives some 76 bytes for each line of the sample.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("label_id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    chosen = marked.orderBy(F.xxhash64("label_id"), "label_id").limit(max_docs)

    def features(batches):
        for _, (texts, marks) in rows_of(batches):
            found = [document_lines(text)[:2] for text in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array(marks, pa.int32()), pa.array([np.array(x, np.float64).tobytes() for x, _ in found], pa.binary()),
                pa.array([np.array(n, np.int32).tobytes() for _, n in found], pa.binary())], names=["label", "x", "n"])

    sample = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(chosen, F.col("doc_id") == F.col("label_id"))
        .groupBy("label_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label")
        .mapInArrow(features, "label int, x binary, n binary").collect()
    )
    sample = sorted((r["label"], bytes(r["x"]), bytes(r["n"])) for r in sample if r["n"])
    kinds = {r[0] for r in sample}
    if len(kinds) < 2:
        return LineField(np.array([[0.0] * FEATURES, [1.0] + [0.0] * (FEATURES - 1)]), np.zeros((2, 2)), 0.0)
    sequences = [np.frombuffer(x).reshape(-1, FEATURES) for _, x, _ in sample]
    field = fit(sequences, [r[0] for r in sample])
    shares = [(field.content_share(x.tolist(), np.frombuffer(n, np.int32).tolist()), label) for x, (label, _, n) in zip(sequences, sample)]
    good = sum(label for _, label in shares)
    best = (-1.0, 0.0)
    for cut in sorted({0.0, 0.5, *(s for s, _ in shares)}):
        kept = sum(label for s, label in shares if s >= cut)
        if kept >= 0.98 * good:
            right = kept / good + sum(1 - label for s, label in shares if s < cut) / (len(shares) - good)
            best = max(best, (right, cut))
    field.share = best[1]
    return field


def apply_rules(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base rules and the field's verdict for every row of ``docs``.

    Null and blank texts have no words, so the base rules fail them; rows may repeat; an empty table
    gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, texts) in rows_of(batches):
            found = [(i, *judge_document(t, field)) for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*found), _RULES)] if found
                else [pa.array([], t.type) for t in _RULES], schema=_RULES)

    columns = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
               " base_failed boolean, content_share double, kept boolean")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(work, columns).withColumnRenamed("doc_id", id_col))
