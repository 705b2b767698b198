"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two words counts the subsequences of ``LENGTH`` letters they share, each weighed by
``DECAY`` to the power of the stretch it spans, so an insult still counts when characters are inserted
or the ending changes.  A sentence is described by its largest kernel value with each of a few
landmark words; Nyström's map of these values makes the kernel machine a linear one.  Landmarks, map
and weights are fitted on a bounded sample of labelled documents; a document's score is that of its
worst sentence, calibrated to a probability.

Nearly all words have nothing in common with a landmark: the length of the longest common subsequence,
computed for whole arrays of words in machine words, sorts them out before any kernel is evaluated.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymap.llm.common import bounded_batches, rows_of

LENGTH, DECAY = 3, 0.9
WIDTH = 24  # longer words are seen through overlapping windows of this many characters
POWERS = (3,)  # a normalised kernel's powers are kernels; higher ones tell near words apart
SHORTEST = 4  # landmarks have this many letters or more
PAIRS = 8192  # the driver evaluates kernels for so many pairs of words at a time
STEPS = 1000  # kernel values of training sentences are kept as whole thousandths
_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W\d_]+")
_SIGNS = str.maketrans("0134578@$!", "oieastbasi")  # signs written for letters; 1 stands for i or l
_SPELT = re.compile(r"(?<!\S)(?:\S )+\S(?!\S)")


def codes(words: list[str]) -> np.ndarray:
    """One row of ``WIDTH`` code points per word, 0 behind its end."""
    return np.array(words, f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)


class CommonLengths:
    """Length of the longest common subsequence with each of many words, several words to a machine word.

    The usual bit-vector recurrence; a spare bit behind each word takes the carry of its addition.
    """

    def __init__(self, words: list[str]):
        self.lanes: list[tuple[np.ndarray, np.uint64, list[tuple[int, np.uint64]]]] = []
        table, full, members, used = np.zeros(1024, np.uint64), 0, [], 0
        for k, word in enumerate(words):
            if used + len(word) > 63:
                self.lanes.append((table, np.uint64(full), members))
                table, full, members, used = np.zeros(1024, np.uint64), 0, [], 0
            for i, c in enumerate(word):
                table[min(ord(c), 1023)] |= np.uint64(1 << (used + i))
            mask = ((1 << len(word)) - 1) << used
            full, used = full | mask, used + len(word) + 1
            members.append((k, np.uint64(mask)))
        self.lanes.append((table, np.uint64(full), members))

    def of(self, rows: np.ndarray):
        """``(number of the word, lengths)`` for each word in turn."""
        letters = np.minimum(rows, 1023).T.copy()
        for table, full, members in self.lanes:
            state = np.full(len(rows), full, np.uint64)
            for column in letters:
                shared = state & table[column]
                state = ((state + shared) | (state - shared)) & full
            state = ~state
            for k, mask in members:
                yield k, np.bitwise_count(state & mask)


def kernel(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of ``rows`` with the same row of ``others``."""
    n, width = others.shape
    before = [np.ones((n, width + 1))] + [np.zeros((n, width + 1)) for _ in range(LENGTH - 1)]
    total = np.zeros(n)
    for t in range(rows.shape[1]):
        letter = rows[:, t:t + 1]
        same = (others == letter) & (letter != 0)
        total += DECAY ** 2 * (before[LENGTH - 1][:, :-1] * same).sum(1)
        after = [before[0]]
        for i in range(1, LENGTH):
            gained = np.zeros((n, width + 1))
            for j in range(width):
                gained[:, j + 1] = DECAY * gained[:, j] + DECAY ** 2 * before[i - 1][:, j] * same[:, j]
            after.append(DECAY * before[i] + gained)
        before = after
    return total


def _own(rows: np.ndarray) -> np.ndarray:
    return kernel(rows, rows)


class Landmarks:
    """Landmark words, and the normalised kernel of any word with each of them."""

    def __init__(self, words: list[str]):
        self.words = words
        self.rows = codes(words) if words else np.zeros((0, WIDTH), np.uint32)
        self.own = _own(self.rows) if words else np.zeros(0)
        self.common = CommonLengths(words)
        self.needed = [max(LENGTH, -(-len(w) * 6 // 10)) for w in words]

    def values(self, words: list[str], pairs_at_once: int | None = None) -> dict[int, dict[int, float]]:
        """For the words with anything in common: landmark number -> kernel value."""
        if not self.words or not words:
            return {}
        rows = codes(words)[:, :max(1, max(map(len, words)))]
        pairs = [(np.flatnonzero(shared >= self.needed[k]), k) for k, shared in self.common.of(rows)]
        at = np.concatenate([near for near, _ in pairs])
        mark = np.repeat([k for _, k in pairs], [len(near) for near, _ in pairs])
        if not len(at):
            return {}
        once, of = np.unique(at, return_inverse=True)
        width = max(map(len, self.words))
        step = pairs_at_once or len(at)
        value = np.concatenate([
            kernel(rows[at[s:s + step]], self.rows[mark[s:s + step], :width]) for s in range(0, len(at), step)])
        value /= np.sqrt(_own(rows[once])[of] * self.own[mark])
        found: dict[int, dict[int, float]] = {}
        for i in range(len(at)):
            found.setdefault(int(at[i]), {})[int(mark[i])] = float(value[i])
        return found


def forms(bare: str) -> list[str]:
    """A word, and what it reads as without inner signs and with signs taken for letters."""
    if not _INNER.search(bare):
        return [bare]
    signs = bare.translate(_SIGNS)
    return list(dict.fromkeys([bare, *(_INNER.sub("", x) for x in (bare, signs, bare.replace("1", "l").translate(_SIGNS)))]))


class Memo:
    """Kernel values of words met so far; emptied when it holds ``limit`` words."""

    def __init__(self, landmarks: Landmarks, limit: int = 300_000):
        self.landmarks, self.limit = landmarks, limit
        self.known: dict[str, dict[int, float] | None] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.limit:
            self.known.clear()
        units: dict[int, list[str]] = {}  # by length, so that short words take few steps
        of: dict[int, list[str]] = {}
        known = self.known
        for word in words:
            if word in known:
                continue
            known[word] = None
            bare = _EDGE.sub("", word)
            for form in forms(bare):
                if len(form) < LENGTH:
                    continue
                parts = [form] if len(form) <= WIDTH else [form[a:a + WIDTH] for a in range(0, len(form) - WIDTH // 2, WIDTH // 2)]
                size = -(-len(form) // 3) if len(form) <= WIDTH else 0
                units.setdefault(size, []).extend(parts)
                of.setdefault(size, []).extend([word] * len(parts))
        for size, group in units.items():
            for start in range(0, len(group), 20_000):
                for u, values in self.landmarks.values(group[start:start + 20_000]).items():
                    word = of[size][start + u]
                    have = known[word] or {}
                    known[word] = {k: max(have.get(k, 0.0), values.get(k, 0.0)) for k in have | values}


def document_words(text: str) -> list[str]:
    """Lower-case words, then the words spelt out letter by letter."""
    low = text.lower()
    return low.split() + [m[0].replace(" ", "") for m in _SPELT.finditer(low) if len(m[0]) >= 2 * LENGTH - 1]


def sentences(words: list[str], known: dict[str, dict[int, float] | None]) -> list[dict[int, float]]:
    """Largest kernel value per landmark of each sentence that has any."""
    found, now, at = [], {}, -1
    for i, word in enumerate(words):
        values = known[word]
        if values:
            if at >= 0 and any(w[-1] in ".!?" for w in words[at:i]):
                found.append(now)
                now = {}
            at = i
            for k, v in values.items():
                if v > now.get(k, 0.0):
                    now[k] = v
    return found + [now] if now else found


@dataclass
class Model:
    """Landmarks, weights behind the Nyström map folded back onto kernel values, and calibration."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, found: list[dict[int, float]]) -> float:
        """Distance from the boundary of the worst sentence; that of a clean one if none is described."""
        m = len(self.landmarks)
        return max([self.bias, *(self.bias + sum(
            self.weights[i * m + k] * v ** power for k, v in s.items() for i, power in enumerate(POWERS)) for s in found)])

    def probability(self, margin: float) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * margin + self.offset, -50, 50))))


def misspelt(word: str) -> list[str]:
    """``word`` with a letter inserted, doubled or, from five letters on, left out, at every inner place."""
    inner = range(1, len(word))
    dropped = [word[:i] + word[i + 1:] for i in inner[:-1]] if len(word) > SHORTEST else []
    return [word[:i] + c + word[i:] for i in inner for c in "aeiorsx"] + [word[:i] + word[i - 1] + word[i:] for i in inner] + dropped


def _train(landmarks: list[str], labels: np.ndarray, bags: list[np.ndarray], times: np.ndarray, rounds: int = 2000) -> Model:
    """Hinge loss on sentences in the Nyström map, then a logistic curve on documents.

    ``bags`` hold a document's sentences, one row of kernel values each, ``times`` how many documents are
    like it.  Beside the labelled sentences stand the landmarks' misspellings that are nearer to them than
    clean documents come; these weigh as much as the toxic sentences together.
    """
    marks = Landmarks(landmarks)
    m = len(landmarks)
    gram = np.stack([kernel(np.repeat(marks.rows[i:i + 1], m, 0), marks.rows) for i in range(m)])
    gram /= np.sqrt(np.outer(marks.own, marks.own))
    root = np.zeros((len(POWERS) * m, len(POWERS) * m))
    for i, power in enumerate(POWERS):
        value, vector = np.linalg.eigh(gram ** power)
        root[i * m:(i + 1) * m, i * m:(i + 1) * m] = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.1))) @ vector.T
    powered = lambda values: np.concatenate([values ** power for power in POWERS], 1)
    # Nearest a landmark that 199 of 200 clean documents stay: what is no nearer teaches nothing about it.
    clean = np.array([bag.max(0) if len(bag) else np.zeros(m) for label, bag in zip(labels, bags) if not label])
    usual = np.quantile(np.repeat(clean, times[labels == 0].astype(int), 0), 0.995, axis=0)
    forms_of = [(k, form) for k, word in enumerate(landmarks) for form in misspelt(word)]
    near = marks.values([form for _, form in forms_of], PAIRS)
    spoilt = [[found.get(k, 0.0) for k in range(m)] for i, found in near.items()
              if found.get(forms_of[i][0], 0.0) > usual[forms_of[i][0]] + 0.02]
    spoilt = np.array(spoilt + [np.eye(m)[0]])  # and the first landmark itself, so that there is one
    x, y, n = [np.zeros((1, m)), spoilt], [[-1.0], np.ones(len(spoilt))], [[1.0], np.zeros(len(spoilt))]
    for label, bag, count in zip(labels, bags, times):
        if label and len(bag):
            bag = bag[bag.max(1) >= 0.9 * bag.max()]  # which sentence earned the label is not known
        x.append(bag)
        y.append(np.full(len(bag), 1.0 if label else -1.0))
        n.append(np.full(len(bag), float(count)))
    x, y, n = powered(np.concatenate(x)) @ root, np.concatenate(y), np.concatenate(n)
    n[1:1 + len(spoilt)] = max(n[y > 0].sum(), 1.0) / len(spoilt)
    balance = n * np.where(y > 0, 0.5 / n[y > 0].sum(), 0.5 / n[y < 0].sum())
    w, b, mean_w, mean_b = np.zeros(len(root)), 0.0, np.zeros(len(root)), 0.0
    for t in range(1, rounds + 1):
        hit = (y * (x @ w + b) < 1) * balance
        rate = 8.0 / np.sqrt(t)
        w = (1 - rate * 1e-4) * w + rate * ((hit * y) @ x)
        b += rate * float((hit * y).sum())
        mean_w, mean_b = mean_w + (w - mean_w) / t, mean_b + (b - mean_b) / t
    model = Model(landmarks, root @ mean_w, mean_b)
    bags = [*bags, *[row[None] for row in spoilt]]
    labels = np.concatenate([labels, np.ones(len(spoilt))]).astype(float)
    times = np.concatenate([times, np.full(len(spoilt), times[labels[:len(times)] > 0].sum() / len(spoilt))])
    margins = np.array([max([model.bias, *(powered(bag) @ model.weights + model.bias)]) for bag in bags])
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(model.slope * margins + model.offset, -50, 50)))
        model.slope += float(np.average((labels - p) * margins, weights=times))
        model.offset += float(np.average(labels - p, weights=times))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_docs: int = 8000, max_landmarks: int = 64,
        min_docs: int = 4, min_lift: float = 4.5, lift_share: float = 0.35, alike: float = 0.6) -> Model:
    """Fit on the ``max_docs`` labelled documents with the smallest hashed ids.

    Left out are those whose CRC-32 of the id as text is a multiple of 5.  Landmarks are at most
    ``max_landmarks`` words of ``SHORTEST`` to ``WIDTH`` characters without digits that stand in ``min_docs``
    toxic documents of the sample or more and there more often than their share by ``min_lift`` standard
    deviations, and by ``lift_share`` of what the foremost word shows; no two of them have a kernel value of
    ``alike`` or more.  Without labels of both kinds the model scores everything 0.

    The driver receives one row of whole numbers per different kind of document in the sample: its
    different sentences' kernel values and how many documents are like it.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.filter(F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0)).select(
        F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    chosen = marked.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(max_docs)
    sample = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .join(chosen, F.col("doc_id") == F.col("label_id")).select("label", F.coalesce("text", F.lit("")).alias("text"))
    )
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"^\W+|\W+$", "")))
    counts = (
        sample.select("label", F.explode(words).alias("word"))
        .filter(F.length("word").between(SHORTEST, WIDTH) & ~F.col("word").rlike("[0-9]"))
        .groupBy("word").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("docs"))
    )
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model([], np.zeros(0), -1.0, 1.0, -50.0)
    prior = sizes[1] / (sizes[0] + sizes[1])
    lift = (F.col("bad") - prior * F.col("docs")) / F.sqrt(prior * (1 - prior) * F.col("docs"))
    ranked = counts.filter(F.col("bad") >= min_docs).withColumn("lift", lift).filter(F.col("lift") > min_lift).orderBy(
        F.col("lift").desc(), "word").limit(10 * max_landmarks).collect()
    landmarks: list[str] = []
    for word in (r["word"] for r in ranked if r["lift"] >= lift_share * ranked[0]["lift"]):
        near = Landmarks(landmarks).values([word]).get(0, {}) if landmarks else {}
        if len(landmarks) < max_landmarks and max(near.values(), default=0.0) < alike:
            landmarks.append(word)
    if not landmarks:
        return Model([], np.zeros(0), -1.0, 1.0, -50.0)

    m = len(landmarks)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(Landmarks(landmarks))
        for _, (marks, texts) in rows_of(batches):
            bags = []
            for start in range(0, len(texts), 500):
                split = [document_words(t) for t in texts[start:start + 500]]
                memo.learn(set().union(*split))
                for words in split:
                    rows = np.zeros((0, m), "<u2")
                    if found := sentences(words, memo.known):
                        rows = np.unique([[round(STEPS * s.get(k, 0.0)) for k in range(m)] for s in found], axis=0).astype("<u2")
                    bags.append(rows.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int32()), pa.array(bags, pa.binary())], names=["label", "bag"])

    # Documents that are labelled several times, or whose ids repeat, all count.
    kinds = sample.mapInArrow(describe, "label int, bag binary").groupBy("label", "bag").count().orderBy("label", "bag").toArrow()
    bags = [np.frombuffer(bag, "<u2").reshape(-1, m) / STEPS for bag in kinds.column("bag").to_pylist()]
    return _train(landmarks, kinds.column("label").to_numpy(), bags, kinds.column("count").to_numpy().astype(float))


def _scores(memo: Memo, model: Model, texts: list[str | None]) -> list[float]:
    scores: list[float] = []
    for start in range(0, len(texts), 500):
        split = [document_words(t or "") for t in texts[start:start + 500]]
        memo.learn(set().union(*split))
        scores += [model.probability(model.margin(sentences(w, memo.known))) for w in split]
    return scores


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""
    bounded_batches(docs.sparkSession)
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo(Landmarks(model.landmarks))
        for batch in texts:
            yield pd.Series(_scores(memo, model, batch.tolist()), dtype="float64")

    return docs.filter(score(F.col(text_col)) < 0.5)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts get the score of a text without anything in common; rows may repeat; an
    empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(Landmarks(model.landmarks))
        for _, (ids, texts) in rows_of(batches):
            scores = _scores(memo, model, texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .mapInArrow(work, "doc_id long, score double")
        .select(F.col("doc_id").alias(id_col), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
                "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
