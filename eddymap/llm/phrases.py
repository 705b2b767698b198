"""Phrases whose words stand together more often than chance, per language.

Every word of the corpus is the start of one suffix, kept as a window of up to ``longest`` words.  The
windows are routed globally by their leading words: sorted by range over all tasks.  Inside a range a
multikey three-way quicksort of window pointers, to the full depth, leaves partitions that are equal in
their first words; the size of such a partition is the count of the phrase.  A partition smaller than
``least`` is abandoned with all it holds.  A range's first and last window may share words with its
neighbours, so their phrases are always handed on, and partial counts are summed afterwards.

A window ends where a word or a pair of words is certainly rare: ``2 ** sketch_bits`` counters, each the
sum of all words and pairs that hash to it and so never too small, are added up over the corpus first.  Only
counters that were hit are kept and moved, so their number may be far larger than the corpus; of those that
reach ``least``, one bit each goes to the tasks.  It only shortens windows that could not count: no phrase of
``least`` occurrences holds a rare word or pair.  The window of a rare word is that word, and only adds to its language's
total; it is in no range.  Windows with equal 64-bit hashes are summed inside a task before they are moved.

A null text is empty, a null language reads ``und``; ids are not read, repeated rows count each time,
further columns are ignored, an empty table has no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddymap.llm.common import bounded_batches, cut, parts_of
from eddymap.llm.hashing import joined, mixed, places, powers, text_bounds, word_hashes

#: Signs and line ends that end a piece; blank and tab part words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: For each byte: 0 in a word, 1 between words, 2 between pieces.
_KINDS = bytes(2 if byte in PIECE_ENDS else byte in b" \t" for byte in range(256))
SKETCH_BITS, BLOCKS = 32, 512
#: Words and pairs that a task counts at a time, windows that it holds before it hands them on, and windows of a range.
HELD_SLOTS, HELD_WINDOWS, RANGE_WINDOWS = 1 << 22, 1 << 21, 100_000
#: Rows that are sorted at once.
FEW_ROWS = 4096
#: Bytes of texts that such windows lie in, and bytes of windows in a batch.
HELD_BYTES, WINDOW_BYTES = 1 << 26, 1 << 22
#: Bits that tell the tasks which counters reach the limit: this many times as many as those, within these powers of two.
SPARE_BITS, LEAST_BITS, MOST_BITS = 32, 10, 28
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words:
    """The words of a batch of texts, in lower case (A to Z alone), and what their windows need."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.data = joined(texts)
        kinds = self.data.translate(_KINDS)
        self.start, self.stop = places(kinds)
        self.inside = np.frombuffer(kinds, np.uint8) == 0
        self.hashes = word_hashes(self.data, self.start, self.stop)
        self.sizes = np.diff(text_bounds(texts, self.start))
        # The texts are parted by line ends, so no piece reaches into the next text.
        piece = np.cumsum(np.frombuffer(kinds, np.uint8) == 2, dtype=np.int32)[self.start]
        self.follows = piece[1:] == piece[:-1]
        names = langs.dictionary_encode()
        self.langs = names.dictionary
        self.lang = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), self.sizes)
        name_hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs.to_pylist()], np.uint64)
        self.codes = name_hashes[self.lang] if len(name_hashes) else np.zeros(0, np.uint64)

    def slots(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The counter of each word, and of each word and the next."""
        top = np.uint64(64 - bits)
        words = mixed(self.hashes + self.codes) >> top
        pairs = mixed(self.hashes[:-1] * _ODD + self.hashes[1:] + self.codes[:-1]) >> top
        return words.astype(np.uint32), pairs.astype(np.uint32)

    def windows(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of the windows of ``lengths`` words, one from each word on, bytes that hold the words with one blank between each, and where
        the windows start and how long they are there."""
        keys, at = self.codes.copy(), np.arange(len(lengths))
        for k, power in enumerate(powers(int(lengths.max(initial=0)))):
            longer = np.flatnonzero(lengths > k)
            keys[longer] += self.hashes[longer + k] * power
        keys = mixed(keys + lengths.astype(np.uint64) * _ODD)
        kept = self.inside.copy()
        kept[self.stop] = True
        data = np.frombuffer(self.data, np.uint8).copy()
        data[self.stop] = 32
        ends = np.cumsum(self.stop - self.start + 1)
        starts = ends - (self.stop - self.start) - 1
        return keys, data[kept], starts, (ends[at + lengths - 1] - 1 - starts[at]).astype(np.int32)


def _packed(x: np.ndarray) -> bytes:
    """32-bit numbers, their lowest bytes first, so that small ones pack well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _added(slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots in order, and the sum of the counts of each."""
    order = np.argsort(slots)
    slots = slots[order]
    first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]][:len(slots)])
    return slots[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else counts[:0].astype(np.int64)


def often_counters(rows: DataFrame, least: int, bits: int, held: int = HELD_SLOTS) -> np.ndarray:
    """Bits, as bytes, of the leading bits of all counters that reach ``least``; their number is a power of two."""
    if least >= 1 << 31:
        raise ValueError("least must be below 2 ** 31")
    if not 1 <= bits <= 32:
        raise ValueError("sketch_bits must be 1 to 32")
    below = max(bits - (BLOCKS - 1).bit_length(), 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            found = np.concatenate(slots) if slots else np.zeros(0, np.uint32)
            slots.clear()
            found.sort()
            first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]][:len(found)])
            counts = np.minimum(np.diff(np.r_[first, len(found)]), least)
            found = found[first]
            cuts = np.flatnonzero(np.diff(found >> np.uint32(below), prepend=-1))
            parts = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)]))
            # Within a block the slots are written as their steps.
            return pa.RecordBatch.from_arrays([
                pa.array([int(found[a]) >> below for a, _ in parts], pa.int64()),
                pa.array([_packed(np.diff(found[a:b], prepend=np.uint32(0))) for a, b in parts], pa.binary()),
                pa.array([_packed(counts[a:b]) for a, b in parts], pa.binary())], names=["block", "slots", "counts"])

        for part in parts_of(batches, 0):
            words = _Words(part.column(0), part.column(1))
            one, two = words.slots(bits)
            slots += [one, two[words.follows]]
            if sum(map(len, slots)) > held:
                yield summed()
        yield summed()

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for block, slots, counts in zip(*(column.to_pylist() for column in batch.columns)):
                # No sum needs to be larger than the limit.
                own = blocks.setdefault(block, [])
                own.append((np.cumsum(_unpacked(slots), dtype=np.uint32), _unpacked(counts)))
                if len(own) > 64:
                    slots_, sums = _added(*map(np.concatenate, zip(*own)))
                    own[:] = [(slots_, np.minimum(sums, least).astype(np.uint32))]
        for block, own in blocks.items():
            slots_, sums = _added(*map(np.concatenate, zip(*own)))
            slots_ = slots_[sums >= least]
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(slots_)], pa.int64()), "slots": pa.array([slots_.astype("<u4").tobytes()], pa.binary())})

    counted = rows.mapInArrow(count, "block long, slots binary, counts binary").repartition("block")
    found = cut(counted.mapInArrow(reach, "n long, slots binary"), "often")
    n = found.agg(F.sum("n")).first()[0] or 0
    kept = min(max((n * SPARE_BITS).bit_length(), LEAST_BITS), MOST_BITS, max(bits, 3))
    often = np.zeros(1 << kept - 3, np.uint8)
    for row in found.select("slots").toLocalIterator():
        at = np.frombuffer(row["slots"], "<u4") >> np.uint32(bits - kept) if bits > kept else np.frombuffer(row["slots"], "<u4")
        np.bitwise_or.at(often, at >> np.uint32(3), np.uint8(1) << (at & np.uint32(7)).astype(np.uint8))
    return often


def windows_of(rows: DataFrame, often: np.ndarray, longest: int, bits: int, held: int = HELD_WINDOWS) -> DataFrame:
    """``lang, window, often, n``: the words from every word on, up to ``longest`` or to a rare word or pair; partial sums.

    ``often`` tells whether the first word may occur ``least`` times.
    """
    shared = rows.sparkSession.sparkContext.broadcast(often)
    kept_bits = (8 * len(often)).bit_length() - 1

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, shift = shared.value, np.uint32(max(bits - kept_bits, 0))
        waiting: list[tuple[np.ndarray, ...]] = []  # keys, bytes, starts, sizes, languages, whether often
        langs: dict[str, int] = {}

        def is_often(slots: np.ndarray) -> np.ndarray:
            at = slots >> shift
            return (often[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & 1 == 1

        def rows_held() -> Iterator[pa.RecordBatch]:
            if waiting:
                moved = np.cumsum([0] + [len(data) for _, data, *_ in waiting])
                keys = np.concatenate([keys for keys, *_ in waiting])
                order = np.argsort(keys)
                keys = keys[order]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                n, one = np.diff(np.r_[first, len(keys)]), order[first]
                data = np.concatenate([data for _, data, *_ in waiting])
                start = np.concatenate([start + by for (_, _, start, *_), by in zip(waiting, moved)])[one]
                size, lang, first_often = (np.concatenate([held_[i] for held_ in waiting])[one] for i in (3, 4, 5))
                names = pa.array(list(langs), pa.string())
                waiting.clear()
                a, total = 0, np.cumsum(size)
                while a < len(one):
                    b = min(max(int(np.searchsorted(total, total[a] + WINDOW_BYTES)), a + 1), a + 50_000, len(one))
                    sizes = size[a:b]
                    ends = np.cumsum(sizes)
                    text = data[np.arange(ends[-1]) + np.repeat(start[a:b] - ends + sizes, sizes)]
                    offsets = pa.py_buffer(np.r_[0, ends].astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(lang[a:b])), pa.StringArray.from_buffers(b - a, offsets, pa.py_buffer(text)),
                         pa.array(first_often[a:b]), pa.array(n[a:b], pa.int64())], names=["lang", "window", "often", "n"])
                    a = b
            langs.clear()

        for part in parts_of(batches, 0):
            words = _Words(part.column(0), part.column(1))
            one, two = words.slots(bits)
            going = is_often(one)
            pairs = np.zeros(len(one) + longest, bool)
            pairs[:len(two)] = is_often(two) & words.follows & going[1:]
            first = going.copy()
            lengths = np.ones(len(one), np.int64)
            for k in range(longest - 1):
                going &= pairs[k:k + len(one)]
                lengths += going
            if len(one):
                numbers = np.array([langs.setdefault(name, len(langs)) for name in words.langs.to_pylist()], np.int32)
                waiting.append((*words.windows(lengths), numbers[words.lang], first))
            if sum(len(keys) for keys, *_ in waiting) > held or sum(len(data) for _, data, *_ in waiting) > HELD_BYTES:
                yield from rows_held()
        yield from rows_held()

    return rows.mapInArrow(take, "lang string, window string, often boolean, n long")


def _sorted_partitions(codes: np.ndarray, weights: np.ndarray, least: int, rows: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The sets that :func:`_partitions` finds among a few ``rows`` equal in their first ``depth`` keys, by sorting these."""
    own = codes[rows, depth:]
    order = np.lexsort(own.T[::-1])
    rows, own = rows[order], own[order]
    weight = weights[rows]
    changes = np.logical_or.accumulate(own[1:] != own[:-1], axis=1)
    for k in range(own.shape[1]):
        first = np.flatnonzero(np.r_[True, changes[:, k]])
        sums = np.add.reduceat(weight, first)
        kept = (sums >= least) & (own[first, k] >= 0)
        yield rows[first[kept]], np.full(int(kept.sum()), depth + k + 1), sums[kept]


def _partitions(codes: np.ndarray, weights: np.ndarray, least: int, few: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows, depths and weights of the sets that :func:`equal_partitions` describes."""
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        rows, depth = stack.pop()
        if not len(rows) or int(weights[rows].sum()) < least:
            continue
        if len(rows) <= few:
            yield from _sorted_partitions(codes, weights, least, rows, depth)
            continue
        keys = codes[rows, depth]
        sample = np.sort(keys[::max(len(keys) // 33, 1)])
        pivot = sample[len(sample) // 2]
        equal = rows[keys == pivot]
        stack += [(rows[keys < pivot], depth), (rows[keys > pivot], depth)]
        if pivot < 0:
            continue
        weight = int(weights[equal].sum())
        if weight >= least:
            yield equal[:1], np.array([depth + 1]), np.array([weight])
            if depth + 1 < codes.shape[1]:
                stack.append((equal, depth + 1))


def equal_partitions(codes: np.ndarray, weights: np.ndarray, least: int, few: int = FEW_ROWS) -> Iterator[tuple[int, int, int]]:
    """``(row, depth, weight)`` of every set of rows equal in their first ``depth`` keys, weighing ``least`` or more.

    Multikey three-way quicksort of row pointers: a set is parted by one key into smaller, equal and
    greater rows; the equal ones go on with the next key.  ``-1`` stands behind a row's last key.  Sets
    that weigh less are abandoned unsorted; those of at most ``few`` rows are sorted by all their keys at once.
    """
    for found in _partitions(codes, weights, least, few):
        yield from zip(*(x.tolist() for x in found))


def _outermost(codes: np.ndarray, last: bool) -> int:
    """The first row in the order of the keys, or the last."""
    rows = np.arange(len(codes))
    for depth in range(codes.shape[1]):
        keys = codes[rows, depth]
        rows = rows[keys == (keys.max() if last else keys.min())]
    return int(rows[0])


def _ranks(names: pa.Array) -> np.ndarray:
    """A number for each name, in the order of their bytes."""
    named = names.dictionary_encode()
    rank = np.empty(len(named.dictionary), np.int64)
    rank[pc.sort_indices(named.dictionary.cast(pa.large_binary())).to_numpy()] = np.arange(len(rank))
    return rank[named.indices.to_numpy()]


def count_range(langs: pa.Array, windows: pa.Array, n: np.ndarray, longest: int, least: int) -> pa.RecordBatch:
    """``lang, phrase, n_words, part`` of one range, which holds whole equal partitions but for its two ends."""
    split = pc.split_pattern(windows, " ")
    sizes = pc.list_value_length(split).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    codes = np.full((len(sizes), longest + 1), -1, np.int64)
    codes[:, 0] = _ranks(langs)
    codes[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = _ranks(split.flatten())
    rows, depths, weights = (np.concatenate(x) for x in zip(
        *_partitions(codes, n, least, FEW_ROWS), (np.zeros(0, np.int64),) * 3))
    for end in {_outermost(codes, False), _outermost(codes, True)}:
        same = np.ones(len(codes), bool)
        for depth in range(1, 2 + int(sizes[end])):
            same &= codes[:, depth - 1] == codes[end, depth - 1]
            again = (depths == depth) & same[rows]
            rows, depths, weights = (np.r_[x[~again], y] for x, y in zip((rows, depths, weights), (end, depth, int(n[same].sum()))))
    parts = []
    for depth in range(2, longest + 2):
        at = np.flatnonzero(depths == depth)
        taken = pa.array(rows[at])
        words = pc.list_slice(split.take(taken), 0, depth - 1)
        parts.append(pa.RecordBatch.from_arrays(
            [langs.take(taken), pc.binary_join(words, " "), pa.array(np.full(len(at), depth - 1)), pa.array(weights[at].astype(np.int64))],
            names=["lang", "phrase", "n_words", "part"]))
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def phrase_counts(windows: DataFrame, longest: int, least: int, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """``lang, phrase, n_words, f`` of all phrases of 1 to ``longest`` words with ``f >= least``."""
    schema = "lang string, phrase string, n_words long, part long"

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(batch.num_rows for batch in held):
            return
        table = pa.Table.from_batches(held)
        yield count_range(*(table.column(c).combine_chunks() for c in ("lang", "window")), table.column("n").to_numpy(), longest, least)

    n = max(-(-windows.count() // range_windows), 1)
    parts = windows.repartitionByRange(n, "lang", F.split("window", " ")).mapInArrow(sort, schema)
    return parts.groupBy("lang", "phrase", "n_words").agg(F.sum("part").alias("f")).filter(F.col("f") >= least)


def _exact(*columns: Column | str) -> Column:
    """A product of whole numbers in 38 digits."""
    total = F.lit(1).cast("decimal(38,0)")
    for column in columns:
        total = (total * F.col(column).cast("decimal(19,0)") if isinstance(column, str) else total * column).cast("decimal(38,0)")
    return total


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, top: int = 2000,
    sketch_bits: int = SKETCH_BITS, range_windows: int = RANGE_WINDOWS, held: int = HELD_WINDOWS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` words.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts at its weakest cut, ``n`` all words; the score is
    ``floor(1000 * a * n / (l * r))`` in exact arithmetic.  A phrase that a longer one holds whenever it
    occurs is left out.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    often = often_counters(rows, least, sketch_bits)
    parts = windows_of(rows, often, longest, sketch_bits, held)
    windows = cut(parts.groupBy("lang", "window", "often").agg(F.sum("n").alias("n")), "windows")
    counts = cut(phrase_counts(windows.filter("often"), longest, least, range_windows), "phrase-counts")
    sizes = windows.groupBy("lang").agg(F.sum("n").alias("n"))  # one row per language

    words = F.split("phrase", " ")
    candidates = counts.filter("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), words.alias("words"))
    part = counts.select("lang", F.col("phrase").alias("part"), "f")
    cuts = candidates.select("lang", "phrase", "a", "words", "n_words", F.explode(F.sequence(F.lit(1), (F.col("n_words") - 1).cast("int"))).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("words", F.col("k") + 1, F.lit(longest)), " ").alias("rest"))
    scored = (
        cuts.join(part.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .join(sizes, "lang")
        .withColumn("over", _exact(F.lit(1000).cast("decimal(4,0)"), "a", "n")).withColumn("under", _exact("l", "r"))
        .withColumn("score", F.expr("over div under"))
        .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("weakest"))
    )
    # What a longer phrase holds: all shorter runs of its words, with the largest count of such a phrase.
    spans = [(i, k) for k in range(2, longest) for i in range(longest - k + 1)]
    held_in = (
        candidates.filter("n_words > 2").select("lang", "a", F.explode(F.array(*[
            F.when(F.lit(i + k) <= F.col("n_words"), F.when(F.lit(k) < F.col("n_words"), F.array_join(F.slice("words", i + 1, k), " ")))
            for i, k in spans])).alias("phrase"))
        .filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    left = scored.join(held_in, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        left.select("lang", "phrase", "a", "weakest.l", "weakest.r", "n", "weakest.score")
        .withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
