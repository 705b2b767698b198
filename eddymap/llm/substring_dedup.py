"""Substring dedup: passages that recur anywhere, located by sharded Aho-Corasick automata.

A window is ``width`` consecutive words.  Every window picks the smallest hash among the ``anchor``-word
shingles inside it; windows that are equal pick the same one at the same place, so a window can recur
only if its anchor does.  Windows in a row that share an anchor form a segment, and segments that are
equal are one from then on, however many documents hold them.

1. Anchors are counted; only segments of repeated anchors go on, merged by content with their number.
2. Segments are dealt to shards by anchor, so every occurrence of a window is in one shard.  There the
   windows that occur twice or more are confirmed and become phrases: a whole segment where an anchor
   has only one, else single windows.
3. Each shard compiles its phrases into automata of at most ``phrases`` entries over an alphabet of
   word codes, and streams all its segments through them; hits are checked on the words' hashes.
4. What was located goes back to every document that holds the segment; covered words are removed.

An anchor with more than ``crowded`` different segments would be too much for a shard: its segments are
cut to single windows, merged by content across the cluster, and dealt by window instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymap.llm.common import bounded_batches, cut, rows_of
from eddymap.llm.hashing import Spans, WordHashes, shingle_hashes

ANCHOR = 14
_LOW = np.uint64(0xFFFFFFFF)


def segments(words: np.ndarray, width: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each segment of a text; empty if it has no window."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = shingle_hashes(words, anchor)
    span = width - anchor + 1
    picks = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, span).argmin(1)
    first = np.flatnonzero(np.r_[True, picks[1:] != picks[:-1]])
    return grams[picks[first]], first, np.r_[first[1:] - 1, n - 1]


def _alphabet(codes: np.ndarray) -> str:
    """One character per 32-bit word code; different codes may share one."""
    points = codes % np.uint32(0x10F7FE) + np.uint32(1)
    points = np.where(points >= 0xD800, points + np.uint32(0x800), points).astype(np.uint32)
    return points.tobytes().decode("utf-32-le")


def locate(shard: list[tuple[int, int, int, bytes]], width: int, phrases: int) -> list[tuple[int, int, list[int], list[int]]]:
    """First and last starts of the runs of recurring windows, per ``(anchor, segment, times, codes)``.

    Segments without any are left out.
    """
    flat = np.frombuffer(b"".join(codes for *_, codes in shard), np.uint32)
    length_of = [len(codes) // 4 for *_, codes in shard]
    begins = np.cumsum([0, *length_of])
    counts = np.array(length_of) - width + 1
    firsts = np.cumsum([0, *counts.tolist()])  # number of the first window of each segment
    owner = np.repeat(np.arange(len(shard)), counts)
    offset = np.arange(firsts[-1]) - firsts[owner]
    places = begins[owner] + offset
    hashes = Spans(flat.astype(np.uint64) + np.uint64(1)).hashes(places, places + width)
    alone: dict[int, int] = {}
    for anchor, *_ in shard:
        alone[anchor] = alone.get(anchor, 0) + 1

    # Phrases to confirm: (hash, segment, start, length).
    whole = [i for i, (anchor, _, times, _) in enumerate(shard) if alone[anchor] == 1 and times > 1]
    single = [i for i, (anchor, *_) in enumerate(shard) if alone[anchor] > 1]
    todo = [(i, 0, length_of[i]) for i in whole]
    if single:
        mine = np.isin(owner, single)
        times = np.array([s[2] for s in shard], np.int64)[owner[mine]]
        _, where, inverse = np.unique(hashes[mine], return_index=True, return_inverse=True)
        often = np.bincount(inverse, weights=times) > 1
        of, at = owner[mine], offset[mine]
        todo += [(int(of[k]), int(at[k]), width) for k in where[often]]

    text = _alphabet(flat)
    streams = [text[a:b] for a, b in zip(begins.tolist(), begins[1:].tolist())]
    window, first_of = hashes.tolist(), firsts.tolist()
    starts: list[list[tuple[int, int]]] = [[] for _ in shard]
    for begin in range(0, len(todo), phrases):
        automaton = ahocorasick.Automaton()
        for i, start, length in todo[begin:begin + phrases]:
            phrase = streams[i][start:start + length]
            entries = automaton.get(phrase, None)
            if entries is None:
                automaton.add_word(phrase, [(i, start, length)])
            else:
                entries.append((i, start, length))
        automaton.make_automaton()
        for j, stream in enumerate(streams):
            for end, entries in automaton.iter(stream):
                for i, start, length in entries:
                    a = end + 1 - length
                    b = length - width  # windows of the phrase after its first
                    here, there = first_of[j] + a, first_of[i] + start
                    if window[here] == window[there] and window[here + b] == window[there + b]:
                        starts[j].append((a, a + b))
    found = []
    for (anchor, segment, *_), runs in zip(shard, starts):
        low: list[int] = []
        high: list[int] = []
        for a, b in sorted(set(runs)):
            if low and a <= high[-1] + 1:
                high[-1] = max(high[-1], b)
            else:
                low.append(a)
                high.append(b)
        if low:
            found.append((anchor, segment, low, high))
    return found


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _some(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit map of fixed size of the hashed values of a column; at most ``bits / 64`` rows are gathered."""
    place = F.col(column).bitwiseAND(bits - 1)
    found = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function(
        "shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits")).collect()
    table = np.zeros(bits // 64, np.int64)
    for r in found:
        table[r["word"]] = r["bits"]
    return table


def _among(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (len(table) * 64 - 1)
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35,
                   shard_rows: int = 8000, phrases: int = 20_000, crowded: int = 8000,
                   bits: int = 1 << 25, keep_text: bool = False) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` (and ``kept``, the text left) for every row of ``docs``.

    Words under a window that starts anywhere else too are removed; all windows are judged on the
    input.  Null and blank texts have no words; texts shorter than a window lose none; a row that
    repeats is another place; an empty table gives no rows; other columns are ignored.  Bit maps of
    fixed size (``bits``) drop most rows before the exact joins; when full they let everything pass.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for _, (ids, texts, keys) in rows_of(batches):
            columns: list[list] = [[] for _ in range(6)]
            for text in texts:
                words = _split(text)
                coded = hashes.of(words) if len(words) >= width else np.zeros(0, np.uint64)
                anchors, first, last = segments(coded, width)
                parts = Spans(coded).hashes(first, last + width) if len(first) else first.astype(np.uint64)
                for column, value in zip(columns, (len(words), _digest(words), anchors.view(np.int64), parts.view(np.int64),
                                                   first.astype(np.int32), last.astype(np.int32))):
                    column.append(value)
            lists = [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1])]
                + [pa.array(c, t) for c, t in zip(columns[2:], lists)],
                names=["doc_id", "key", "n_words", "digest", "anchors", "parts", "firsts", "lasts"])

    marks = cut(rows.mapInArrow(mark, "doc_id long, key long, n_words long, digest string, anchors array<long>,"
                                      " parts array<long>, firsts array<int>, lasts array<int>"), "repeat-marks")
    repeated = cut(marks.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
                   .filter("n > 1").select("anchor"), "repeat-anchors")
    anchor_bits = _some(repeated, "anchor", bits)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, *lists = batch.columns
            flat = [c.flatten().to_numpy() for c in lists]
            keep = _among(anchor_bits, flat[0])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists[0].offsets.to_numpy()))[keep]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner)), keys.take(pa.array(owner)), *[pa.array(x[keep]) for x in flat]],
                names=["doc_id", "key", "anchor", "part", "first", "last"])

    places = cut(
        marks.select("doc_id", "key", "anchors", "parts", "firsts", "lasts")
        .mapInArrow(held, "doc_id long, key long, anchor long, part long, first int, last int")
        .join(repeated, "anchor"), "repeat-places")
    distinct = cut(places.groupBy("anchor", "part").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "key", "first", "last")).alias("at")), "repeat-segments")
    many = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded).select(
        "anchor", F.lit(True).alias("split"))
    tasks = (
        distinct.join(cut(many, "repeat-crowded"), "anchor", "left")
        .groupBy(F.col("at.doc_id").alias("of_id"), F.col("at.key").alias("of_key"))
        .agg(F.collect_list(F.struct("anchor", "part", "times", "at.first", "at.last",
                                     F.coalesce("split", F.lit(False)).alias("split"))).alias("wanted"))
    )
    tasks = cut(tasks, "repeat-owners")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        schema = pa.schema([("anchor", pa.int64()), ("part", pa.int64()), ("times", pa.int64()), ("codes", pa.binary()),
                            ("of_anchor", pa.int64()), ("of_part", pa.int64()), ("start", pa.int32())])
        for _, (texts, wanted) in rows_of(batches, 128):
            out = []
            for text, segs in zip(texts, wanted):
                words = hashes.of(_split(text))
                codes = (words & _LOW).astype(np.uint32)
                for s in segs:
                    a, b = s["first"], s["last"]
                    if not s["split"]:
                        out.append((s["anchor"], s["part"], s["times"], codes[a:b + width].tobytes(), None, None, None))
                        continue
                    at = np.arange(a, b + 1)
                    for k, h in zip(at.tolist(), Spans(words).hashes(at, at + width).view(np.int64).tolist()):
                        out.append((h, h, s["times"], codes[k:k + width].tobytes(), s["anchor"], s["part"], k - a))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)] if out
                                             else [pa.array([], t.type) for t in schema], schema=schema)

    # A row that repeats yields its segments again; the shards skip these.
    owner_bits = _some(tasks.select(F.col("of_key")), "of_key", bits)

    def keyed(table: np.ndarray):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_among(table, batch.column(2).to_numpy())))
        return keep

    schema = "doc_id long, text string, key long"
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))
    pieces = cut(
        rows.mapInArrow(keyed(owner_bits), schema).join(tasks, same).select("text", "wanted")
        .mapInArrow(cut_out, "anchor long, part long, times long, codes binary, of_anchor long, of_part long, start int"), "repeat-pieces")
    lone = pieces.filter("of_anchor IS NOT NULL")
    dealt = pieces.filter("of_anchor IS NULL").select("anchor", "part", "times", "codes").unionByName(
        lone.groupBy("anchor", "part").agg(F.sum("times").alias("times"), F.first("codes").alias("codes"))
        .select("anchor", "part", "times", "codes"))
    shards = max(1, -(-distinct.count() // shard_rows))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard is complete when the next begins."""
        schema = pa.schema([("anchor", pa.int64()), ("part", pa.int64()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))])

        def done(shard):
            found = locate(shard, width, phrases)
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), schema)] if found
                                              else [pa.array([], t.type) for t in schema], schema=schema)
        now, held_ = None, []
        for _, (numbers, *columns) in rows_of(batches, 4096):
            for number, *row in zip(numbers, *columns):
                if number != now:
                    if held_:
                        yield done(held_)
                    now, held_ = number, []
                if not held_ or held_[-1][:2] != tuple(row[:2]):  # once, however often its owner's row repeats
                    held_.append(tuple(row))
        if held_:
            yield done(held_)

    located = cut(
        dealt.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        .repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", "anchor", "part")
        .select("shard", "anchor", "part", "times", "codes")
        .mapInArrow(stream, "anchor long, part long, low array<int>, high array<int>"), "repeat-located")
    back = lone.select("anchor", "of_anchor", "of_part", "start").join(located.select("anchor"), "anchor").groupBy(
        F.col("of_anchor").alias("anchor"), F.col("of_part").alias("part")).agg(
        F.array_sort(F.collect_set("start")).alias("low")).withColumn("high", F.col("low"))
    whole = located.join(lone.select(F.col("anchor")).distinct(), "anchor", "left_anti")
    runs = cut(whole.select("anchor", "part", "low", "high").unionByName(back), "repeat-runs")
    hit = cut(
        places.join(runs, ["anchor", "part"])
        .select("doc_id", "key", F.explode(F.zip_with("low", "high", lambda a, b: F.struct(
            (a + F.col("first")).alias("a"), (b + F.col("first")).alias("b")))).alias("run"))
        .groupBy(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key")).agg(F.collect_set("run").alias("runs")), "repeat-hits")
    hit_bits = _some(hit, "of_key", bits)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, keys, texts, found) in rows_of(batches):
            removed, digests, kept = [], [], []
            for text, runs_ in zip(texts, found):
                words = _split(text)
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, [r["a"] for r in runs_], 1)
                np.add.at(edges, [r["b"] + width for r in runs_], -1)
                stays = np.cumsum(edges[:-1]) == 0
                left = [w for w, s in zip(words, stays.tolist()) if s]
                removed.append(len(words) - len(left))
                digests.append(_digest(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass") if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests),
                 pa.array(kept, pa.string())], names=["of_id", "of_key", "n_removed", "stripped", "kept"])

    stripped = (
        rows.mapInArrow(keyed(hit_bits), schema).join(hit, same).select("doc_id", "key", "text", "runs")
        .mapInArrow(strip, "of_id long, of_key long, n_removed long, stripped string, kept string")
        .dropDuplicates(["of_id", "of_key"])
    )
    told = marks.select("doc_id", "key", "n_words", "digest").join(stripped, same, "left")
    columns = [F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
               F.coalesce("stripped", "digest").alias("kept_sha256")]
    return told.select(*columns, *(["kept"] if keep_text else []))
