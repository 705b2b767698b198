"""Alignment of two tokenizers over a corpus, by fragments that compose.

Both token sequences of a document spell the same bytes.  Offsets where tokens of both end cut the
sequences into groups; a token of one and a token of the other are linked where their bytes overlap.

The part of a document that a task sees is a :class:`Fragment`: tokens before the first shared end
(open prefix), closed groups, tokens behind the last shared end (open suffix).  Fragments of
neighbouring byte ranges compose, the suffix of one and the prefix of the next closing a group, and
composition is associative.  So a very long document is cut into byte ranges that are encoded by
different tasks, and its fragments are folded as a tree, ``FOLD`` neighbours at a time.

How often an id pair is linked is counted over all documents: sums per task first, then one aggregate.
The heaviest pairs, at most ``heavy``, reach the second pass as a broadcast of that fixed size; all other
links are joined with the table of counts.

A null or empty text, and one whose tokens do not spell it, has no tokens: zeros and an empty digest.
Null ids and repeated rows are kept as rows of their own; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymap.llm.common import bounded_batches, cut, rows_of
from eddymap.llm.stretches import Memo, byte_level, encode_apart, sentence_pieces, stretches

#: Bytes of a byte range, and fragments that one step of the tree composes.
RANGE, FOLD = 1 << 16, 8
#: Pairs whose counts are broadcast: 16 bytes each.
HEAVY = 1 << 20
#: Stretches that a worker remembers, and distinct pairs it counts before it hands them on.
MEMO, HELD_PAIRS = 500_000, 1_000_000
#: A link is one number: the first id times this, plus the second.
SHIFT = 1 << 16
_MEMOS: dict = {}


def links_of(a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Codes of all overlapping pairs of two sequences over the same bytes.

    Between two neighbouring ends of either sequence lies exactly one token of each, and two tokens that
    overlap share exactly one such stretch.
    """
    ends = np.union1d(a_ends, b_ends)
    return a_ids[np.searchsorted(a_ends, ends)] * SHIFT + b_ids[np.searchsorted(b_ends, ends)]


_DIGITS = list(map(str, range(SHIFT)))


def group_list(a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Every group as text, ``a1,a2|b1``, and the offset where it ends."""
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    i, j = (np.searchsorted(a_ends, shared) + 1).tolist(), (np.searchsorted(b_ends, shared) + 1).tolist()
    a, b = [_DIGITS[x] for x in a_ids.tolist()], [_DIGITS[x] for x in b_ids.tolist()]
    return [f"{a[p]}|{b[r]}" if q - p == s - r == 1 else f"{','.join(a[p:q])}|{','.join(b[r:s])}"
            for p, q, r, s in zip([0, *i], i, [0, *j], j)], shared


def groups_text(a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[str, int]:
    """The groups as text, ``a1,a2|b1;a3|b2,b3``, and their number."""
    groups, _ = group_list(a_ids, b_ids, a_ends, b_ends)
    return ";".join(groups), len(groups)


@dataclass
class Fragment:
    """What is known of a byte range: open prefix, closed groups, open suffix.

    ``cut`` tells whether any end is shared; if none is, all tokens stand in the prefix.  ``a`` and ``b``
    are ids, ``na`` and ``nb`` the byte lengths that go with them.
    """

    good: bool = True
    cut: bool = False
    prefix: tuple = ((), (), (), ())  # ids and byte lengths of A, then of B
    text: str = ""
    groups: int = 0
    n_a: int = 0
    n_b: int = 0
    links: list = field(default_factory=list)  # bytes of link codes inside closed groups
    suffix: tuple = ((), (), (), ())


EMPTY = ((), (), (), ())


def _joined(x: tuple, y: tuple) -> tuple:
    return tuple((*p, *q) for p, q in zip(x, y))


def _closed(tokens: tuple) -> tuple[str, int, int, bytes]:
    """A group from the tokens of a suffix and a prefix; its last bytes are a shared end."""
    a, na, b, nb = (np.array(t, np.int64) for t in tokens)
    text, _ = groups_text(a, b, np.cumsum(na), np.cumsum(nb))
    return text, len(a), len(b), links_of(a, b, np.cumsum(na), np.cumsum(nb)).astype("<u4").tobytes()


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring byte ranges; associative, with ``Fragment()`` as identity."""
    good = x.good and y.good
    if not x.cut:
        return Fragment(good, y.cut, _joined(x.prefix, y.prefix), y.text, y.groups, y.n_a, y.n_b, x.links + y.links, y.suffix)
    between = _joined(x.suffix, y.prefix)
    if not y.cut:
        return Fragment(good, True, x.prefix, x.text, x.groups, x.n_a, x.n_b, x.links, between)
    texts, groups, n_a, n_b, links = [x.text], x.groups, x.n_a + y.n_a, x.n_b + y.n_b, x.links
    if any(between):
        text, a, b, codes = _closed(between)
        texts, groups, n_a, n_b, links = [*texts, text], groups + 1, n_a + a, n_b + b, [*links, codes]
    text = ";".join([t for t in (*texts, y.text) if t])
    return Fragment(good, True, x.prefix, text, groups + y.groups, n_a, n_b, [*links, *y.links], y.suffix)


def fragment_of(
    a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, start: int, stop: int,
    a_lengths: np.ndarray, b_lengths: np.ndarray,
) -> Fragment:
    """The fragment of the tokens that end in ``(start, stop]``; ends count from the document's beginning."""
    keep_a, keep_b = (a_ends > start) & (a_ends <= stop), (b_ends > start) & (b_ends <= stop)
    a, b, ea, eb = a_ids[keep_a], b_ids[keep_b], a_ends[keep_a], b_ends[keep_b]
    shared = np.intersect1d(ea, eb, assume_unique=True)

    def tokens(p: int, q: int, r: int, s: int) -> tuple:
        return (tuple(a[p:q].tolist()), tuple(a_lengths[a[p:q]].tolist()), tuple(b[r:s].tolist()), tuple(b_lengths[b[r:s]].tolist()))

    if not len(shared):
        return Fragment(prefix=tokens(0, len(a), 0, len(b)))
    i, k = np.searchsorted(ea, shared[[0, -1]]) + 1
    j, m = np.searchsorted(eb, shared[[0, -1]]) + 1
    inner = a[i:k], b[j:m], ea[i:k], eb[j:m]
    text, groups = groups_text(*inner) if k > i else ("", 0)
    links = [links_of(*inner).astype("<u4").tobytes()] if k > i else []
    return Fragment(True, True, tokens(0, i, 0, j), text, groups, int(k - i), int(m - j), links, tokens(k, len(a), m, len(b)))


class Aligner:
    """Two vocabularies and what a worker remembers of stretches: ``(n_a, n_b, groups, text, links)``."""

    def __init__(self, spec: str, model: bytes, memo: int = MEMO):
        self.a, self.b = byte_level(spec), sentence_pieces(model)
        self.known = Memo(self._aligned, memo)

    def _spelt(self, parts: list[str]) -> tuple[list[bytes], list[bytes], list[int], list[bool]]:
        """Ids of every part by both vocabularies, its number of bytes, and whether both spell it."""
        a, b, data = encode_apart(self.a, parts), encode_apart(self.b, parts), [part.encode() for part in parts]

        def same(own_a: bytes, own_b: bytes, text: bytes) -> bool:
            ids = np.frombuffer(own_b, "<u2")
            return int(self.a.lengths[np.frombuffer(own_a, "<u2")].sum()) == len(text) and self.b.spells(ids, text)

        every = same(b"".join(a), b"".join(b), b"".join(data))
        return a, b, list(map(len, data)), [every or same(*row) for row in zip(a, b, data)]

    def _aligned(self, parts: list[str]) -> list[tuple | None]:
        """All parts at once: each ends where tokens of both end, so their concatenation has their groups."""
        a, b, sizes, good = self._spelt(parts)
        known = iter(self._aligned_spelt(*(list(compress(x, good)) for x in (a, b, sizes))))
        return [next(known) if fine else None for fine in good]

    def _aligned_spelt(self, a: list[bytes], b: list[bytes], sizes: list[int]) -> Iterator[tuple]:
        a_ids, b_ids = (np.frombuffer(b"".join(x), "<u2").astype(np.int64) for x in (a, b))
        a_ends, b_ends, stops = np.cumsum(self.a.lengths[a_ids]), np.cumsum(self.b.lengths[b_ids]), np.cumsum(sizes)
        groups, shared = group_list(a_ids, b_ids, a_ends, b_ends)
        ends = np.union1d(a_ends, b_ends)
        codes = (a_ids[np.searchsorted(a_ends, ends)] * SHIFT + b_ids[np.searchsorted(b_ends, ends)]).astype("<u4").tobytes()
        i = j = 0
        for own_a, own_b, p, q in zip(a, b, (np.searchsorted(shared, stops) + 1).tolist(), ((np.searchsorted(ends, stops) + 1) * 4).tolist()):
            yield len(own_a) // 2, len(own_b) // 2, p - i, ";".join(groups[i:p]), codes[j:q]
            i, j = p, q

    def document(self, text: str) -> Fragment:
        """A whole document: stretches end where both vocabularies' tokens end."""
        known = list(map(self.known.__getitem__, stretches(" " + text)))
        if None in known:
            return Fragment(good=False)
        n_a, n_b, groups, texts, links = zip(*known)
        return Fragment(True, True, EMPTY, ";".join(texts), sum(groups), sum(n_a), sum(n_b), list(links))

    def learn(self, texts: list[str | None]) -> None:
        self.known.learn(set().union(*[stretches(" " + text) for text in texts if text]))

    def range(self, text: str, at: int, start: int, stop: int) -> Fragment:
        """The byte range ``(start, stop]`` of a document; ``text`` covers it and begins at byte ``at``."""
        a, b, _, good = self._spelt(stretches(text))
        if not all(good):
            return Fragment(good=False)
        a, b = (np.frombuffer(b"".join(x), "<u2").astype(np.int64) for x in (a, b))
        ends = at + np.cumsum(self.a.lengths[a]), at + np.cumsum(self.b.lengths[b])
        return fragment_of(a, b, *ends, start, stop, self.a.lengths, self.b.lengths)


def aligner(spec: str, model: bytes, memo: int = MEMO) -> Aligner:
    key = (hash(spec), hash(model), memo)
    if key not in _MEMOS:
        _MEMOS[key] = Aligner(spec, model, memo)
    return _MEMOS[key]


def byte_ranges(text: str, size: int) -> Iterator[tuple[int, int, int, str]]:
    """``(start, stop, at, part)``: byte ranges of blank + ``text`` and the stretches that each touches.

    A range boundary is any multiple of ``size``, wherever it falls in a word; boundaries inside one very
    long stretch are left out but for its first, so that no stretch is encoded more than twice.
    """
    parts = stretches(" " + text)
    ends = np.cumsum([len(part.encode()) for part in parts])
    total = int(ends[-1])
    cuts = [0]
    for boundary in range(size, total, size):
        if np.searchsorted(ends, boundary) > np.searchsorted(ends, cuts[-1]) or cuts[-1] == 0:
            cuts.append(boundary)
    cuts.append(total)
    for start, stop in zip(cuts, cuts[1:]):
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop))
        yield start, stop, int(ends[first - 1]) if first else 0, "".join(parts[first:last + 1])


# --- Spark ---------------------------------------------------------------------------------------

# Rows of the first pass: a document (uid not null), or a partial count of a pair.
_ALIGNED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                      ("groups_sha256", pa.string()), ("links", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())])
_ALIGNED_SQL = ("uid long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pair long, n long")
# The id travels as text: pandas would turn null ids into floating numbers.
_FRAGMENT_SQL = ("uid long, doc_id string, place long, good boolean, cut boolean, text string, groups long, n_a long, n_b long, "
                 "links binary, prefix array<array<long>>, suffix array<array<long>>")


class _Pairs:
    """Counts of link codes, handed on when many different ones are held."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, codes: np.ndarray) -> None:
        found, counts = np.unique(codes, return_counts=True)
        self.parts.append((found, counts))
        self.held += len(found)

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = (np.concatenate(x) for x in zip(*self.parts))
        found, back = np.unique(codes, return_inverse=True)
        self.parts = [(found, np.bincount(back, weights=counts).astype(np.int64))]
        self.held = len(found)
        return self.parts[0]

    def rows(self, last: bool = False) -> pa.RecordBatch | None:
        """Partial counts, once enough are held (or at the ``last`` call)."""
        if not self.parts or not (last or self.held > 4 * HELD_PAIRS):
            return None
        codes, counts = self.summed()
        if not last and self.held <= HELD_PAIRS:
            return None
        self.parts, self.held = [], 0
        return _batch(pair=codes.astype(np.int64), n=counts)


def _batch(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _ALIGNED], schema=_ALIGNED)


def _document_rows(found: list[tuple[int, int | None, Fragment]]) -> pa.RecordBatch:
    """Rows of whole documents, whose prefix has been closed."""
    rows = []
    for uid, doc_id, f in found:
        if not f.good or not f.cut:
            rows.append((uid, doc_id, 0, 0, 0, "", b""))
        else:
            rows.append((uid, doc_id, f.n_a, f.n_b, f.groups, hashlib.sha256(f.text.encode()).hexdigest(), b"".join(f.links)))
    return _batch(**dict(zip(_ALIGNED.names[:7], zip(*rows))))


def _aligned_short(texts: DataFrame, spec: str, model: bytes, memo: int) -> DataFrame:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs = aligner(spec, model, memo), _Pairs()
        for _, (uids, names, texts) in rows_of(batches, 128):
            own.learn(texts)
            out = _document_rows([(u, i, own.document(t) if t else Fragment(good=False)) for u, i, t in zip(uids, names, texts)])
            pairs.add(np.frombuffer(b"".join(out.column("links").to_pylist()), "<u4"))
            yield out
            if (counted := pairs.rows()) is not None:
                yield counted
        if (counted := pairs.rows(last=True)) is not None:
            yield counted

    return texts.mapInArrow(align, _ALIGNED_SQL)


def _row(uid, doc_id, place, f: Fragment) -> dict:
    return {"uid": uid, "doc_id": doc_id, "place": place, "good": f.good, "cut": f.cut, "text": f.text, "groups": f.groups,
            "n_a": f.n_a, "n_b": f.n_b, "links": b"".join(f.links), "prefix": [list(t) for t in f.prefix],
            "suffix": [list(t) for t in f.suffix]}


def _fragment(row) -> Fragment:
    return Fragment(row.good, row.cut, tuple(map(tuple, row.prefix)), row.text, row.groups, row.n_a, row.n_b,
                    [row.links] if row.links else [], tuple(map(tuple, row.suffix)))


def _aligned_long(texts: DataFrame, spec: str, model: bytes, size: int, fold: int) -> DataFrame:
    """Long documents: byte ranges encoded apart, fragments folded as a tree."""
    parts_schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.string()), ("place", pa.int64()), ("start", pa.int64()),
                              ("stop", pa.int64()), ("at", pa.int64()), ("part", pa.string())])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (uids, names, texts) in rows_of(batches, 1):
            for place, (start, stop, at, part) in enumerate(byte_ranges(texts[0], size)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip((uids[0], names[0], place, start, stop, at, part), parts_schema)],
                    schema=parts_schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner(spec, model, 1)
        for _, columns in rows_of(batches, 16):
            rows = [_row(uid, name, place, own.range(part, at, start, stop)) for uid, name, place, start, stop, at, part in zip(*columns)]
            yield pa.RecordBatch.from_pylist(rows, schema=fragments_schema)

    tokens = pa.list_(pa.list_(pa.int64()))
    fragments_schema = pa.schema([
        ("uid", pa.int64()), ("doc_id", pa.string()), ("place", pa.int64()), ("good", pa.bool_()), ("cut", pa.bool_()),
        ("text", pa.string()), ("groups", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("links", pa.binary()),
        ("prefix", tokens), ("suffix", tokens)])

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        total = Fragment()
        for row in rows.itertuples():
            total = compose(total, _fragment(row))
        return pd.DataFrame([_row(int(rows["uid"].iloc[0]), rows["doc_id"].iloc[0], int(rows["place"].iloc[0]) // fold, total)])

    long_sql = "uid long, doc_id string, place long, start long, stop long, at long, part string"
    parts = cut(texts.mapInArrow(ranges, long_sql), "byte-ranges")
    most = parts.agg(F.max("place").alias("n")).first()["n"]
    fragments = parts.repartition("uid", "place").mapInArrow(encode, _FRAGMENT_SQL)
    left = (most or 0) + 1
    while left > 1:
        fragments = fragments.groupBy("uid", F.floor(F.col("place") / fold).alias("step")).applyInPandas(folded, _FRAGMENT_SQL)
        left = -(-left // fold)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs()
        for batch in batches:
            for row in batch.to_pylist():
                f = _fragment(SimpleNamespace(**row))
                # A document's beginning is a shared boundary, so the prefix is its first group.
                whole = compose(Fragment(cut=True), f)
                out = _document_rows([(row["uid"], None if row["doc_id"] is None else int(row["doc_id"]), whole)])
                pairs.add(np.frombuffer(out.column("links")[0].as_py(), "<u4"))
                yield out
                if (counted := pairs.rows()) is not None:
                    yield counted
        if (counted := pairs.rows(last=True)) is not None:
            yield counted

    return fragments.mapInArrow(finish, _ALIGNED_SQL)


def align_documents(
    docs: DataFrame, spec: str, model: bytes, id_col: str = "doc_id", text_col: str = "text",
    range_bytes: int = RANGE, fold: int = FOLD, heavy: int = HEAVY, memo: int = MEMO,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > 2 * range_bytes, F.lit(False))
    short = cut(_aligned_short(rows.filter(~is_long), spec, model, memo), "aligned")
    # The two kinds are numbered apart: their jobs may split the input differently.
    texts = cut(rows.filter(is_long).select((-1 - F.col("uid")).alias("uid"), F.col("doc_id").cast("string"), "text"), "long-texts")
    lengthy = cut(_aligned_long(texts, spec, model, range_bytes, fold), "aligned-long")
    aligned = short.unionByName(lengthy)
    return with_counts(aligned, heavy)


def with_counts(aligned: DataFrame, heavy: int) -> DataFrame:
    """The second pass: links looked up in the corpus-wide counts."""
    spark = aligned.sparkSession
    counts = cut(aligned.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    second = F.pmod("pair", F.lit(SHIFT))
    # One row per id of the second vocabulary.
    best = cut(counts.groupBy(second.alias("b")).agg(F.max("n").alias("most")), "best-counts")
    judged = cut(counts.join(F.broadcast(best), second == best["b"]).select("pair", "n", (F.col("n") == F.col("most")).alias("is_best")), "judged-pairs")
    top = judged.orderBy(F.desc("n"), "pair").limit(heavy).toArrow()
    codes, n, is_best = (top.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "is_best"))
    order = np.argsort(codes)
    known = spark.sparkContext.broadcast((codes[order].astype(np.uint32), n[order], is_best[order]))

    found_sql = "uid long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long, rare array<struct<pair: long, times: long>>"
    found_schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                              ("groups_sha256", pa.string()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()),
                              ("rare", pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, is_best = known.value
        for _, (uids, names, n_a, n_b, groups, digests, links) in rows_of(batches, 256):
            sizes = np.array([len(x) // 4 for x in links])
            flat = np.frombuffer(b"".join(links), "<u4")
            unique, back = np.unique(flat, return_inverse=True)
            at = np.minimum(np.searchsorted(codes, unique), max(len(codes) - 1, 0))
            hit = codes[at] == unique if len(codes) else np.zeros(len(unique), bool)
            row = np.repeat(np.arange(len(links)), sizes)
            value = np.where(hit, n[at], 0) if len(codes) else np.zeros(len(unique), np.int64)
            top = hit & is_best[at] if len(codes) else hit
            starts = np.concatenate([[0], np.cumsum(sizes)])
            sums = np.concatenate([[0], np.cumsum(value[back])])
            bests = np.concatenate([[0], np.cumsum(top[back])])
            rare: list[list[dict]] = [[] for _ in links]
            if not hit.all():
                missed = ~hit[back]
                pairs, times = np.unique(row[missed].astype(np.int64) << 32 | flat[missed], return_counts=True)
                for pair, k in zip(pairs.tolist(), times.tolist()):
                    rare[pair >> 32].append({"pair": pair & 0xFFFFFFFF, "times": k})
            yield pa.RecordBatch.from_arrays([
                pa.array(v, f.type) for v, f in zip((
                    uids, names, n_a, n_b, groups, digests, sizes, np.diff(bests[starts]), np.diff(sums[starts]), rare), found_schema)],
                schema=found_schema)

    rows = aligned.filter("uid IS NOT NULL").select("uid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    found = cut(rows.mapInArrow(look_up, found_sql), "looked-up")
    known.unpersist()
    # What the broadcast does not hold: one row per document and pair, joined with the counts.
    rest = (
        found.select("uid", F.inline("rare")).join(judged, "pair").groupBy("uid")
        .agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"))
    )
    return found.join(rest, "uid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")
