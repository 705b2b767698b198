"""Document fingerprints from prefix polynomial hashes.

``Prefix`` holds, for each of two primes, the running sums ``c[i] * B**i`` over the code points of a
text.  Two lookups and one multiplication give the hash of any span, so equality of spans takes
constant time and the longest common extension of two positions a binary search.

A fingerprint is the text's length, the hashes of its beginnings and endings at a fixed grid of
lengths that grow by a quarter, and those of the spans that its content cuts it into.  Two fingerprints
share the grid, so a binary search finds the longest beginning and ending they agree on; between these
count the spans that both have.  Their likeness is the share of the longer text this covers.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymap.llm.common import bounded_batches, rows_of

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_013)
#: A text is cut behind a window of ``WINDOW`` code points whose hash is a multiple of ``EVERY``; all
#: spans but the last have from ``WINDOW`` to ``LONGEST`` code points.
WINDOW, EVERY, LONGEST = 16, 32, 256


def grid(limit: int) -> list[int]:
    """1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, ... up to ``limit``."""
    out, length = [], 1
    while length <= limit:
        out.append(length)
        length = max(length + 1, length * 5 // 4)
    return out


class Prefix:
    """Prefix arrays of a text, to be asked for hashes of spans."""

    _powers: list[np.ndarray] = [np.ones(1, np.int64) for _ in PRIMES]

    @classmethod
    def powers(cls, n: int, which: int) -> np.ndarray:
        """``B**0 .. B**n`` modulo the prime, doubled when too short."""
        have, prime, base = cls._powers[which], PRIMES[which], BASES[which]
        while len(have) <= n:
            have = np.concatenate([have, have * pow(base, len(have), prime) % prime])
        cls._powers[which] = have
        return have

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        self.n = len(codes)
        self.sums = []
        for which, prime in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(codes * self.powers(self.n, which)[:self.n] % prime, out=sums[1:])
            self.sums.append(sums % prime)

    def span(self, start, stop) -> np.ndarray:
        """62-bit hash of ``text[start:stop]``, for numbers or arrays of them."""
        start, stop = np.asarray(start), np.asarray(stop)
        parts = []
        for which, prime in enumerate(PRIMES):
            inverse = self._inverse(which, self.n)
            parts.append((self.sums[which][stop] - self.sums[which][start]) % prime * inverse[start] % prime)
        return (parts[0] << 31) | parts[1]

    _inverses: list[np.ndarray] = [np.ones(1, np.int64) for _ in PRIMES]

    @classmethod
    def _inverse(cls, which: int, n: int) -> np.ndarray:
        have, prime = cls._inverses[which], PRIMES[which]
        back = pow(BASES[which], -1, prime)
        while len(have) <= n:
            have = np.concatenate([have, have * pow(back, len(have), prime) % prime])
        cls._inverses[which] = have
        return have

    def cuts(self) -> list[int]:
        """Where content cuts the text, from 0 to its end."""
        ends = np.arange(WINDOW, self.n + 1)
        prime, inverse = PRIMES[0], self._inverse(0, self.n)
        hashes = (self.sums[0][ends] - self.sums[0][:len(ends)]) % prime * inverse[:len(ends)] % prime
        out = [0]
        for end in [*ends[hashes % EVERY == 0].tolist(), self.n]:
            while end - out[-1] > LONGEST:
                out.append(out[-1] + LONGEST)
            if end - out[-1] >= WINDOW or out[-1] < end == self.n:
                out.append(end)
        return out

    def equal(self, start: int, other: Prefix, other_start: int, length: int) -> bool:
        return int(self.span(start, start + length)) == int(other.span(other_start, other_start + length))

    def extension(self, start: int, other: Prefix, other_start: int) -> int:
        """Length of the longest common run from two positions on."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(start, other, other_start, middle) else (low, middle - 1)
        return low


class Fingerprint:
    """Length, span hashes of beginnings and endings at the grid, and of the spans between cuts."""

    def __init__(self, text: str):
        at = np.array(grid(len(text)), np.int64)
        prefix = Prefix(text)
        self.n = prefix.n
        self.whole = int(prefix.span(0, self.n))
        low = (1 << 32) - 1
        self.heads = prefix.span(np.zeros_like(at), at) & low
        self.tails = prefix.span(self.n - at, np.full_like(at, self.n)) & low
        self.cuts = np.array(prefix.cuts(), np.int64)
        self.spans = prefix.span(self.cuts[:-1], self.cuts[1:]) & low

    def between(self, start: int, stop: int) -> Counter:
        """How often each (length, hash) occurs among the spans inside ``start..stop``."""
        a, b = np.searchsorted(self.cuts, start), np.searchsorted(self.cuts, stop, "right")
        return Counter(zip(np.diff(self.cuts[a:b]).tolist(), self.spans[a:max(b - 1, a)].tolist()))

    def __str__(self) -> str:
        return ".".join([f"{self.n:x}", f"{self.whole:x}", *(x.astype(t).tobytes().hex() for x, t in (
            (self.heads, ">u4"), (self.tails, ">u4"), (np.diff(self.cuts), ">u2"), (self.spans, ">u4")))])


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the longer text that both have: beginning and ending on the grid, and spans between them."""
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    lengths = grid(min(a.n, b.n))
    covered = []
    for mine, theirs in ((a.heads, b.heads), (a.tails, b.tails)):
        low, high = 0, len(lengths)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if mine[middle - 1] == theirs[middle - 1] else (low, middle - 1)
        covered.append(lengths[low - 1] if low else 0)
    head, tail = covered
    shared = a.between(head, a.n - tail) & b.between(head, b.n - tail)
    return min(head + tail + sum(length * times for (length, _), times in shared.items()), min(a.n, b.n)) / max(a.n, b.n)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come as runs ``(part, doc_id descending)``, each run closed by the row that follows it."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    last = None
    for _, (parts, ids, texts, closing) in rows_of(batches):
        out = []
        for part, doc_id, text, close in zip(parts, ids, texts, closing):
            now = (part, doc_id, text or "", Fingerprint(text or ""))
            if last is not None and last[0] == part:
                _, of, text, print_ = last
                half = len(text) // 2
                edited = text[:len(text) - half] + now[2][:half]
                edited_print = Fingerprint(edited)
                out.append((of, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(print_),
                            str(edited_print), likeness(print_, edited_print), likeness(print_, now[3])))
            last = None if close else now
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)] if out
                                         else [pa.array([], t.type) for t in schema], schema=schema)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          rows_per_part: int = 2000, max_parts: int = 20_000) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    In the edited text the last ``n // 2`` code points give way to as many first ones (or all) of the
    next document in descending id order; the first follows the last.  Ids are cut into ranges of
    about ``rows_per_part`` rows (``max_parts`` ranges at most; the driver holds three numbers for each); each range is one sorted run, closed by a copy of the row that
    follows it, so texts move once and no row waits for more than its neighbour.

    A null text is empty.  Repeated ids follow each other by text, null ids come last; a single row
    is its own successor; an empty table gives no rows; other columns are ignored.  Returns
    ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    parts = max(1, min(counted // rows_per_part, max_parts))
    marks = [i / parts for i in range(1, parts)]
    bounds = rows.select(F.percentile_approx("doc_id", marks, 10 * parts).alias("b")).first()["b"] if marks else []
    splits = [float("-inf"), *sorted({float(b) for b in bounds or []}), float("inf")]
    # Parts count down from the largest ids; Bucketizer finds the range by binary search.
    placed = rows.withColumn("as_double", F.col("doc_id").cast("double"))
    if len(splits) > 2:
        placed = Bucketizer(splits=splits, inputCol="as_double", outputCol="range", handleInvalid="keep").transform(placed)
    else:
        placed = placed.withColumn("range", F.lit(0.0))
    placed = placed.select("doc_id", "text", F.when(F.col("doc_id").isNull(), len(splits)).otherwise(
        len(splits) - 1 - F.col("range")).cast("int").alias("part"))
    # One row per part: its first id and, of equal ids, the first text by digest.
    # The bitwise complement turns the order round and exists for the smallest id as well.
    order = F.struct(F.bitwise_not(F.col("doc_id")).alias("minus"), F.md5("text").alias("digest"))
    firsts = {r["part"]: r["first"] for r in placed.groupBy("part").agg(F.min(order).alias("first")).collect()}
    used = sorted(firsts)
    closes = {following: part for part, following in zip(used, used[1:] + used[:1])}
    # Four values per part, so at most `max_parts` rows are broadcast.
    heads = F.broadcast(docs.sparkSession.createDataFrame(
        [(p, closes[p], *firsts[p]) for p in used], "of int, closes int, minus long, digest string"))
    closing = (
        placed.join(heads, (F.col("part") == F.col("of")) & F.bitwise_not(F.col("doc_id")).eqNullSafe(F.col("minus"))
                    & (F.md5("text") == F.col("digest")))
        .groupBy(F.col("closes").alias("part"))
        .agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.lit(True).alias("close"))
    )
    runs = (
        placed.select("part", "doc_id", "text", F.lit(False).alias("close")).unionByName(closing)
        .repartition(max(len(used), 1), "part")
        .sortWithinPartitions("part", "close", F.col("doc_id").desc_nulls_last(), F.md5("text"))
    )
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
              " near_edited double, near_next double")
    return runs.mapInArrow(_printed, schema).withColumnRenamed("doc_id", id_col)
