"""Token-ID files: a concatenated id array with Elias-Fano encoded document boundaries.

Documents are encoded, each followed by an end id, and written in ascending id order (null first) as
binary files.  A file is a row of segments, each followed by a line feed::

    magic, shard, segment, n_docs, n_nulls, n_ids, bytes per id    fixed head
    doc_id of every document                                       8 bytes each, ascending
    where each document ends                                       Elias-Fano code with select samples
    ids                                                            2 or 4 bytes each, by the vocabulary's size

No table of 64-bit offsets exists: a boundary costs two bits and the bits of the mean length, and
``select`` finds one document's place without unpacking the others.  Shards are ranges of ``(id, place in
the input)``, so equal ids may fill several of them.  A task holds one segment at a time, a segment is
closed after ``SEGMENT_IDS`` ids, and a document lies in one segment.  Files are written by Spark's own
commit, so a lost task is written again.

A null text counts as empty; a null id is kept and comes first; repeated rows are kept, those of equal id
in the order of the input; further columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eddymap.llm.common import bounded_batches, cut, rows_of
from eddymap.llm.elias_fano import EliasFano
from eddymap.llm.stretches import Memo, byte_level, encode_apart, stretches

MAGIC = b"EFTOKENS"
_HEAD = struct.Struct("<8sQQQQQB")
#: Ids after which a segment is closed, and segments in a file.
SEGMENT_IDS, FILE_SEGMENTS = 1 << 21, 8
#: Characters of text that a shard holds, about.
SHARD_CHARS = 32 << 20
#: Stretches that a worker remembers.
MEMO = 600_000
_MEMOS: dict = {}

READ = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("segment", pa.int64()), ("segment_ids", pa.int64()),
                  ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
READ_SQL = "doc_id long, shard long, segment long, segment_ids long, place long, n_tokens long, ids_crc32 long"


def encode_texts(texts: list[str | None], spec: str, dtype: str = "<u2", memo: int = MEMO) -> Iterator[bytes]:
    """Ids of each text as bytes; the worker's memory of stretches outlives a task."""
    key = (hash(spec), dtype, memo)
    if key not in _MEMOS:
        vocabulary = byte_level(spec)
        _MEMOS[key] = Memo(lambda parts: encode_apart(vocabulary, parts, dtype), memo)
    known = _MEMOS[key]
    for start in range(0, len(texts), 64):
        some = [stretches(text) if text else [] for text in texts[start:start + 64]]
        known.learn(set().union(*some))
        for parts in some:
            yield b"".join(map(known.__getitem__, parts))


def segment_bytes(shard: int, segment: int, doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One segment; null ids lead."""
    nulls = sum(i is None for i in doc_ids)
    ends = np.cumsum([len(part) // width for part in ids], dtype=np.int64)
    head = _HEAD.pack(MAGIC, shard, segment, len(ids), nulls, int(ends[-1]) if len(ends) else 0, width)
    return b"".join([head, np.array([i or 0 for i in doc_ids], "<i8").tobytes(), EliasFano.of(ends).to_bytes(), *ids])


class Segment:
    """A segment inside the bytes of a file; nothing is unpacked before it is asked for."""

    def __init__(self, data: bytes, at: int = 0):
        magic, self.shard, self.number, self.n_docs, self.nulls, self.n_ids, self.width = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        self.ends, at = EliasFano.from_bytes(data, at + 8 * self.n_docs)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)
        self.stop = at + self.n_ids * self.width

    def span(self, i: int) -> tuple[int, int]:
        """Where document ``i`` starts and ends in the segment's ids."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def named(self, doc_id: int) -> range:
        """Positions of the documents with this id."""
        known = self.doc_ids[self.nulls:]
        return range(*(np.searchsorted(known, doc_id, side) + self.nulls for side in ("left", "right")))


def segments(data: bytes) -> Iterator[Segment]:
    at = 0
    while at < len(data):
        segment = Segment(data, at)
        yield segment
        at = segment.stop + 1  # a line feed stands behind each


def write_files(
    docs: DataFrame, path: str, spec: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    shard_chars: int = SHARD_CHARS, segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write ``docs`` under ``path``; ``spec`` is the text of a ``tokenizers`` file.

    Texts are moved once, by range; they are encoded where they are written.
    """
    bounded_batches(docs.sparkSession)
    width = 2 if len(byte_level(spec).lengths) <= 1 << 16 else 4
    dtype = f"<u{width}"
    end = np.array([end_id], dtype).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, doc_ids, ids, held = 0, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"data": pa.array([segment_bytes(shard, number, doc_ids, ids, width)], pa.binary())})

        for _, (names, texts, shards) in rows_of(batches):
            for name, own, data in zip(names, shards, encode_texts(texts, spec, dtype)):
                if ids and (own != shard or held >= segment_ids):
                    yield closed()
                    number, doc_ids, ids, held = (number + 1 if own == shard else 0), [], [], 0
                shard = own
                doc_ids.append(name)
                ids.append(data + end)
                held += len(ids[-1]) // width
        if ids:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    placed = (
        rows.withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(max(-(-chars // shard_chars), 1), "doc_id", "place")
        .sortWithinPartitions("doc_id", "place")
        .select("doc_id", "text", F.spark_partition_id().cast("long").alias("shard"))
    )
    (placed.mapInArrow(write, "data binary").select(F.col("data").cast("string"))
     .write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document's place and checksum: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` is the number of ids in all documents before it; places in a segment come from its own
    boundaries, and the sizes of segments and shards are summed over what the files say.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (contents,) in rows_of(batches, 1):
            for s in segments(contents[0]):
                ends = s.ends.all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = s.ids.astype("<u4")
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(starts, ends)]
                same = np.ones(s.n_docs, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(s.doc_ids, pa.int64(), mask=np.arange(s.n_docs) < s.nulls), pa.array(same * s.shard),
                    pa.array(same * s.number), pa.array(same * s.n_ids), pa.array(starts), pa.array(ends - starts),
                    pa.array(sums, pa.int64())], schema=READ)

    found = cut(_files(spark, path).mapInArrow(read, READ_SQL), "token-places")
    parts = found.select("shard", "segment", "segment_ids").distinct()
    # One row per shard: shards hold SHARD_CHARS characters, so this stays a short table.
    shards = parts.groupBy("shard").agg(F.sum("segment_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("segment_start", F.coalesce(F.sum("segment_ids").over(inside), F.lit(0))).join(shards, "shard")
    return found.join(starts.select("shard", "segment", "segment_start", "shard_start"), ["shard", "segment"]).select(
        "doc_id", (F.col("shard_start") + F.col("segment_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """``doc_id, ids`` of all documents, or of those with the ``wanted`` ids, found by select alone."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (contents,) in rows_of(batches, 1):
            for s in segments(contents[0]):
                picked = range(s.n_docs) if wanted is None else [i for doc_id in wanted for i in s.named(doc_id)]
                for i in picked:
                    start, stop = s.span(i)
                    name = None if i < s.nulls else int(s.doc_ids[i])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name], pa.int64()), pa.array([s.ids[start:stop].astype(np.int64)], pa.list_(pa.int64()))],
                        names=["doc_id", "ids"])

    return _files(spark, path).mapInArrow(read, "doc_id long, ids array<long>")
