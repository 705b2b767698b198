"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eddymap.store import Store

#: Character class of the white space that separates words everywhere in this subpackage.
BLANK = r"\x20\x09-\x0D"
WORD_PATTERN = f"[^{BLANK}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read back."""
    return Store(df.sparkSession).cut(df, name).df


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, where the session has not set less.

    Texts are long: the default of 10,000 rows a batch is held several times on either side of a
    Python worker's pipe.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1))), F.lit(0)).cast("long")


def row_print(doc_id: Column, text: Column) -> Column:
    """128 bits that tell rows apart: rows with the same id and text are interchangeable."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(doc_id.cast("string"), F.lit("-")),
                             F.when(text.isNull(), "0").otherwise("1"), text))


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Slices of at most ``size`` rows with their columns as Python lists, so that few texts are held twice."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield part, [column.to_pylist() for column in part.columns]


def parts_of(batches: Iterator[pa.RecordBatch], *texts: int, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and ``size`` bytes in the columns ``texts``, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in texts)
        total, start = np.cumsum(length), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = min(max(int(np.searchsorted(total, before + size, "right")), start + 1), start + rows)
            part = batch.slice(start, stop - start)
            yield part
            start += part.num_rows
