"""Rows linked to their successors: graphs of transitions from ordered records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddymap.store import Store


# Rows of one key that a single task sorts; busier keys are laid out in blocks.
ROWS_PER_KEY = 1_000_000
# Keys are counted in this many cells of their hash, so that finding the busy ones moves next to nothing.
CELLS = 1 << 16


def cell_of(key: str) -> Column:
    """The cell that a key is counted in."""
    return F.pmod(F.xxhash64(key), F.lit(CELLS))


def with_next(
    rows: DataFrame, key: str, order: list[str], carried: list[str], store: Store | None = None,
    rows_per_key: int = ROWS_PER_KEY,
) -> DataFrame:
    """``rows`` with a column ``next``: the ``carried`` columns of the next row of the same key, or null.

    Rows move once, to their key's task.  Keys in a cell of more than ``rows_per_key`` rows are instead laid out
    by range of ``(key, order)``, so that one key may fill many blocks.  Rows that tie in ``order`` follow each
    other in the order of the input.  ``rows`` is read once more for the counts.
    """
    store = store or Store(rows.sparkSession)
    busy = store.cut(
        rows.groupBy(cell_of(key).alias("_cell")).count().filter(F.col("count") > rows_per_key).select("_cell"), "busy-cells")
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    if not busy.rows:
        return _next_in_key(numbered, key, order, carried)
    numbered = numbered.withColumn("_cell", cell_of(key))
    few = numbered.join(busy.df, "_cell", "left_anti").drop("_cell")
    many = numbered.join(busy.df, "_cell", "left_semi").drop("_cell")
    return _next_in_key(few, key, order, carried).unionByName(_next_in_blocks(many, key, order, carried, store))


def _next_in_key(numbered: DataFrame, key: str, order: list[str], carried: list[str]) -> DataFrame:
    # Rows that agree in all columns are one as good as the other; their numbers need not be moved.
    ties = ["_tie"] if set(numbered.columns) - {key, *order, "_tie"} else []
    inside = Window.partitionBy(key).orderBy(*order, *ties)
    return numbered.withColumn("next", F.lead(F.struct(*carried)).over(inside)).drop("_tie")


def _next_in_blocks(
    numbered: DataFrame, key: str, order: list[str], carried: list[str], store: Store
) -> DataFrame:
    """The next row inside a block; the last row of a block looks at the first row of the following one."""
    placed = store.cut(
        numbered.repartitionByRange(key, *order, "_tie").withColumn("_block", F.spark_partition_id()), "placed").df
    # One row per block: its first, and after that the first of the following block.
    firsts = placed.groupBy("_block").agg(
        F.min_by(F.struct(F.col(key).alias("key"), F.struct(*carried).alias("row")),
                 F.struct(key, *order, "_tie")).alias("first")
    )
    # Written, so that its size is known and the join moves only these few rows.
    onward = store.cut(
        firsts.select("_block", F.lead("first").over(Window.orderBy("_block")).alias("_onward")), "next-blocks").df
    inside = Window.partitionBy("_block", key).orderBy(*order, "_tie")
    return (
        placed.withColumn("next", F.lead(F.struct(*carried)).over(inside))
        .join(onward, "_block")
        .withColumn("next", F.coalesce("next", F.when(
            F.lead("_tie").over(inside).isNull() & F.col("_onward.key").eqNullSafe(F.col(key)), F.col("_onward.row"))))
        .drop("_block", "_tie", "_onward")
    )
