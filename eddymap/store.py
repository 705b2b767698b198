"""Written tables that cut the lineage of iterative jobs.

Every loop in this package writes its state as Parquet under the folder named by
``spark.checkpoint.dir`` and reads it back.  A lost executor therefore costs at most the current
step, plans stay short, later steps read only the columns they need, and the size of the files tells
Spark whether a side may be broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Spark's own setting: the shuffle files of a query are deleted when it ends, not when the driver collects garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Tables are written once and read a few times: smaller files are worth the packing.
CODEC = "zstd"

_local_folders: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut tables: the session's setting, or a fresh one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    # One process runs everything: a temporary folder of its own serves, and the session is left alone.
    name = spark.sparkContext.applicationId
    if name not in _local_folders:
        _local_folders[name] = tempfile.mkdtemp(prefix="eddymap-")
    return _local_folders[name]


@contextmanager
def moved_files_go(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files: what they moved is in the written table, and nothing asks for it again."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)


@dataclass
class Written:
    """A table on shared storage together with the metrics gathered while it was written."""

    df: DataFrame
    path: str
    stats: dict = field(default_factory=dict)
    store: "Store | None" = None
    table: str | None = None

    @property
    def rows(self) -> int:
        return self.stats["rows"]

    def drop(self) -> None:
        """Delete the files; call only when a newer table has replaced this one."""
        if self.table:
            self.store.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.store.delete(self.path)


class Store:
    """A private folder of written tables, removed when the driver's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_root(spark)}/eddymap-{uuid.uuid4().hex}"
        self._count = 0
        self._live: dict[int, Written] = {}
        path = self._hadoop_path(self.folder)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def _hadoop_path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def delete(self, path: str) -> None:
        self._live = {number: table for number, table in self._live.items() if table.path != path}
        self._fs.delete(self._hadoop_path(path), True)

    def _next_path(self, name: str) -> str:
        self._count += 1
        return f"{self.folder}/{self._count:05d}-{name}"

    def cut(self, df: DataFrame, name: str, keep: Column | None = None, **metrics: Column) -> Written:
        """Write ``df`` in one job that also computes ``metrics``, and read it back.

        The metrics are taken in the writing stage, where Spark counts each finished task once, so
        a retried task does not distort them.  With ``keep`` they see all rows, but only those for which it
        is true are written.
        """
        path = self._next_path(name)
        seen = Observation()
        columns = [F.count(F.lit(1)).alias("rows")]
        columns += [metric.alias(key) for key, metric in metrics.items()]
        observed = df.observe(seen, *columns)
        with moved_files_go(self.spark):
            (observed if keep is None else observed.filter(keep)).write.option("compression", CODEC).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        written = self._live[self._count] = Written(table, path, seen.get, self)
        return written

    def cut_in_buckets(self, df: DataFrame, name: str, buckets: int, *by: str, placed: bool = False) -> Written:
        """Write ``df`` as a table with one file per bucket of the columns ``by``, and read it back.

        A join on these columns reads each bucket in place and moves only the other side.  ``placed`` says that
        ``df`` is already laid out in as many partitions by these columns.
        """
        path = self._next_path(name)
        table = f"eddymap_{uuid.uuid4().hex}"
        laid = df if placed else df.repartition(buckets, *by)
        with moved_files_go(self.spark):
            (laid.write.bucketBy(buckets, *by).option("path", path)
             .option("compression", CODEC).saveAsTable(table, format="parquet"))
        written = self._live[self._count] = Written(self.spark.table(table), path, {}, self, table)
        return written

    def mark(self) -> int:
        """A point in time for :meth:`drop_since`."""
        return self._count

    def written_since(self, mark: int) -> list[Written]:
        """The tables written after ``mark`` that have not been dropped."""
        return [table for number, table in self._live.items() if number > mark]

    def drop_since(self, mark: int, *kept: Written) -> None:
        """Delete the tables written after ``mark`` that have not been dropped, but for ``kept``."""
        paths = {table.path for table in kept}
        for table in self.written_since(mark):
            if table.path not in paths:
                table.drop()
