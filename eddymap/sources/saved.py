"""A saved result read back: graph and partition from the four tables that :mod:`eddymap.sinks` writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddymap.functions.flow_math import codelength_value, plogp
from eddymap.graph import EDGE_SCHEMA, VERTEX_SCHEMA, Graph, Partition
from eddymap.operators.partition import module_sums

MODULE_SCHEMA = T.StructType([
    T.StructField("module", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("p", T.DoubleType()), T.StructField("w", T.DoubleType()), T.StructField("q", T.DoubleType()),
])
TABLES = {"graph-vertices": VERTEX_SCHEMA, "graph-edges": EDGE_SCHEMA, "part-vertices": MODULE_SCHEMA, "part-edges": EDGE_SCHEMA}


def checked(table: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """``table`` by position under the names of ``schema``; raises where a column is missing or of another kind.

    Whole numbers may be narrower than the schema says and become as wide; nothing else is converted.
    """
    if len(table.columns) < len(schema):
        raise ValueError(f"{what} has {len(table.columns)} columns, {len(schema)} are needed: {', '.join(schema.names)}")
    narrow = (T.ByteType, T.ShortType, T.IntegerType)
    for got, want in zip(table.schema, schema):
        widened = isinstance(want.dataType, T.LongType) and isinstance(got.dataType, narrow)
        if got.dataType != want.dataType and not widened:
            raise ValueError(f"{what}: column {got.name!r} is {got.dataType.simpleString()},"
                             f" {want.name!r} must be {want.dataType.simpleString()}")
    return table.toDF(*[f"_{i}" for i in range(len(table.columns))]).select(
        *[F.col(f"_{i}").cast(field.dataType).alias(field.name) for i, field in enumerate(schema)])


def read_saved(spark: SparkSession, path: str, kind: str = "parquet", tele: float = 0.15, suffix: str = "") -> tuple[Graph, Partition]:
    """The graph and partition that ``save(..., {kind: path})`` wrote, with the partition's sums taken anew.

    ``kind`` is ``parquet`` or ``text``; ``suffix`` names a state saved during the search.  The tables do not
    hold the teleport rate, nor the frequency of single vertices: ``prob_sum`` is exact for a state in
    which every vertex is a module, and not a number otherwise, as is the code length then.
    """
    from eddymap.sinks.save import split_path

    stem, ext = split_path(path)
    tables = {}
    for name, schema in TABLES.items():
        where = f"{stem}-{name}{suffix}{ext}"
        read = spark.read.parquet(where) if kind == "parquet" else spark.read.schema(schema).option("mode", "FAILFAST").csv(where)
        tables[name] = checked(read, schema, where)
    modules, links = tables["part-vertices"], tables["part-edges"]
    sums = modules.agg(F.count(F.lit(1)).alias("modules"), F.sum("n").alias("n"), F.expr(f"sum({plogp('p')})").alias("own"),
                       *[column.alias(key) for key, column in module_sums().items()]).first()
    prob_sum = sums["own"] if sums["n"] == sums["modules"] else float("nan")
    return Graph(tables["graph-vertices"], tables["graph-edges"]), Partition(
        modules=modules, links=links, n_nodes=sums["n"] or 0, tele=tele, prob_sum=prob_sum, q_sum=sums["q_sum"],
        codelength=codelength_value(sums["modules"], sums["q_sum"], sums["terms"], prob_sum) if sums["modules"] else 0.0,
        n_modules=sums["modules"], n_links=links.count(),
    )
