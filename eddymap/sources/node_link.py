"""Node-link JSON documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "id string, size string, count string, name string, group string"
LINK_SCHEMA = "source string, target string, value string"
# How the writer lays out a line that holds an object, and the only other lines it writes.
OBJECT = r"^\t\t(\{.*\}),?$"
FRAME = ("{", "}", "\t],", "\t]", '\t"nodes": [', '\t"links": [')


def _typed(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        nodes.select(
            F.col("id").cast("bigint"), F.col("size").cast("double"),
            F.col("count").cast("bigint"), "name", F.col("group").cast("bigint"),
        ),
        links.select(
            F.col("source").cast("bigint"), F.col("target").cast("bigint"),
            F.col("value").cast("double"),
        ),
    )


def _by_line(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects of a document in the writer's layout, one per line; a line that does not parse raises."""
    objects = lines.filter(~F.col("value").isin(*FRAME)).select(F.regexp_extract("value", OBJECT, 1).alias("object"))
    strict = {"mode": "FAILFAST"}

    def parsed(schema: str, key: str) -> DataFrame:
        named = F.col("object").startswith(F.lit(f'{{"{key}"'))
        return objects.filter(named).select(F.from_json("object", schema, strict).alias("o")).select("o.*")

    return _typed(parsed(NODE_SCHEMA, "id"), parsed(LINK_SCHEMA, "source"))


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``nodes (id, size, count, name, group)`` and ``links (source, target, value)``, typed.

    A document laid out as the writer does, every line an object or part of the frame, is read line by
    line in parallel.  Any other layout is parsed as one JSON value, by one task, since JSON cannot be
    split without knowing its layout.  What is not JSON raises.
    """
    lines = spark.read.text(path)
    fits = F.col("value").isin(*FRAME) | F.col("value").rlike(OBJECT)
    own = lines.agg(F.count_if(~F.coalesce(fits, F.lit(False))).alias("other"), F.count(F.lit(1)).alias("n")).first()
    if own["n"] and not own["other"]:
        return _by_line(lines)
    schema = f"nodes array<struct<{NODE_SCHEMA}>>, links array<struct<{LINK_SCHEMA}>>"
    schema = schema.replace(" string", ": string")
    whole = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return _typed(whole.select(F.inline("nodes")), whole.select(F.inline("links")))
