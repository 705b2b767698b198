"""Statistics of a result: modules, components, degrees, histograms, subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddymap.operators.components import connected_components
from eddymap.store import Store


def module_components(
    modules: DataFrame, links: DataFrame, store: Store | None = None
) -> DataFrame:
    """``(module, label)``: weakly connected component of each module; an isolated one is its own."""
    labels = connected_components(links.select("src", "dst"), store).df
    return modules.join(labels.withColumnRenamed("id", "module"), "module", "left").select(
        "module", F.coalesce("label", "module").alias("label")
    )


def component_sizes(
    modules: DataFrame, links: DataFrame, store: Store | None = None
) -> DataFrame:
    """``(label, modules)`` per weakly connected component."""
    return module_components(modules, links, store).groupBy("label").agg(
        F.count(F.lit(1)).alias("modules")
    )


def expected_share(modules: DataFrame) -> Column:
    """One over the number of modules, as a scalar for predicates on the same table."""
    return modules.agg(F.lit(1.0) / F.count(F.lit(1))).scalar()


def is_singleton() -> Column:
    return F.col("n") == 1


def is_small(share: Column) -> Column:
    return F.col("p") <= share


def is_significant(share: Column) -> Column:
    return (F.col("n") > 1) & (F.col("p") > share)


def module_stats(
    modules: DataFrame, links: DataFrame | None = None, store: Store | None = None
) -> DataFrame:
    """One row of counts, means and ratios; with ``links`` also those per connected component."""
    marked = modules.select(
        "n", "p", is_singleton().alias("singleton"), is_small(expected_share(modules)).alias("small")
    ).withColumn("significant", ~F.col("singleton") & ~F.col("small") & (F.col("n") > 1))
    stats = marked.agg(
        F.count(F.lit(1)).alias("modules"),
        F.count_if("singleton").alias("singletons"),
        F.count_if("small").alias("small"),
        F.count_if(F.col("singleton") | F.col("small")).alias("insignificant"),
        F.count_if("significant").alias("significant"),
        F.avg(F.when(F.col("significant"), F.col("n"))).alias("mean_nodes"),
        F.avg(F.when(F.col("significant"), F.col("p"))).alias("mean_frequency"),
        F.sum(F.when(F.col("significant"), F.col("p")).otherwise(0.0)).alias("total_frequency"),
    ).withColumn(
        "insignificant_per_significant", F.try_divide("insignificant", "significant")
    )
    if links is None:
        return stats
    components = component_sizes(modules, links, store).agg(F.count(F.lit(1))).scalar()
    return stats.withColumn("components", components).withColumn(
        "significant_per_component",
        F.try_divide(F.col("modules") - F.col("insignificant"), F.col("components")),
    )


def degrees(modules: DataFrame, links: DataFrame) -> DataFrame:
    """``(module, degree)``: links in and out of each module, 0 for an isolated one."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("module"))
    counted = ends.groupBy("module").agg(F.count(F.lit(1)).alias("degree"))
    return modules.select("module").join(counted, "module", "left").select(
        "module", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")
    )


def histogram(
    table: DataFrame, column: str, bins: int = 10, above: float | None = None
) -> DataFrame:
    """``(bin, low, high, count)`` over equal bins from the smallest to the largest value.

    The last bin includes its upper end; a single value sits in the middle of a range of width 1.
    ``above`` keeps only larger values.  Bins without values are listed with count 0.
    """
    x = table.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    if above is not None:
        x = x.filter(F.col("x") > above)
    flat = F.min("x") == F.max("x")
    bounds = x.agg(F.struct(
        F.when(flat, F.min("x") - 0.5).otherwise(F.min("x")).alias("low"),
        F.when(flat, F.max("x") + 0.5).otherwise(F.max("x")).alias("high"),
    ).alias("b")).filter("b.low is not null").scalar()
    ranged = x.withColumn("b", bounds)
    position = F.floor((F.col("x") - F.col("b.low")) * bins / (F.col("b.high") - F.col("b.low")))
    counted = ranged.groupBy(F.least(position, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    step = (F.col("b.high") - F.col("b.low")) / bins
    every = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("b", bounds)
    return every.filter("b is not null").join(counted, "bin", "left").select(
        "bin",
        (F.col("b.low") + F.col("bin") * step).alias("low"),
        (F.col("b.low") + (F.col("bin") + 1) * step).alias("high"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def induced_subgraph(
    modules: DataFrame, links: DataFrame, predicate: Column
) -> tuple[DataFrame, DataFrame]:
    """The modules that satisfy ``predicate`` and the links with both ends among them."""
    kept = modules.filter(predicate)
    ids = kept.select("module")
    inside = (
        links.join(ids.withColumnRenamed("module", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("module", "dst"), "dst", "left_semi")
        .select("src", "dst", "weight")
    )
    return kept, inside
