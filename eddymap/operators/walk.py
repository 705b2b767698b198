"""Random walks: sparse matrix-vector product and PageRank with teleportation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymap.functions.flow_math import number
from eddymap.graph import Graph
from eddymap.operators.edges import out_weight
from eddymap.store import Store, Written

# Most rows of one source that a single task joins; a busier source is spread over more slots.
ROWS_PER_SLOT = 1_000_000
# Links, and vertices, that one bucket of the prepared graph holds on average, once there are enough of them.
ROWS_PER_BUCKET = 4_000_000
NODES_PER_BUCKET = 1_000_000


def sparse_matvec(matrix: DataFrame, constant: DataFrame, vector: DataFrame) -> DataFrame:
    """``y = A x`` for entries ``(src = column, dst = row, weight)`` and constant columns ``(id, c)``.

    A constant column holds the same value in every row, so it needs one scalar instead of a row
    per entry.  The result ``(id, x)`` keeps every index of ``vector``.
    """
    moved = (
        matrix.join(vector, matrix.src == vector.id)
        .groupBy("dst").agg(F.sum(F.col("weight") * F.col("x")).alias("moved"))
    )
    everywhere = (
        constant.join(vector, "id")
        .agg(F.coalesce(F.sum(F.col("c") * F.col("x")), F.lit(0.0)).alias("everywhere"))
        .scalar()
    )
    return vector.join(moved, vector.id == moved.dst, "left").select(
        "id", (F.coalesce("moved", F.lit(0.0)) + everywhere).alias("x")
    )


@dataclass
class Walk:
    """A graph prepared for walking.

    ``stored`` holds the normalised edges ``(src, slot, dst, weight)`` on shared storage in buckets of
    ``(src, slot)``, so that a step moves only vertex rows and partial sums, sorts no edges, and a lost
    executor loses none.  ``nodes`` are ``(id, slots)``: over how many slots the out-edges are spread, 0
    for a dangling vertex.
    """

    stored: Written
    nodes: Written
    out: Written
    n_nodes: int
    n_dangling: int

    @property
    def links(self) -> DataFrame:
        return self.stored.df

    def close(self) -> None:
        self.stored.drop()
        self.nodes.drop()
        self.out.drop()


def prepare_walk(
    vertices: DataFrame, edges: DataFrame, store: Store, rows_per_slot: int = ROWS_PER_SLOT
) -> Walk:
    """Normalise the edges, spread busy sources over slots and write the result for all steps."""
    spark = vertices.sparkSession
    totals = out_weight(edges).filter("total > 0").select(
        "src", "total", "degree", F.ceil(F.col("degree") / F.lit(rows_per_slot)).cast("int").alias("slots")
    )
    out = store.cut(totals, "out-weight", links=F.sum("degree"))
    nodes = store.cut(
        vertices.select("id").join(out.df.withColumnRenamed("src", "id"), "id", "left")
        .select("id", F.coalesce("slots", F.lit(0)).alias("slots")),
        "nodes",
        dangling=F.count_if(F.col("slots") == 0),
    )
    if nodes.rows == 0:
        raise ValueError("the graph has no vertices")
    buckets = max(spark.sparkContext.defaultParallelism, -(-(out.stats["links"] or 0) // ROWS_PER_BUCKET),
                  -(-nodes.rows // NODES_PER_BUCKET))
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    # The edges move once, into their buckets; busy sources are few, and a written table tells Spark so.
    hubs = store.cut(out.df.filter("slots > 1").select("src", "slots"), "hubs")
    placed = (
        edges.join(hubs.df, "src", "left")
        .select("src", F.pmod(F.xxhash64("dst"), F.coalesce("slots", F.lit(1))).cast("int").alias("slot"),
                "dst", "weight")
    )
    # In buckets already, the few rows of the sources tell the join into how many partitions the links go.
    shares = store.cut_in_buckets(
        out.df.selectExpr("src", "explode(sequence(0, slots - 1)) AS slot", "total"), "shares", buckets, "src", "slot")
    links = placed.join(shares.df.hint("shuffle_hash"), ["src", "slot"]).selectExpr(
        "src", "slot", "dst", "weight / total AS weight")
    stored = store.cut_in_buckets(links, "links", buckets, "src", "slot", placed=True)
    hubs.drop()
    shares.drop()
    return Walk(stored, nodes, out, nodes.rows, nodes.stats["dangling"])


def start_frequencies(walk: Walk) -> DataFrame:
    """The uniform start ``(id, slots, p)``."""
    return walk.nodes.df.withColumn("p", F.lit(1.0 / walk.n_nodes))


def flow_rows(walk: Walk, state: DataFrame) -> DataFrame:
    """Flow ``(src, dst, weight)`` over each link: source frequency times normalised weight.

    The sources of a bucket are hashed, some ``NODES_PER_BUCKET`` rows, and its links stream past them unsorted.
    """
    sources = state.filter("slots > 0").selectExpr(
        "id AS src", "explode(sequence(0, slots - 1)) AS slot", "p"
    )
    return walk.links.join(sources.hint("shuffle_hash"), ["src", "slot"]).selectExpr("src", "dst", "p * weight AS weight")


def pagerank_step(
    walk: Walk, state: DataFrame, dangling_mass: float, damping: float
) -> DataFrame:
    """One step: ``(id, slots, before, p)``.

    Dangling vertices jump anywhere with equal chance; their summed frequency ``dangling_mass``
    comes from the previous step.  What arrives and what was there before meet in one aggregate, so
    a step joins once, on the links' own partitioning, and shuffles partial sums once.
    """
    n = walk.n_nodes
    arriving = flow_rows(walk, state).selectExpr(
        "dst AS id", "weight AS arrived", "CAST(NULL AS INT) AS slots", "CAST(NULL AS DOUBLE) AS before"
    )
    p = (
        f"{number((1.0 - damping) / n)} + {number(damping)} * (arrived + {number(dangling_mass / n)})"
    )
    return (
        arriving.union(state.selectExpr("id", "0D", "slots", "p"))
        .groupBy("id")
        .agg(F.max("slots").alias("slots"), F.sum("arrived").alias("arrived"), F.max("before").alias("before"))
        .filter("slots IS NOT NULL")
        .selectExpr("id", "slots", "before", f"{p} AS p")
    )


@dataclass
class Frequencies:
    """Visit frequencies ``(id, slots, p)`` with the number of steps and the last distance."""

    table: Written
    steps: int
    error: float


def iterate_walk(
    walk: Walk, damping: float, err_factor: float, store: Store,
    fixed_iter: int | None = None, max_iter: int = 1000,
) -> Frequencies:
    """Step until the Euclidean distance of two steps is below ``1 / n / err_factor``."""
    state, before = start_frequencies(walk), None
    dangling_mass = walk.n_dangling / walk.n_nodes
    threshold = 1.0 / walk.n_nodes / err_factor
    limit = max_iter if fixed_iter is None else fixed_iter
    for step in range(1, limit + 1):
        # One job per step: the written state also carries the distance and the next dangling mass.
        after = store.cut(
            pagerank_step(walk, state, dangling_mass, damping), f"rank-{step}",
            square=F.expr("sum((p - before) * (p - before))"),
            dangling=F.expr("sum(if(slots = 0, p, 0D))"),
        )
        if before is not None:
            before.drop()
        state, before = after.df.select("id", "slots", "p"), after
        dangling_mass = after.stats["dangling"]
        error = math.sqrt(after.stats["square"])
        if step == fixed_iter or (fixed_iter is None and error < threshold):
            return Frequencies(after, step, error)
    raise RuntimeError(f"PageRank did not converge within {max_iter} steps")


def pagerank(
    graph: Graph, damping: float = 0.85, err_factor: float = 20.0,
    fixed_iter: int | None = None, max_iter: int = 1000, store: Store | None = None,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """Stationary visit frequencies ``(id, p)``; self-loops are kept."""
    store = store or Store(graph.spark)
    walk = prepare_walk(graph.vertices, graph.edges, store, rows_per_slot)
    try:
        found = iterate_walk(walk, damping, err_factor, store, fixed_iter, max_iter)
    finally:
        walk.close()
    return found.table.df.select("id", "p")
