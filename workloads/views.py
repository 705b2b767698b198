"""Graphs derived from the star-schema tables, each as a Spark table and as SQL text.

None of them pairs up the members of a group: every join has a unique key on one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddymap.operators.sequences import with_next


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link from the part on each order line to the part on the order's next line; not aggregated.

    Every line has a place of its own: line numbers may repeat inside an order, so part, supplier and
    quantity come after the number, and lines that agree in all of them are interchangeable.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    following = with_next(
        lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ["l_partkey", "l_quantity"])
    return following.filter("next IS NOT NULL").select(
        F.col("l_partkey").alias("src"), F.col("next.l_partkey").alias("dst"),
        (F.col("l_quantity") + F.col("next.l_quantity")).alias("weight"),
    )


CHAIN_ROWS = """
lines AS (SELECT l_partkey AS src, lead(l_partkey) OVER w AS dst, l_quantity + lead(l_quantity) OVER w AS weight
          FROM lineitem
          WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
chain_rows AS (SELECT src, dst, weight FROM lines WHERE dst IS NOT NULL)"""


def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with parallel rows summed and self-loops dropped."""
    return (
        chain_rows(spark, sf_dir).filter("src <> dst")
        .groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    )


CHAIN_EDGES = CHAIN_ROWS + """,
edges AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM chain_rows
                       WHERE src <> dst GROUP BY src, dst)"""


def nation_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped from each supplier's nation to each customer's."""
    bought = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey", "o_custkey").agg(F.sum("l_quantity").alias("qty"))
    )
    return (
        bought.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"),
                    F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
              F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("s_nationkey").cast("bigint").alias("src"),
                 F.col("c_nationkey").cast("bigint").alias("dst"))
        .agg(F.sum("qty").alias("weight"))
    )


NATION_FLOW = """
edges AS MATERIALIZED (
    SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, sum(l_quantity) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even ids) to the suppliers (odd ids) they buy from; suppliers dangle."""
    return (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
        .agg(F.sum("l_quantity").alias("weight"))
    )


CUSTOMER_SUPPLIER = """
edges AS MATERIALIZED (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, sum(l_quantity) AS weight
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


# Days after which a customer's next order no longer belongs to the same run of orders.
RUN_DAYS = 200


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order to the same customer's next one, if that comes soon: a forest of thousands of paths."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    gap = F.datediff("next.o_orderdate", "o_orderdate")
    return (
        with_next(orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])
        .filter(gap <= RUN_DAYS)
        .select(F.col("o_orderkey").alias("src"), F.col("next.o_orderkey").alias("dst"),
                (F.lit(RUN_DAYS + 1) - gap).cast("double").alias("weight"))
    )


ORDER_RUNS = f"""
next_orders AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER w AS dst,
                       date_diff('day', o_orderdate::DATE, lead(o_orderdate) OVER w::DATE) AS gap
                FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
edges AS MATERIALIZED (SELECT src, dst, ({RUN_DAYS + 1} - gap)::DOUBLE AS weight FROM next_orders
                       WHERE gap <= {RUN_DAYS}),
nodes AS MATERIALIZED (SELECT o_orderkey AS id FROM orders),
size AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes)"""


def _next_buyers(orders: DataFrame, key: str, weight: float) -> DataFrame:
    return with_next(orders, key, ["o_orderdate", "o_orderkey"], ["o_custkey"]).filter("next IS NOT NULL").select(
        F.col("o_custkey").alias("src"), F.col("next.o_custkey").alias("dst"), F.lit(weight).alias("weight"))


def market_links(spark: SparkSession, sf_dir: str, abroad: float = 0.0) -> DataFrame:
    """Each customer to whoever ordered next in the same nation and market segment: directed blocks.

    Nothing links two blocks, unless ``abroad`` gives a weight to the next order in the same nation.
    """
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.concat_ws("|", "c_nationkey", "c_mktsegment").alias("market"))
    orders = (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(people, "o_custkey")
    )
    rows = _next_buyers(orders, "market", 20.0)
    if abroad:
        rows = rows.unionByName(_next_buyers(orders, "c_nationkey", abroad))
    return rows.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def market_sql(abroad: float = 0.0) -> str:
    ways = "UNION ALL SELECT src, abroad, {:f}::DOUBLE FROM buyers".format(abroad) if abroad else ""
    return f"""
buyers AS MATERIALIZED (
    SELECT o_custkey AS src,
           lead(o_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY o_orderdate, o_orderkey) AS near,
           lead(o_custkey) OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS abroad
    FROM orders JOIN customer ON o_custkey = c_custkey),
edges AS MATERIALIZED (
    SELECT src, dst, sum(weight) AS weight
    FROM (SELECT src, near AS dst, 20.0::DOUBLE AS weight FROM buyers {ways})
    WHERE src <> dst GROUP BY src, dst)"""


def endpoints(edges: DataFrame) -> DataFrame:
    """Vertex table of the ids an edge table uses."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
