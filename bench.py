"""Headline timings: one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores; ``BENCH_NET`` may name a Pajek file
to be timed end to end as well.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eddymap import Graph, graph_from_tables, init_partition, multi_merge, pagerank, read_graph  # noqa: E402
from eddymap.operators.components import connected_components  # noqa: E402
from eddymap.store import Store  # noqa: E402
from workloads import views  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("eddymap-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    facts: dict[str, dict] = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    def search(name, graph: Graph, direction: str, part) -> None:
        def work():
            found = multi_merge(graph, part, direction)
            found.graph.vertices.write.format("noop").mode("overwrite").save()
            return found
        found = timed(name, work)
        facts[name] = {
            "modules": [row[1] for row in found.trace_rows],
            "codelength": round(found.part.codelength, 6),
        }

    def build() -> Graph:
        edges = Store(spark).cut(views.chain_links(spark, sf_dir), "edges").df
        return graph_from_tables(views.endpoints(edges), edges)

    chain = timed("graph_build", build)
    timed("components", lambda: connected_components(chain.edges))
    timed("pagerank", lambda: pagerank(chain))
    part = timed("init_partition", lambda: init_partition(chain))
    search("merge_symmetric", chain, "symmetric", part)
    search("merge_asymmetric", chain, "asymmetric", part)

    net = os.environ.get("BENCH_NET")
    if net:
        graph = timed("net_read", lambda: read_graph(spark, net))
        part = timed("net_init", lambda: init_partition(graph))
        search("net_symmetric", graph, "symmetric", part)
        search("net_asymmetric", graph, "asymmetric", part)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "facts": facts,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
