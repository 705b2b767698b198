"""Community detection by information flow, as Spark DataFrame jobs."""

from eddymap.graph import Graph, Partition, graph_from_tables
from eddymap.operators.partition import init_partition
from eddymap.operators.walk import pagerank
from eddymap.plans.compare import compare_modes
from eddymap.plans.multi_merge import Communities, multi_merge
from eddymap.plans.pair_merge import pair_merge
from eddymap.plans.pipeline import detect_communities, run
from eddymap.sources import pajek_faults, read_graph, read_pajek, read_parquet_graph, read_saved

__all__ = [
    "Communities", "Graph", "Partition", "compare_modes", "detect_communities", "graph_from_tables",
    "init_partition", "multi_merge", "pagerank", "pair_merge", "pajek_faults", "read_graph", "read_pajek",
    "read_parquet_graph", "read_saved", "run",
]
