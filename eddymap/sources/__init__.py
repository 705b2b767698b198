from eddymap.graph import graph_from_tables
from eddymap.sources.dispatch import read_graph
from eddymap.sources.node_link import read_node_link
from eddymap.sources.pajek import PajekError, pajek_faults, read_pajek
from eddymap.sources.parquet import read_parquet_graph
from eddymap.sources.saved import read_saved

__all__ = [
    "PajekError", "graph_from_tables", "pajek_faults", "read_graph", "read_node_link", "read_pajek",
    "read_parquet_graph", "read_saved",
]
