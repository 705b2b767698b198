from eddymap.sinks.node_link import full_nodes, node_link_lines, reduced_nodes, write_node_link
from eddymap.sinks.save import save
from eddymap.sinks.tables import vertex_lines, write_parquet, write_text_tables, write_vertex_table

__all__ = [
    "full_nodes", "node_link_lines", "reduced_nodes", "save", "vertex_lines", "write_node_link",
    "write_parquet", "write_text_tables", "write_vertex_table",
]
