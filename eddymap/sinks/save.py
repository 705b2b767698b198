"""Save a result in every format that has a path."""

from __future__ import annotations

import re

from eddymap.graph import Graph, Partition
from eddymap.sinks.node_link import full_nodes, links_of, reduced_nodes, write_node_link
from eddymap.sinks.tables import write_parquet, write_text_tables, write_vertex_table

FORMATS = ("parquet", "text", "vertices", "full_json", "reduced_json")


def split_path(path: str) -> tuple[str, str]:
    """The path before its last dot, and the extension with the dot (empty if there is none)."""
    found = re.fullmatch(r"(.*)\.(\w+)", path, re.DOTALL)
    return (found.group(1), "." + found.group(2)) if found else (path, "")


def save(graph: Graph, part: Partition, paths: dict[str, str], suffix: str = "") -> None:
    """Write the formats named in ``paths``; ``suffix`` goes before each extension.

    ``parquet`` and ``text`` write four tables, ``vertices`` an aligned listing, ``full_json`` the
    graph and ``reduced_json`` the modules as node-link documents.  Empty paths are skipped.
    """
    unknown = set(paths) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown output formats {sorted(unknown)}: use {FORMATS}")
    for kind, path in paths.items():
        if not path:
            continue
        stem, ext = split_path(path)
        ext = suffix + ext
        if kind == "parquet":
            write_parquet(graph, part, stem, ext)
        elif kind == "text":
            write_text_tables(graph, part, stem, ext)
        elif kind == "vertices":
            write_vertex_table(graph, stem + ext)
        elif kind == "full_json":
            write_node_link(full_nodes(graph), links_of(graph.edges), stem + ext)
        else:
            write_node_link(reduced_nodes(part), links_of(part.links), stem + ext)
