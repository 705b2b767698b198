"""Documents and listings compared as text, and files read back."""

import glob
import json
import os

import networks
from helpers import rows

from eddymap import Graph, init_partition, pair_merge, read_pajek, run
from eddymap.graph import EDGE_SCHEMA, VERTEX_SCHEMA
from eddymap.sinks import full_nodes, reduced_nodes, vertex_lines, write_node_link
from eddymap.sinks.node_link import links_of
from eddymap.sinks.save import split_path
from eddymap.sources import read_node_link


def text_of(path):
    """Part files joined in name order."""
    return "".join(open(part, encoding="utf-8").read() for part in sorted(glob.glob(f"{path}/part-*")))


def test_full_document(net, tmp_path):
    graph = net("pair-and-one")
    path = str(tmp_path / "full.json")
    write_node_link(full_nodes(graph), links_of(graph.edges), path)
    def node(i, size, count, name, group):
        return (f'\t\t{{"id": "{i}", "size": "{size}", "count": "{count}", '
                f'"name": "{name}", "group": "{group}"}}')
    nodes = [node(-i, "0.0", 0, "", i) for i in (3, 2, 1)] + [node(i, "1.0", 1, i, i) for i in (1, 2, 3)]
    links = [f'\t\t{{"source": "{a}", "target": "{b}", "value": "1.0"}}' for a, b in ((1, 2), (2, 1))]
    assert text_of(path) == "\n".join(
        ["{", '\t"nodes": [', ",\n".join(nodes), "\t],", '\t"links": [', ",\n".join(links), "\t]", "}", ""])


def test_reduced_document_without_links(spark, net, tmp_path):
    graph = net("pair-and-one")
    found = pair_merge(graph, init_partition(graph, tele=0.85))
    path = str(tmp_path / "reduced.json")
    write_node_link(reduced_nodes(found.part), links_of(found.part.links), path)
    document = json.loads(text_of(path))
    assert list(document) == ["nodes"]
    assert [(n["id"], n["count"], n["name"], n["group"]) for n in document["nodes"]] == [
        ("1", "2", "1", "1"), ("3", "1", "3", "3")]
    sizes = [float(n["size"]) for n in document["nodes"]]
    assert abs(sizes[0] - 0.7016666666666667) < 1e-12 and abs(sizes[1] - 0.29833333333333334) < 1e-12
    nodes, links = read_node_link(spark, path)
    assert [r[0] for r in rows(nodes)] == [1, 3] and rows(links) == []


def test_names_are_escaped(spark, tmp_path):
    name = 'a "quoted" \\ name\twith {"id": 1},'
    graph = Graph(
        spark.createDataFrame([(1, name, 1)], VERTEX_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))
    path = str(tmp_path / "named.json")
    write_node_link(full_nodes(graph), links_of(graph.edges), path)
    assert json.loads(text_of(path))["nodes"][1]["name"] == name
    nodes, _ = read_node_link(spark, path)
    assert [r.name for r in nodes.orderBy("id").collect()] == ["", name]


def test_vertex_listing(net, spark):
    lines = [r.line for r in vertex_lines(net("arrow")).orderBy("part", "id").collect()]
    assert lines == [
        "Index   | Name | Module ",
        "      1 | m01  |       1",
        "      2 | m02  |       2",
    ]


def test_paths():
    assert split_path("out/graph.json") == ("out/graph", ".json")
    assert split_path("out/graph") == ("out/graph", "")


def test_run_saves_everything(spark, text_file, tmp_path):
    """From a Pajek file to every output, with snapshots of all states."""
    source = text_file(networks.pajek_text("triangles"))
    out = tmp_path / "out"
    outputs = {
        "parquet": f"{out}/p.parquet", "text": f"{out}/t.csv", "vertices": f"{out}/v.txt",
        "full_json": f"{out}/full.json", "reduced_json": f"{out}/reduced.json",
    }
    found = run(source, outputs=outputs, debug=True, spark=spark)
    states = len(found.trace_rows)
    expected = {"full.json", "reduced.json", "v.txt"}
    expected |= {f"{x}-{t}{e}" for x, e in (("p", ".parquet"), ("t", ".csv"))
                 for t in ("graph-vertices", "graph-edges", "part-vertices", "part-edges")}
    for name in sorted(expected):
        stem, ext = split_path(name)
        for suffix in ["", *map(str, range(states))]:
            assert os.path.isdir(f"{out}/{stem}{suffix}{ext}"), (name, suffix)
    saved = spark.read.parquet(f"{out}/p-graph-vertices.parquet")
    assert {r.id: r.module for r in saved.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert spark.read.parquet(f"{out}/p-part-vertices.parquet").count() == 2
    assert [n["id"] for n in json.loads(text_of(f"{out}/reduced.json"))["nodes"]] == ["1", "4"]
    assert read_pajek(spark, source).edges.count() == 14
