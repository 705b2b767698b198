"""Readers: Pajek text, Parquet manifests, dispatch and node-link documents."""

import json

import networks
import pytest
from helpers import rows

from eddymap import graph_from_tables, read_graph, read_pajek, read_parquet_graph
from eddymap.sources import PajekError, read_node_link


@pytest.mark.parametrize("name", ["one", "arrow-loop", "triangles"])
def test_pajek_networks(spark, text_file, name):
    graph = read_pajek(spark, text_file(networks.pajek_text(name)))
    assert rows(graph.vertices) == networks.vertices(name)
    assert rows(graph.edges) == sorted(networks.edges(name))


LISTS = """*Vertices 5
 2 "two"
 4 "four" 0.1 0.2
*ArcsList anything here
 5 1 4 4
 2
*edgesList
\t3 5
"""
LIST_VERTICES = [(1, "1", 1), (2, "two", 2), (3, "3", 3), (4, "four", 4), (5, "5", 5)]
LIST_EDGES = [(3, 5, 1.0), (5, 1, 1.0), (5, 4, 2.0)]


def test_pajek_lists_and_undeclared_vertices(spark, text_file):
    graph = read_pajek(spark, text_file(LISTS))
    assert rows(graph.vertices) == LIST_VERTICES
    assert rows(graph.edges) == LIST_EDGES


def test_pajek_in_small_splits(spark, text_file):
    """Sections are carried from split to split, and splitting anew after reading changes nothing."""
    path = text_file(LISTS)
    for before, after in (("24", "1000"), ("1000", "24"), ("40", "17")):
        try:
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            graph = read_pajek(spark, path)
            spark.conf.set("spark.sql.files.maxPartitionBytes", after)
            assert rows(graph.vertices) == LIST_VERTICES
            assert rows(graph.edges) == LIST_EDGES
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pajek_details(spark, text_file):
    text = (
        '*VERTICES 4\r\n% comment\r\n\r\n1 "caf\xe9"\r\n2 "a "quoted" name" 0.5 0.5\r\n'
        '*arcs some text\r\n1 2 0\r\n1 2 1.5e0 rest\r\n2 1 2x\r\n*Edges\r\n 1\t2 \r\n3 4\r\n'
    )
    graph = read_pajek(spark, text_file(text))
    assert rows(graph.vertices) == [
        (1, "caf\xe9", 1), (2, 'a "quoted" name', 2), (3, "3", 3), (4, "4", 4),
    ]
    assert rows(graph.edges) == [(1, 2, 2.5), (2, 1, 2.0), (3, 4, 1.0)]


HEAD = '*Vertices 2\n% skipped\n1 "a"\n\n'


@pytest.mark.parametrize("text,message", [
    (HEAD + "*Matrix\n", "Pajek file format only accepts Vertices, Arcs, Edges, Arcslist, Edgeslist"
                         " as section declarator: line 3"),
    (HEAD + "*Vertices 2\n", "There must be one and only one vertices section"),
    ("*Edges\n", "There must be one and only one vertices section"),
    ("*Vertices two\n", "Cannot read node number: line 1"),
    ("*Vertices 2 extra\n", "Cannot read node number: line 1"),
    (HEAD + '3 "c"\n', "Vertex index must be within [1,2]: line 3"),
    (HEAD + "2 c\n", "Vertex definition error: line 3"),
    (HEAD + "  \n", "Vertex definition error: line 3"),
    (HEAD + "*Edges\n1 2\n1 3\n", "Vertex index must be within [1,2]: line 5"),
    (HEAD + "*Edges\n1 2 x\n", "Edge definition error: line 4"),
    (HEAD + "*Arcs\n1 2 -1\n1\n", "Edge weight must be non-negative: line 4"),
    ("1 2\n" + HEAD, "Line 1 does not belong to any sections"),
    ("*Edges\n1 2\n" + HEAD, "Vertex index must be within [1,-1]: line 2"),
    (HEAD + '2 "b"\n2 "b"\n1 "a"\n', "Vertex 2 is not unique!"),
    (HEAD + "*Edgeslist\n1 2 x\n", "Edge list definition error: line 4"),
])
def test_pajek_errors(spark, text_file, text, message):
    with pytest.raises(PajekError) as caught:
        read_pajek(spark, text_file(text))
    assert str(caught.value) == message


def test_missing_file_and_extensions(spark):
    with pytest.raises(PajekError, match="Cannot open file /nowhere/dummy.net"):
        read_graph(spark, "/nowhere/dummy.net")
    with pytest.raises(ValueError, match="file name without an ending"):
        read_graph(spark, "dummy")
    with pytest.raises(ValueError, match="no reader for files ending in"):
        read_graph(spark, "dummy.txt")


def test_parquet_manifest(spark, tmp_path):
    spark.createDataFrame([(1, "a", 7), (2, "b", 7)], "i bigint, n string, m bigint").write.parquet(
        str(tmp_path / "v"))
    spark.createDataFrame([(1, 2, 1.0), (1, 2, 2.0)], "f bigint, t bigint, w double").write.parquet(
        str(tmp_path / "e"))
    manifest = tmp_path / "graph.PARQUET"
    manifest.write_text(json.dumps(
        {"Vertex File": str(tmp_path / "v"), "Edge File": str(tmp_path / "e")}, indent=1))
    graph = read_graph(spark, str(manifest))
    assert rows(graph.vertices) == [(1, "a", 1), (2, "b", 2)]
    assert rows(graph.edges) == [(1, 2, 3.0)]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError, match="Vertex File"):
        read_parquet_graph(spark, str(tmp_path / "bad.json"))


def test_edges_outside_the_vertex_table(spark):
    vertices = spark.createDataFrame([(1,), (2,)], "id bigint")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 9, 1.0)], "a int, b int, w int".replace("w int", "w double"))
    with pytest.raises(ValueError, match="endpoint 9"):
        graph_from_tables(vertices, edges)
    assert rows(graph_from_tables(vertices, edges, strict=False).edges) == [(1, 2, 1.0)]
    assert len(rows(graph_from_tables(vertices, edges, strict=None).edges)) == 2


DOCUMENT = {
    "nodes": [{"id": "1", "size": "0.5", "count": "2", "name": 'a "b" \u00fc', "group": "7"}],
    "links": [{"source": "1", "target": "2", "value": "0.25"}],
}


@pytest.mark.parametrize("text", [
    json.dumps(DOCUMENT), json.dumps(DOCUMENT, indent=1), json.dumps(DOCUMENT, indent=4, ensure_ascii=False),
    '{\n\t"nodes": [\n\t\t' + json.dumps(DOCUMENT["nodes"][0]) + '\n\t],\n\t"links": [\n\t\t'
    + json.dumps(DOCUMENT["links"][0]) + '\n\t]\n}\n',
])
def test_node_link_in_any_layout(spark, tmp_path, text):
    (tmp_path / "graph.json").write_text(text, encoding="utf-8")
    nodes, links = read_node_link(spark, str(tmp_path / "graph.json"))
    assert rows(nodes) == [(1, 0.5, 2, 'a "b" \u00fc', 7)] and rows(links) == [(1, 2, 0.25)]


@pytest.mark.parametrize("text", ['{"nodes": [{"id": "1" "x"}]}', '{\n\t"nodes": [\n\t\t{"id": "1", "name": "a "b""}\n\t]\n}\n'])
def test_broken_node_link_documents_raise(spark, tmp_path, text):
    (tmp_path / "graph.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_node_link(spark, str(tmp_path / "graph.json"))[0].collect()
