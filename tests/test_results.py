"""Saved results read back, faults as a table, maps composed, searches compared."""

import random

import networks
import pytest
from helpers import rows

from eddymap import compare_modes, init_partition, pajek_faults, read_parquet_graph, read_saved, run
from eddymap.plans.multi_merge import compose_maps
from eddymap.store import Store


@pytest.mark.parametrize("kind", ["parquet", "text"])
def test_saved_states_are_read_back(spark, net, tmp_path, kind):
    path = str(tmp_path / f"out.{kind}")
    found = run(net("four-groups"), outputs={kind: path}, debug=True)
    graph, part = read_saved(spark, path, kind)
    assert rows(graph.vertices) == rows(found.graph.vertices)
    assert rows(part.modules) == rows(found.part.modules) and rows(part.links) == rows(found.part.links)
    assert part.q_sum == pytest.approx(found.part.q_sum) and part.n_nodes == 25
    assert part.prob_sum != part.prob_sum  # several vertices a module: their own frequencies are not saved
    _, start = read_saved(spark, path, kind, suffix="0")
    assert start.codelength == pytest.approx(6.5431831400) and (start.n_modules, start.n_links) == (25, 84)
    _, middle = read_saved(spark, path, kind, suffix="1")
    assert (middle.n_modules, middle.n_links) == (9, 20)


def test_tables_of_another_kind_are_refused(spark, tmp_path):
    def manifest(vertices, edges):
        stem = tmp_path / f"m{random.random()}"
        vertices.write.parquet(f"{stem}-v")
        edges.write.parquet(f"{stem}-e")
        stem.write_text(f'{{"Vertex File": "{stem}-v", "Edge File": "{stem}-e"}}')
        return str(stem)

    good_v = spark.createDataFrame([(1, "a"), (2, "b")], "k int, label string")
    good_e = spark.createDataFrame([(1, 2, 0.5)], "a long, b int, w double")
    assert rows(read_parquet_graph(spark, manifest(good_v, good_e)).edges) == [(1, 2, 0.5)]
    for vertices, edges, message in [
        (spark.createDataFrame([("1", "a")], "k string, label string"), good_e, "'id' must be bigint"),
        (good_v, spark.createDataFrame([(1, 2)], "a long, b long"), "2 columns, 3 are needed"),
        (good_v, spark.createDataFrame([(1, 2, 3)], "a long, b long, w int"), "'weight' must be double"),
    ]:
        with pytest.raises(ValueError, match=message):
            read_parquet_graph(spark, manifest(vertices, edges))


def test_all_faults_at_once(spark, text_file):
    text = ('1 2\n*Vertices 2\n% skipped\n1 "a"\n3 "c"\n1 "again"\nnone\n*Edges\n1 2\n1 9\n1 2 -1\nx\n'
            '*Matrix\n*Edgeslist\n1 2 x\n*Vertices 5\n*Odd\n')
    want = [
        (1, "Line 1 does not belong to any sections"), (4, "Vertex index must be within [1,2]: line 4"),
        (5, "Vertex 1 is not unique!"), (6, "Vertex definition error: line 6"),
        (9, "Vertex index must be within [1,2]: line 9"), (10, "Edge weight must be non-negative: line 10"),
        (11, "Edge definition error: line 11"), (14, "Edge list definition error: line 14"),
        (15, "There must be one and only one vertices section"),
    ]
    unknown = "Pajek file format only accepts Vertices, Arcs, Edges, Arcslist, Edgeslist as section declarator: line {}"
    want += [(n, unknown.format(n)) for n in (12, 16)]
    path = text_file(text)
    for size in ("1000", "16"):  # one split, and many
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert rows(pajek_faults(spark, path)) == sorted(want)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows(pajek_faults(spark, text_file("*Edges\n"))) == [(None, "There must be one and only one vertices section")]
    assert rows(pajek_faults(spark, text_file("*Vertices two\n"))) == [(1, "Cannot read node number: line 1")]
    assert rows(pajek_faults(spark, text_file(networks.pajek_text("triangles")))) == []


def test_composed_maps_equal_maps_in_turn(spark):
    rng = random.Random(2)
    left, maps = list(range(1, 60)), []
    for _ in range(4):
        moved = {m: rng.choice([x for x in left if x < m]) for m in rng.sample(left[1:], len(left) // 3)}
        roots = {m: m for m in left}
        for m in sorted(moved):
            roots[m] = roots[moved[m]]  # targets are smaller, so already settled
        maps.append({m: t for m, t in roots.items() if m != t})
        left = [m for m in left if m not in maps[-1]]
    store = Store(spark)
    tables = [store.cut(spark.createDataFrame(list(m.items()), "module long, target long"), "map") for m in maps]
    whole = compose_maps(tables, store)
    found = dict(rows(whole.df))
    assert store.written_since(0) == [whole]
    for module in range(1, 60):
        at = module
        for one in maps:
            at = one.get(at, at)
        assert found.get(module, module) == at


def test_searches_side_by_side(spark, net):
    graph = net("four-groups")
    found = {r["mode"]: r for r in compare_modes(graph, init_partition(graph)).collect()}
    assert {m: (r["rounds"], r["modules"]) for m, r in found.items()} == {
        "pair": (21, 4), "symmetric": (2, 4), "asymmetric": (2, 4)}
    assert all(r["codelength"] == pytest.approx(3.5140300102) and r["above_best"] < 1e-9 and r["seconds"] > 0 for r in found.values())
