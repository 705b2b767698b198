"""End-to-end searches on small networks with known results."""

import pytest

from eddymap import detect_communities, init_partition
from eddymap.operators.partition import codelength

# Fixed expectations: initial and final code length, and the module of each vertex.
CASES = {
    "one": (0.0, 0.0, {1: 1}),
    "arrow": (1.4639103770, 0.9390921949, {1: 1, 2: 1}),
    "arrow-loop": (1.4639103770, 0.9390921949, {1: 1, 2: 1}),
    "two-pairs": (4.0, 1.5834466856, {1: 1, 2: 1, 3: 3, 4: 3}),
    "pair-and-one": (2.9160675563, 1.3843728994, {1: 1, 2: 1, 3: 3}),
    "triangles": (4.5782650066, 2.3882113344, {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}),
    "fan": (2.0127996821, 1.7962998847, {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}),
    "two-fans": (2.6023014000, 2.1758182306, {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}),
    "four-groups": (
        6.5431831400, 3.5140300102,
        {i: 1 if i < 7 else 7 if i < 14 else 14 if i < 22 else 22 for i in range(1, 26)},
    ),
}
FOUR_GROUP_LINKS = {
    (1, 7): 0.0014197427450954, (7, 1): 0.0008212044028182, (7, 14): 0.0111292439004695,
    (7, 22): 0.0033299799328381, (14, 7): 0.0078038116286589, (14, 22): 0.0034855554373641,
    (22, 7): 0.0034971874787279, (22, 14): 0.0051890450775562,
}


SEARCHES = [("multi", "symmetric"), ("multi", "asymmetric"), ("pair", None)]
# Every network with the symmetric search, and all three searches where they have most to do.
RUNS = [(name, *SEARCHES[0]) for name in CASES]
RUNS += [(name, *search) for name in ("triangles", "two-fans", "four-groups") for search in SEARCHES[1:]]
RUNS += [("one", "pair", None), ("arrow", "multi", "asymmetric")]


@pytest.mark.parametrize("name,mode,direction", RUNS)
def test_known_networks(net, name, mode, direction):
    before, after, modules = CASES[name]
    graph = net(name)
    part = init_partition(graph)
    assert part.codelength == pytest.approx(before, abs=1e-9)
    options = {"direction": direction} if direction else {}
    found = detect_communities(graph, part, mode, **options)
    assert found.part.codelength == pytest.approx(after, abs=1e-9)
    assert {r.id: r.module for r in found.graph.vertices.collect()} == modules
    if name == "four-groups":
        links = {(r.src, r.dst): r.weight for r in found.part.links.collect()}
        assert links == pytest.approx(FOUR_GROUP_LINKS, abs=1e-12)
    codelengths = [r.codelength for r in found.trace.orderBy("round").collect()]
    assert len(codelengths) == len(found.trace_rows)
    assert all(b <= a + 1e-12 for a, b in zip(codelengths, codelengths[1:]))


def test_pair_search_snapshots(net):
    """Asking for every state changes nothing, and each state is consistent."""
    graph = net("triangles")
    part = init_partition(graph)
    seen = []

    def on_round(number, state_graph, state):
        modules = {r.module for r in state_graph.vertices.collect()}
        assert modules == {r.module for r in state.modules.collect()}
        seen.append((number, len(modules), codelength(state.modules, state.prob_sum)))

    found = detect_communities(graph, part, "pair", on_round=on_round)
    assert [s[:2] for s in seen] == [(r[0], r[1]) for r in found.trace_rows]
    assert [s[2] for s in seen] == pytest.approx([r[3] for r in found.trace_rows])
    assert {r.id: r.module for r in found.graph.vertices.collect()} == CASES["triangles"][2]


def test_unknown_mode(net):
    with pytest.raises(ValueError, match="unknown mode"):
        detect_communities(net("one"), None, "other")
