"""The small test networks as tables, and a writer that lays them out as Pajek text."""

from __future__ import annotations

# Vertex count, names that differ from the number, and weighted directed edges.
TRIANGLES = [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6)]
# The 84 edges of the 25-node network in four groups.
FOUR_GROUPS = [
    (1, 3, 1.0), (1, 6, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 2, 1.0), (3, 4, 1.0), (3, 5, 1.0), (3, 6, 1.0),
    (4, 3, 1.0), (4, 5, 1.0), (5, 3, 1.0), (5, 4, 1.0), (5, 6, 1.0), (6, 1, 1.0), (6, 3, 1.0), (6, 5, 1.0),
    (6, 7, 0.1), (7, 6, 0.1), (7, 8, 1.0), (7, 9, 1.0), (7, 10, 2.0), (8, 7, 1.0), (8, 9, 1.0),
    (8, 12, 1.0), (9, 7, 1.0), (9, 8, 1.0), (9, 10, 1.0), (9, 11, 1.0), (9, 12, 1.0), (10, 7, 1.0),
    (10, 9, 1.0), (10, 13, 1.0), (10, 14, 1.0), (11, 9, 1.0), (11, 12, 1.0), (11, 13, 1.0), (12, 8, 1.0),
    (12, 9, 1.0), (12, 11, 1.0), (12, 13, 1.0), (13, 10, 1.0), (13, 11, 1.0), (13, 12, 1.0), (13, 22, 0.3),
    (14, 10, 1.0), (14, 15, 2.0), (14, 16, 1.0), (14, 17, 2.0), (15, 14, 2.0), (15, 17, 2.0), (16, 14, 1.0),
    (16, 17, 1.0), (16, 20, 1.0), (17, 14, 2.0), (17, 15, 2.0), (17, 16, 1.0), (17, 18, 3.0), (17, 19, 1.0),
    (17, 20, 3.0), (17, 21, 1.0), (18, 17, 3.0), (19, 17, 1.0), (19, 20, 1.0), (19, 21, 3.0), (20, 16, 1.0),
    (20, 17, 3.0), (20, 19, 1.0), (20, 21, 2.0), (20, 24, 0.5), (21, 17, 1.0), (21, 19, 3.0), (21, 20, 2.0),
    (22, 13, 0.3), (22, 23, 1.0), (22, 24, 1.0), (23, 22, 1.0), (23, 24, 3.0), (23, 25, 0.5), (24, 20, 0.5),
    (24, 22, 1.0), (24, 23, 3.0), (24, 25, 1.0), (25, 23, 0.5), (25, 24, 1.0),
]


def both_ways(pairs: dict[tuple[int, int], float]) -> list[tuple[int, int, float]]:
    return [edge for (a, b), w in pairs.items() for edge in ((a, b, float(w)), (b, a, float(w)))]


NETWORKS = {
    "one": (1, {1: "v1"}, []),
    "arrow": (2, {1: "m01", 2: "m02"}, [(1, 2, 2.0)]),
    "arrow-loop": (2, {1: "m01", 2: "m02"}, [(1, 2, 2.0), (2, 2, 1.0)]),
    "two-pairs": (4, {}, both_ways({(1, 2): 1, (3, 4): 1})),
    "pair-and-one": (3, {}, both_ways({(1, 2): 1})),
    "triangles": (6, {}, both_ways({**{pair: 1 for pair in TRIANGLES}, (3, 4): 0.5})),
    "fan": (6, {}, [(1, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0), (2, 1, 1.0), (2, 2, 1.0), (2, 6, 1.0)]),
    "two-fans": (6, {}, [
        (1, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0), (2, 1, 1.0), (2, 2, 1.0), (2, 6, 1.0),
        (3, 4, 1.0), (3, 2, 1.0),
    ]),
    "four-groups": (25, {}, FOUR_GROUPS),
}


def vertices(name: str) -> list[tuple[int, str, int]]:
    count, names, _ = NETWORKS[name]
    return [(i, names.get(i, str(i)), i) for i in range(1, count + 1)]


def edges(name: str) -> list[tuple[int, int, float]]:
    return NETWORKS[name][2]


def pajek_text(name: str) -> str:
    lines = [f"*Vertices {NETWORKS[name][0]}", "% a comment", ""]
    lines += [f'  {i} "{label}" ignored' for i, label, _ in vertices(name)]
    lines.append("*Edges")
    lines += [f" {a}\t{b}" if w == 1.0 else f" {a} {b} {w} ignored" for a, b, w in edges(name)]
    return "\n".join(lines) + "\n"
