"""The queries of :mod:`workloads.queries` as plain SQL over the same tables."""

from __future__ import annotations

from workloads.queries import ABROAD, DECLARED
from workloads.views import (
    CHAIN_EDGES, CHAIN_ROWS, CUSTOMER_SUPPLIER, NATION_FLOW, ORDER_RUNS, market_sql,
)

TELE, FACTOR, TIES = 0.15, 20.0, 1e-12
RANK_STEPS = 10
# Rounds written out for the full searches; ``ENDED`` fails if the data needs more.
ROUNDS = 5
ENDED = f" WHERE (SELECT CASE WHEN v THEN error('more rounds than written out') ELSE true END FROM ok{ROUNDS})"


def plogp(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ({x}) * log2({x}) ELSE 0 END)"


def r8(x: str, name: str, digits: int = 8) -> str:
    return f"round(({x}) + 3.1e-12, {digits}) + 0.0 AS {name}"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts if p) + "\n"


CHAIN_LINKS = CHAIN_ROWS + """,
chain_links AS (SELECT src, dst, sum(weight) AS weight FROM chain_rows
                WHERE src <> dst GROUP BY src, dst)"""

NODES = """
nodes AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges),
size AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes)"""

LINKS = """
outs AS MATERIALIZED (SELECT src, sum(weight) AS total FROM edges WHERE {keep} GROUP BY src),
links AS MATERIALIZED (SELECT e.src, e.dst, e.weight / o.total AS weight
                       FROM edges e JOIN outs o ON e.src = o.src WHERE {keep_e})"""
ALL_LINKS = LINKS.format(keep="true", keep_e="true")
OPEN_LINKS = LINKS.format(keep="src <> dst", keep_e="e.src <> e.dst")


def walk(stop: str, tele: float = TELE) -> str:
    """Power iteration; ``stop`` tells from ``k.step`` and ``k.err`` whether to go on."""
    return f"""
steps(step, id, p, err) AS (
  SELECT 0, id, 1.0::DOUBLE / n, 1e9::DOUBLE FROM nodes, size
  UNION ALL
  SELECT step, id, p, sqrt(sum((p - before) * (p - before)) OVER ()) FROM (
    SELECT k.step + 1 AS step, k.id, k.p AS before,
           {tele} / n + {1 - tele} * (coalesce(a.x, 0) + d.x / n) AS p
    FROM steps k CROSS JOIN size
    LEFT JOIN (SELECT l.dst, sum(l.weight * s.p) AS x FROM links l JOIN steps s ON s.id = l.src
               GROUP BY l.dst) a ON a.dst = k.id
    CROSS JOIN (SELECT coalesce(sum(z.p), 0) AS x FROM steps z
                WHERE NOT EXISTS (SELECT 1 FROM outs o WHERE o.src = z.id)) d
    WHERE {stop})),
freq AS MATERIALIZED (SELECT id, p FROM steps WHERE step = (SELECT max(step) FROM steps))"""


def fixed(k: int) -> str:
    return walk(f"k.step < {k}")


CONVERGED = walk(f"k.err >= 1.0 / n / {FACTOR}")


def length(modules: str) -> str:
    """Code length of a module table as a scalar subquery."""
    return f"""(SELECT CASE WHEN count(*) = 1 THEN -(SELECT v FROM prob_sum)
        ELSE {plogp('sum(q)')} + sum(-2 * {plogp('q')} + {plogp('p + q')}) - (SELECT v FROM prob_sum)
        END FROM {modules})"""


START = f"""
modules0 AS MATERIALIZED (
    SELECT f.id AS module, 1::BIGINT AS n, p, CASE WHEN o.src IS NULL THEN 0.0 ELSE p END AS w,
           CASE WHEN o.src IS NULL THEN {TELE} * p ELSE p END AS q
    FROM freq f LEFT JOIN outs o ON o.src = f.id),
flow0 AS MATERIALIZED (SELECT l.src, l.dst, l.weight * f.p AS weight
                       FROM links l JOIN freq f ON f.id = l.src),
prob_sum AS MATERIALIZED (SELECT sum({plogp('p')}) AS v FROM freq),
len0 AS MATERIALIZED (SELECT {length('modules0')} AS v)"""


def exit_rate(n: str, p: str, w: str) -> str:
    return f"({TELE} * ((SELECT n FROM size) - ({n})) / ((SELECT n FROM size) - 1) * ({p}) + {1 - TELE} * ({w}))"


def scored(r: int | str) -> str:
    """Unordered pairs of state ``r`` with both modules' numbers and ``dl``."""
    rest = "(s.q + x.q12 - x.q1 - x.q2)"
    return f"""
ends{r} AS MATERIALIZED (
    SELECT f.*, a.n AS n1, b.n AS n2, a.p AS p1, b.p AS p2, a.w AS w1, b.w AS w2, a.q AS q1, b.q AS q2,
           {exit_rate('a.n + b.n', 'a.p + b.p', 'a.w + b.w - f.w1221')} AS q12
    FROM (SELECT least(src, dst) AS m1, greatest(src, dst) AS m2, sum(weight) AS w1221,
                 bool_or(src < dst) AS forth, bool_or(src > dst) AS back
          FROM flow{r} WHERE src <> dst GROUP BY 1, 2) f
    JOIN modules{r} a ON a.module = f.m1 JOIN modules{r} b ON b.module = f.m2),
pairs{r} AS MATERIALIZED (
    SELECT x.*, CASE WHEN x.q12 > 0 AND {rest} > 0
      THEN {plogp(rest)} - {plogp('s.q')} - 2 * {plogp('x.q12')} + 2 * {plogp('x.q1')}
           + 2 * {plogp('x.q2')} + {plogp('x.p1 + x.p2 + x.q12')} - {plogp('x.p1 + x.q1')}
           - {plogp('x.p2 + x.q2')}
      ELSE -(SELECT v FROM prob_sum) - (SELECT v FROM len{r}) END AS dl
    FROM ends{r} x, (SELECT sum(q) AS q FROM modules{r}) s)"""


def chosen(r: int, symmetric: bool) -> str:
    forth, back = ("true", "true") if symmetric else ("forth", "back")
    return f"""
ways{r} AS (SELECT m1 AS src, m2 AS dst, dl FROM pairs{r} WHERE {forth}
            UNION ALL SELECT m2, m1, dl FROM pairs{r} WHERE {back}),
chosen{r} AS MATERIALIZED (
    SELECT src, dst FROM (SELECT *, min(dl) OVER (PARTITION BY src) AS least FROM ways{r})
    WHERE dl <= least + {TIES} AND dl < 0)"""


def components(name: str, links: str) -> str:
    """``name (id, label)``: smallest reachable id of each endpoint of ``links``."""
    return f"""
{name}(id, label) USING KEY (id) AS (
    SELECT id, id FROM (SELECT src AS id FROM {links} UNION SELECT dst FROM {links})
    UNION
    SELECT x.id, x.label FROM (
        SELECT id, min(label) AS label FROM (
            SELECT e.src AS id, c.label FROM {links} e JOIN {name} c ON c.id = e.dst
            UNION ALL SELECT e.dst, c.label FROM {links} e JOIN {name} c ON c.id = e.src)
        GROUP BY id) x
    JOIN recurring.{name} o ON o.id = x.id WHERE x.label < o.label)"""


def contracted(r: int) -> str:
    """State ``r + 1`` from ``map{r} (module, target)``."""
    return f"""
moved{r} AS MATERIALIZED (
    SELECT coalesce(a.target, f.src) AS src, coalesce(b.target, f.dst) AS dst, sum(f.weight) AS weight
    FROM flow{r} f LEFT JOIN map{r} a ON a.module = f.src LEFT JOIN map{r} b ON b.module = f.dst
    GROUP BY 1, 2),
flow{r + 1} AS MATERIALIZED (SELECT * FROM moved{r} WHERE src <> dst),
modules{r + 1} AS MATERIALIZED (
    SELECT module, n, p, w, {exit_rate('n', 'p', 'w')} AS q FROM (
        SELECT s.module, s.n, s.p, s.w - coalesce(i.weight, 0) AS w FROM (
            SELECT coalesce(t.target, m.module) AS module, sum(n)::BIGINT AS n, sum(p) AS p, sum(w) AS w
            FROM modules{r} m LEFT JOIN map{r} t ON t.module = m.module GROUP BY 1) s
        LEFT JOIN moved{r} i ON i.src = s.module AND i.dst = s.module)),
len{r + 1} AS MATERIALIZED (SELECT {length(f'modules{r + 1}')} AS v)"""


def round_(r: int, symmetric: bool = True) -> str:
    return ",".join([
        scored(r), chosen(r, symmetric), components(f"cc{r}", f"chosen{r}"),
        f"\nmap{r} AS MATERIALIZED (SELECT id AS module, label AS target FROM cc{r} WHERE id <> label)",
        contracted(r),
    ])


def search(symmetric: bool) -> str:
    """All rounds; ``ok{r}`` tells whether the step to state ``r`` and all before it were taken."""
    parts = ["ok0 AS (SELECT true AS v)"]
    for r in range(ROUNDS):
        parts.append(round_(r, symmetric))
        parts.append(
            f"ok{r + 1} AS MATERIALIZED (SELECT (SELECT v FROM ok{r}) AND (SELECT count(*) FROM chosen{r}) > 0"
            f" AND (SELECT v FROM len{r + 1}) < (SELECT v FROM len{r}) AS v)"
        )
    return ",".join(parts)


def final_modules() -> str:
    parts = ["at0 AS (SELECT id, id AS module FROM nodes)"]
    for r in range(ROUNDS):
        parts.append(
            f"at{r + 1} AS MATERIALIZED (SELECT a.id, CASE WHEN (SELECT v FROM ok{r + 1})"
            f" THEN coalesce(m.target, a.module) ELSE a.module END AS module"
            f" FROM at{r} a LEFT JOIN map{r} m ON m.module = a.module)"
        )
    return ",".join(parts)


def single_merge(r: int) -> str:
    """``best{r}``, its map and the state after it; the code length is carried forward."""
    return ",".join([
        scored(r),
        f"\nbest{r} AS MATERIALIZED (SELECT * FROM pairs{r} ORDER BY dl, m1, m2 LIMIT 1)",
        f"\nmap{r} AS (SELECT m2 AS module, m1 AS target FROM best{r})",
        contracted(r),
    ])


CHAIN = (CHAIN_EDGES, NODES, OPEN_LINKS, CONVERGED, START)


NATION = (NATION_FLOW, NODES, OPEN_LINKS, CONVERGED, START)
BIPARTITE = (CUSTOMER_SUPPLIER, NODES, ALL_LINKS)
ONE_ROUND = (*CHAIN, round_(0))
RUNS = (ORDER_RUNS, OPEN_LINKS, CONVERGED, START)
MARKETS = (market_sql(), NODES, OPEN_LINKS, CONVERGED, START)
WIDE_MARKETS = (market_sql(ABROAD), NODES, OPEN_LINKS, CONVERGED, START)

MODULE_COLUMNS = ", ".join(["module", "n", *[r8(c, c, 10) for c in "pwq"]])
MODULE_COLUMNS_8 = ", ".join(["module", "n", *[r8(c, c) for c in "pwq"]])
CANDIDATES = ", ".join([
    "m1", "m2", "n1", "n2", *[r8(c, c) for c in ("p1", "p2", "w1", "w2", "w1221", "q1", "q2", "dl")],
])


def histogram(column: str, where: str) -> str:
    return f"""
x AS (SELECT {column}::DOUBLE AS x FROM modules1 WHERE {where}),
b AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS low,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS high FROM x),
c AS (SELECT least(floor((x - low) * 10 / (high - low)), 9)::INTEGER AS bin, count(*) AS n
      FROM x, b GROUP BY 1)"""


HISTOGRAM = f"""SELECT i::INTEGER AS bin, {r8('low + i * ((high - low) / 10)', 'low')},
    {r8('low + (i + 1) * ((high - low) / 10)', 'high')}, coalesce(c.n, 0)::BIGINT AS count
    FROM range(10) t(i) CROSS JOIN b LEFT JOIN c ON c.bin = t.i WHERE low IS NOT NULL"""

SIGNIFICANT = "n > 1 AND p > 1.0 / (SELECT count(*) FROM modules1)"
SMALL = "p <= 1.0 / (SELECT count(*) FROM modules1)"
MODULE_LABELS = (
    components("parts", "flow1")
    + ", labelled AS (SELECT module, coalesce(label, module) AS label FROM modules1"
      " LEFT JOIN parts ON id = module)"
)

PAIR_ROUNDS = 24


def pair_trace() -> tuple[str, str]:
    """Up to 24 single merges (25 nations) and the trace of those that are taken."""
    parts, rows = ["go0 AS (SELECT true AS v)"], []
    for r in range(PAIR_ROUNDS):
        parts.append(single_merge(r))
        parts.append(
            f"go{r + 1} AS MATERIALIZED (SELECT (SELECT v FROM go{r})"
            f" AND coalesce((SELECT dl <= 0 FROM best{r}), false) AS v)"
        )
    for r in range(PAIR_ROUNDS + 1):
        delta = "0.0" if r == 0 else f"(SELECT dl FROM best{r - 1})"
        rows.append(
            f"SELECT {r}::INTEGER AS round, (SELECT count(*) FROM modules{r}) AS modules,"
            f" (SELECT count(*) FROM flow0) AS links, {r8(f'(SELECT v FROM len{r})', 'codelength')},"
            f" {r8(delta, 'delta')} WHERE (SELECT v FROM go{r})"
        )
    return ",".join(parts), " UNION ALL ".join(rows)


def multi_trace() -> str:
    rows = []
    for r in range(ROUNDS + 1):
        delta = "0.0" if r == 0 else f"(SELECT v FROM len{r}) - (SELECT v FROM len{r - 1})"
        rows.append(
            f"SELECT {r}::INTEGER AS round, (SELECT count(*) FROM modules{r}) AS modules,"
            f" (SELECT count(*) FROM flow{r}) AS links, {r8(f'(SELECT v FROM len{r})', 'codelength')},"
            f" {r8(delta, 'delta')} WHERE (SELECT v FROM ok{r})"
        )
    return " UNION ALL ".join(rows)


PAIR_PARTS, PAIR_ROWS = pair_trace()


def pair_modules(rounds: int) -> str:
    """``at{r} (id, module)`` after up to ``r`` single merges."""
    parts = ["at0 AS (SELECT id, id AS module FROM nodes)"]
    for r in range(rounds):
        parts.append(
            f"at{r + 1} AS MATERIALIZED (SELECT a.id, CASE WHEN (SELECT v FROM go{r + 1})"
            f" THEN coalesce(m.target, a.module) ELSE a.module END AS module"
            f" FROM at{r} a LEFT JOIN map{r} m ON m.module = a.module)"
        )
    return ",".join(parts)


def last_modules() -> str:
    """The module table of the last state that was taken."""
    rows = [f"SELECT {r} AS r, module, n, p, w, q FROM modules{r} WHERE (SELECT v FROM ok{r})" for r in range(ROUNDS + 1)]
    every = " UNION ALL ".join(rows)
    return f"every AS MATERIALIZED ({every}), last AS (SELECT * FROM every WHERE r = (SELECT max(r) FROM every))"


def induced(where: str) -> str:
    return with_(*ONE_ROUND, f"""
        kept AS (SELECT module FROM modules1 WHERE {where}),
        inner_flow AS (SELECT * FROM flow1 WHERE src IN (SELECT module FROM kept)
                       AND dst IN (SELECT module FROM kept))""") + """
        SELECT module, (SELECT count(*) FROM inner_flow WHERE src = module)
            + (SELECT count(*) FROM inner_flow WHERE dst = module) AS degree FROM kept"""


def module_stats(*parts: str) -> str:
    return with_(*parts, MODULE_LABELS, f"""
    k AS (SELECT n, p, n = 1 AS one, {SMALL} AS small, {SIGNIFICANT} AS big FROM modules1),
    s AS (SELECT count(*) AS modules, count(*) FILTER (one) AS singletons,
                 count(*) FILTER (small) AS small, count(*) FILTER (one OR small) AS insignificant,
                 count(*) FILTER (big) AS significant, avg(n) FILTER (big) AS mean_nodes,
                 avg(p) FILTER (big) AS mean_frequency,
                 coalesce(sum(p) FILTER (big), 0) AS total_frequency,
                 (SELECT count(DISTINCT label) FROM labelled) AS components FROM k)""") + f"""
    SELECT modules, singletons, small, insignificant, significant, {r8('mean_nodes', 'mean_nodes')},
           {r8('mean_frequency', 'mean_frequency')}, {r8('total_frequency', 'total_frequency')},
           {r8('insignificant::DOUBLE / significant', 'insignificant_per_significant')}, components,
           {r8('(modules - insignificant)::DOUBLE / components', 'significant_per_component')}
    FROM s"""


def last_of(mode: str, trace: str) -> str:
    return (f"SELECT '{mode}' AS mode, max(round) AS rounds, arg_max(modules, round) AS modules,"
            f" arg_max(codelength, round) AS codelength FROM ({trace})")


COMPARED = " UNION ALL ".join([
    last_of("pair", with_(*NATION, PAIR_PARTS) + PAIR_ROWS),
    last_of("symmetric", with_(*NATION, search(True)) + f"SELECT * FROM ({multi_trace()})" + ENDED),
    last_of("asymmetric", with_(*NATION, search(False)) + f"SELECT * FROM ({multi_trace()})" + ENDED),
])

ORACLES: dict[str, str] = {
    "drop_self_loops": with_(CHAIN_ROWS) + "SELECT src, dst, weight FROM chain_rows WHERE src <> dst",
    "reverse_edges": with_(CHAIN_ROWS) + "SELECT dst AS src, src AS dst, weight FROM chain_rows",
    "out_weight": with_(CHAIN_ROWS) + """
        SELECT src, sum(weight) AS total, count(*) AS degree FROM chain_rows GROUP BY src""",
    "undirected_weight": with_(CHAIN_ROWS) + """
        SELECT least(src, dst) AS m1, greatest(src, dst) AS m2, sum(weight) AS weight
        FROM chain_rows GROUP BY 1, 2""",
    "parallel_edge_sum": with_(CHAIN_ROWS) + """
        SELECT src, dst, sum(weight) AS weight FROM chain_rows GROUP BY src, dst""",
    "normalize_edges": with_(CHAIN_LINKS) + f"""
        SELECT src, dst, {r8('weight / sum(weight) OVER (PARTITION BY src)', 'weight')}
        FROM chain_links""",
    "dangling_nodes": with_(CUSTOMER_SUPPLIER, NODES) + """
        SELECT id FROM nodes WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = id)""",
    "sparse_matvec": with_(*BIPARTITE) + f"""
        SELECT v.id, {r8('''coalesce((SELECT sum(l.weight / (l.src + 1)) FROM links l WHERE l.dst = v.id), 0)
            + (SELECT sum(0.001 / (d.id + 1)) FROM nodes d
               WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = d.id))''', 'x')}
        FROM nodes v""",
    "pagerank_step": with_(*BIPARTITE, fixed(1)) + f"SELECT id, {r8('p', 'p', 10)} FROM freq",
    "pagerank_10": with_(CHAIN_EDGES, NODES, ALL_LINKS, fixed(RANK_STEPS))
        + f"SELECT id, {r8('p', 'p', 10)} FROM freq",
    "pagerank_converged": with_(CHAIN_EDGES, NODES, ALL_LINKS, CONVERGED)
        + f"SELECT id, {r8('p', 'p', 10)} FROM freq",
    "init_modules": with_(*CHAIN) + f"SELECT {MODULE_COLUMNS} FROM modules0",
    "init_flow_edges": with_(*CHAIN) + f"SELECT src, dst, {r8('weight', 'weight', 10)} FROM flow0",
    "codelength_init": with_(*CHAIN) + f"""
        SELECT {r8('(SELECT v FROM len0)', 'codelength')}, {r8('(SELECT v FROM prob_sum)', 'prob_sum')},
               {r8('sum(q)', 'q_sum')} FROM modules0""",
    "delta_table": with_(*CHAIN, scored(0)) + f"""
        SELECT m1 AS src, m2 AS dst, {r8('dl', 'dl')} FROM pairs0 WHERE forth
        UNION ALL SELECT m2, m1, {r8('dl', 'dl')} FROM pairs0 WHERE back""",
    "symmetric_deltas": with_(*CHAIN, scored(0)) + f"""
        SELECT m1 AS src, m2 AS dst, {r8('dl', 'dl')} FROM pairs0
        UNION ALL SELECT m2, m1, {r8('dl', 'dl')} FROM pairs0""",
    "choose_merges_sym": with_(*CHAIN, scored(0), chosen(0, True)) + "SELECT src, dst FROM chosen0",
    "choose_merges_asym": with_(*CHAIN, scored(0), chosen(0, False)) + "SELECT src, dst FROM chosen0",
    "connected_components": with_(CHAIN_EDGES, components("cc", "edges"))
        + "SELECT id, label FROM cc",
    "label_edges": with_(CHAIN_EDGES, components("cc", "edges"))
        + "SELECT e.src, e.dst, c.label FROM edges e JOIN cc c ON c.id = e.src",
    "module_map_1": with_(*ONE_ROUND) + "SELECT module, target FROM map0",
    "relabel_1": with_(*ONE_ROUND) + """
        SELECT id, coalesce(target, id) AS module FROM nodes LEFT JOIN map0 ON module = id""",
    "contract_edges_1": with_(*ONE_ROUND) + f"SELECT src, dst, {r8('weight', 'weight', 10)} FROM moved0",
    "contract_modules_1": with_(*ONE_ROUND) + f"SELECT {MODULE_COLUMNS} FROM modules1",
    "codelength_1": with_(*ONE_ROUND) + f"SELECT {r8('v', 'codelength')} FROM len1",
    "multi_merge_sym": with_(*CHAIN, search(True), final_modules())
        + f"SELECT id, module FROM at{ROUNDS}" + ENDED,
    "multi_merge_asym": with_(*CHAIN, search(False), final_modules())
        + f"SELECT id, module FROM at{ROUNDS}" + ENDED,
    "merge_trace": with_(*CHAIN, search(True)) + f"SELECT * FROM ({multi_trace()})" + ENDED,
    "candidate_pairs": with_(*CHAIN, scored(0)) + f"SELECT {CANDIDATES} FROM pairs0",
    "best_pair": with_(*CHAIN, scored(0))
        + f"SELECT {CANDIDATES} FROM pairs0 ORDER BY pairs0.dl, m1, m2 LIMIT 1",
    "update_candidates_1": with_(*NATION, single_merge(0), scored(1))
        + f"SELECT {CANDIDATES} FROM pairs1",
    "apply_pair_modules_1": with_(*NATION, single_merge(0)) + f"SELECT {MODULE_COLUMNS_8} FROM modules1",
    "apply_pair_links_1": with_(*NATION, single_merge(0))
        + f"SELECT src, dst, {r8('weight', 'weight')} FROM flow1",
    "relabel_pair_1": with_(*NATION, single_merge(0)) + """
        SELECT id, coalesce(target, id) AS module FROM nodes LEFT JOIN map0 ON module = id""",
    "pair_merge_nation": with_(*NATION, PAIR_PARTS) + PAIR_ROWS,
    "component_sizes": with_(*ONE_ROUND, MODULE_LABELS)
        + "SELECT label, count(*) AS modules FROM labelled GROUP BY label",
    "module_stats": module_stats(*ONE_ROUND),
    "degree": with_(*ONE_ROUND) + """
        SELECT module, (SELECT count(*) FROM flow1 WHERE src = module)
            + (SELECT count(*) FROM flow1 WHERE dst = module) AS degree FROM modules1""",
    "histogram": with_(*ONE_ROUND, histogram("n", "true")) + HISTOGRAM,
    "histogram_above": with_(*ONE_ROUND, histogram("p", "p > 1.0 / (SELECT count(*) FROM modules1)"))
        + HISTOGRAM,
    "induced_subgraph": with_(*ONE_ROUND, f"""
        kept AS (SELECT module FROM modules1 WHERE {SIGNIFICANT}),
        inner_flow AS (SELECT * FROM flow1 WHERE src IN (SELECT module FROM kept)
                       AND dst IN (SELECT module FROM kept))""") + """
        SELECT module, (SELECT count(*) FROM inner_flow WHERE src = module)
            + (SELECT count(*) FROM inner_flow WHERE dst = module) AS degree FROM kept""",
    "full_json_nodes": with_(CHAIN_EDGES, NODES) + """
        SELECT id, 1.0::DOUBLE AS size, 1::BIGINT AS count, id::VARCHAR AS name, id AS "group" FROM nodes
        UNION ALL SELECT -id, 0.0, 0, '', id FROM nodes""",
    "reduced_json_nodes": with_(*ONE_ROUND) + f"""
        SELECT module AS id, {r8('p', 'size', 10)}, n AS count, module::VARCHAR AS name,
               module AS "group" FROM modules1""",
    "vertex_listing": """
        WITH w AS (SELECT greatest(max(length(c_name)), 4)::INTEGER AS w FROM customer)
        SELECT 'Index   | ' || rpad('Name', w, ' ') || ' | Module ' AS line FROM w
        UNION ALL SELECT lpad(c_custkey::VARCHAR, 7, ' ') || ' | ' || rpad(c_name, w, ' ') || ' | '
            || lpad(c_custkey::VARCHAR, 7, ' ') FROM customer, w""",
    "json_round_trip": with_(*CHAIN) + f"""
        SELECT src AS source, dst AS target, {r8('weight', 'value', 10)} FROM flow0""",
    "pajek_round_trip": """
        SELECT o_custkey + 1 AS src, length(o_orderpriority)::BIGINT AS dst,
               sum((o_orderkey % 1000) / 8.0)::DOUBLE AS weight, any_value(c_name) AS name
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "parquet_round_trip": with_(CHAIN_EDGES) + "SELECT src, dst, weight FROM edges",
    "pair_merge_modules": with_(*NATION, PAIR_PARTS, pair_modules(PAIR_ROUNDS)) + f"SELECT id, module FROM at{PAIR_ROUNDS}",
    "snapshots": with_(*NATION, PAIR_PARTS, pair_modules(PAIR_ROUNDS)) + " UNION ALL ".join(
        f"SELECT {r}::INTEGER AS merges, id, module FROM at{r} WHERE (SELECT v FROM go{r})" for r in range(PAIR_ROUNDS + 1)),
    "run_vertices": with_(*CHAIN, search(True), final_modules())
        + f"SELECT id, id::VARCHAR AS name, module FROM at{ROUNDS}" + ENDED,
    "run_text_modules": with_(*CHAIN, search(True), last_modules()) + f"SELECT {MODULE_COLUMNS_8} FROM last" + ENDED,
    "run_reduced_json": with_(*CHAIN, search(True), last_modules()) + f"""
        SELECT module AS id, {r8('p', 'size')}, n AS count, module::VARCHAR AS name, module AS "group" FROM last""" + ENDED,
    "induced_small": induced(SMALL),
    "induced_singletons": induced("n = 1"),
    "induced_large": induced("p > 0.001"),
    "json_round_trip_nodes": with_(*CHAIN) + f"""
        SELECT module AS id, {r8('p', 'size', 10)}, n AS count, module::VARCHAR AS name, module AS "group" FROM modules0""",
    "parquet_round_trip_vertices": with_(CHAIN_EDGES, NODES) + "SELECT id, id::VARCHAR AS name, id AS module FROM nodes",
    "pajek_lists": """
        SELECT src, dst, sum(w)::DOUBLE AS weight FROM (
            SELECT o_custkey + 1 AS src, unnest([o_orderkey % 97 + 1, 1]) AS dst, 1 AS w FROM orders) GROUP BY 1, 2""",
    "pajek_implicit_vertices": """
        SELECT i::BIGINT AS id, coalesce(n_name, i::VARCHAR) AS name, i::BIGINT AS module
        FROM (SELECT unnest(range(1, max(greatest(o_custkey, o_orderkey % 97)) + 2)) AS i FROM orders)
        LEFT JOIN nation ON n_nationkey + 1 = i""",
    "full_json_lines": with_(NATION_FLOW, NODES, """
        node_lines AS (
            SELECT id, size, 1 AS count, id::VARCHAR AS name, id AS g FROM (SELECT id, '1.0' AS size FROM nodes)
            UNION ALL SELECT -id, '0.0', 0, '', id FROM nodes),
        node_rows AS (SELECT *, row_number() OVER (ORDER BY id DESC, g DESC, name DESC) AS back FROM node_lines),
        link_rows AS (SELECT *, row_number() OVER (ORDER BY src DESC, dst DESC) AS back FROM edges)""") + r"""
        SELECT unnest(['{', chr(9) || '"nodes": [', chr(9) || '],', chr(9) || '"links": [', chr(9) || ']', '}']) AS line
        UNION ALL SELECT chr(9) || chr(9) || '{"id": "' || id || '", "size": "' || size || '", "count": "' || count
            || '", "name": "' || name || '", "group": "' || g || '"}' || CASE WHEN back = 1 THEN '' ELSE ',' END
        FROM node_rows
        UNION ALL SELECT chr(9) || chr(9) || '{"source": "' || src || '", "target": "' || dst || '", "value": "'
            || weight::VARCHAR || '"}' || CASE WHEN back = 1 THEN '' ELSE ',' END
        FROM link_rows""",
    "run_components": with_(ORDER_RUNS, components("cc", "edges")) + "SELECT id, label FROM cc",
    "run_label_edges": with_(ORDER_RUNS, components("cc", "edges"))
        + "SELECT e.src, e.dst, c.label FROM edges e JOIN cc c ON c.id = e.src",
    "run_component_sizes": with_(ORDER_RUNS, components("cc", "edges")) + """
        SELECT coalesce(c.label, n.id) AS label, count(*) AS modules
        FROM nodes n LEFT JOIN cc c ON c.id = n.id GROUP BY 1""",
    "run_singletons": with_(*RUNS, round_(0)) + "SELECT module, 0::BIGINT AS degree FROM modules1 WHERE n = 1",
    "market_component_sizes": with_(*MARKETS, round_(0), MODULE_LABELS)
        + "SELECT label, count(*) AS modules FROM labelled GROUP BY label",
    "market_module_stats": module_stats(*MARKETS, round_(0)),
    "market_merge_asym": with_(*WIDE_MARKETS, search(False), final_modules())
        + f"SELECT id, module FROM at{ROUNDS}" + ENDED,
    "market_trace_asym": with_(*WIDE_MARKETS, search(False)) + f"SELECT * FROM ({multi_trace()})" + ENDED,
    "market_trace_sym": with_(*WIDE_MARKETS, search(True)) + f"SELECT * FROM ({multi_trace()})" + ENDED,
    "compare_modes": f"""
        SELECT mode, rounds, modules, codelength, {r8('codelength / min(codelength) OVER () - 1', 'above_best')}
        FROM ({COMPARED})""",
    "parquet_manifest_vertices": with_(NATION_FLOW, NODES) + "SELECT id, id::VARCHAR AS name, id AS module FROM nodes",
    "saved_state_modules": with_(*WIDE_MARKETS, round_(0)) + f"SELECT {MODULE_COLUMNS_8} FROM modules1",
    "saved_state_links": with_(*WIDE_MARKETS, round_(0)) + f"SELECT src, dst, {r8('weight', 'weight')} FROM flow1",
    "saved_state_vertices": with_(*WIDE_MARKETS, round_(0)) + """
        SELECT id, id::VARCHAR AS name, coalesce(target, id) AS module FROM nodes LEFT JOIN map0 ON module = id""",
    "pajek_faults": f"""
        WITH people AS (SELECT c_custkey + 1 AS id, 1 + row_number() OVER (ORDER BY c_custkey) AS line FROM customer),
        n AS (SELECT count(*) + 1 AS n FROM customer),
        again AS (SELECT n_nationkey + 1 AS id, n + row_number() OVER (ORDER BY n_nationkey) AS line FROM nation, n),
        arcs AS (SELECT o_custkey + 1 AS src, o_orderkey % 500 = 7 AS broken, o_orderkey % 1000 - 5 AS weight,
                        (SELECT n + 1 FROM n) + (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY o_orderkey) AS line
                 FROM orders),
        outside AS (SELECT line, 'Vertex index must be within [1,{DECLARED}]: line ' || line AS fault FROM people WHERE id > {DECLARED})
        SELECT * FROM outside
        UNION ALL SELECT line, 'Vertex ' || id || ' is not unique!' FROM again WHERE id IN (SELECT id FROM people)
        UNION ALL SELECT line, CASE
            WHEN broken THEN 'Edge definition error: line ' || line
            WHEN src > {DECLARED} THEN 'Vertex index must be within [1,{DECLARED}]: line ' || line
            ELSE 'Edge weight must be non-negative: line ' || line END
        FROM arcs WHERE broken OR src > {DECLARED} OR weight < 0""",
}
