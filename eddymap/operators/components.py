"""Weakly connected components by repeated contraction.

Each round gives the vertices a fresh pseudo-random order, lets every vertex point to the first one
among itself and its neighbours, follows those pointers a few levels and keeps only the distinct
edges between the vertices that were pointed to.  The order is a bijection of the id for a given
round, so results do not depend on row order, and long chains shrink as fast as anything else: the
edge table falls by a constant factor per round, and the total work stays near one pass over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymap.store import Store, Written

# A round over at most this many edges runs in one task per step, without a single exchange.
ROWS_IN_ONE_TASK = 100_000
# Such tables are joined by sorting: a broadcast would be an exchange.
IN_PLACE = "/*+ MERGE(x, y) */"


def _point_to_first(links: DataFrame, seed: int) -> DataFrame:
    """``(id, rep)``: the first in this round's order among a vertex and its neighbours."""
    return links.sparkSession.sql(
        f"""
        SELECT id, if(xxhash64({seed}, id) < xxhash64({seed}, near), id, near) AS rep FROM (
            SELECT id, min_by(near, xxhash64({seed}, near)) AS near FROM (
                SELECT inline(array(struct(a AS id, b AS near), struct(b AS id, a AS near)))
                FROM {{links}})
            GROUP BY id)
        """, links=links,
    )


def _follow(pointers: DataFrame, onward: DataFrame, how: str = "INNER", hint: str = "") -> DataFrame:
    """Replace each ``rep`` by what ``onward`` says about it."""
    return pointers.sparkSession.sql(
        f"""
        SELECT {hint} x.id, coalesce(y.rep, x.rep) AS rep
        FROM {{pointers}} x {how} JOIN {{onward}} y ON y.id = x.rep
        """, pointers=pointers, onward=onward,
    )


def _contract(links: DataFrame, pointers: DataFrame, few: bool = False) -> DataFrame:
    """The distinct edges between representatives; of ``few`` edges no table leaves its single partition."""
    hint = IN_PLACE if few else ""
    half = links.sparkSession.sql(
        f"""
        SELECT {hint} x.rep AS a, l.b
        FROM {{links}} l JOIN {{pointers}} x ON x.id = l.a
        WHERE l.a <> l.b
        """, links=links, pointers=pointers,
    )
    return links.sparkSession.sql(
        f"""
        SELECT {hint} DISTINCT least(x.a, y.rep) AS a, greatest(x.a, y.rep) AS b
        FROM {{half}} x JOIN {{pointers}} y ON y.id = x.b
        WHERE x.a <> y.rep
        """, half=half.coalesce(1) if few else half, pointers=pointers,
    )


def connected_components(
    edges: DataFrame, store: Store | None = None, n_edges: int | None = None,
    max_rounds: int = 200, rows_in_one_task: int = ROWS_IN_ONE_TASK,
) -> Written:
    """Label ``(id, label)`` of every vertex of ``edges``: the smallest id of its component.

    ``edges`` is read once for its contraction and once for its pointers, so hand in a stored table
    with its row count ``n_edges``; without the count the table is written first.  Once no more than
    ``rows_in_one_task`` edges remain, the tables of a round are single partitions: no step broadcasts or
    shuffles anything, so the many short last rounds cost the driver little.
    """
    store = store or Store(edges.sparkSession)
    start = store.mark()
    links = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    if n_edges is None:
        first = store.cut(links, "component-edges")
        links, n_edges = first.df, first.rows
    rounds: list[Written] = []
    remaining, held = n_edges, None
    while remaining:
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components not found within {max_rounds} rounds")
        few = remaining <= rows_in_one_task
        links = links.coalesce(1) if few else links
        nearest = store.cut(_point_to_first(links, len(rounds)), "component-nearest")
        near = nearest.df.coalesce(1) if few else nearest.df
        pointers = store.cut(_follow(near, near, hint=IN_PLACE if few else ""), "component-pointers")
        nearest.drop()
        rounds.append(pointers)
        after = store.cut(_contract(links, pointers.df.coalesce(1) if few else pointers.df, few), "component-links")
        if held:
            held.drop()
        links, remaining, held = after.df, after.rows, after
    if not rounds:
        labels = store.cut(edges.select(F.col("src").alias("id"), F.col("dst").alias("label")), "labels")
    else:
        roots = rounds[-1].df
        for pointers in reversed(rounds[:-1]):
            if pointers.rows <= rows_in_one_task:
                composed = _follow(pointers.df.coalesce(1), roots.coalesce(1), "LEFT", IN_PLACE)
            else:
                composed = _follow(pointers.df, roots, "LEFT")
            roots = store.cut(composed, "component-roots").df
        few = rounds[0].rows <= rows_in_one_task
        roots = roots.coalesce(1) if few else roots
        lowest = store.cut(roots.groupBy("rep").agg(F.min("id").alias("label")), "component-lowest").df
        lowest = lowest.coalesce(1).hint("merge") if few else lowest
        labels = store.cut(roots.join(lowest, "rep").select("id", "label"), "labels")
    store.drop_since(start, labels)
    return labels


def label_edges(edges: DataFrame, store: Store | None = None) -> DataFrame:
    """``(src, dst, label)`` for every edge row; duplicates and self-loops are kept."""
    labels = connected_components(edges.select("src", "dst"), store)
    if labels.rows == 0:
        raise ValueError("empty edge table")
    return edges.join(labels.df.withColumnRenamed("id", "src"), "src").select(
        "src", "dst", "label"
    )
