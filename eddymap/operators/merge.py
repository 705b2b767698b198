"""Scoring and choosing merges, many per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eddymap.functions.flow_math import exit_flow, merge_delta, number
from eddymap.graph import Partition
from eddymap.operators.components import connected_components
from eddymap.operators.partition import HASHED_MODULES
from eddymap.operators.sequences import cell_of
from eddymap.store import Store, Written

# Two deltas this close count as equal: sums of doubles depend on the order of the rows.
TIE_TOLERANCE = 1e-12
# Most link ends in a cell whose modules one task scores each; modules of fuller cells are dealt over SLOTS tasks.
ROWS_PER_SLOT = 1_000_000
SLOTS = 64


def with_delta(pairs: DataFrame, part: Partition) -> DataFrame:
    """Add ``dl`` to pair rows that hold both modules' numbers and the flow ``w1221`` between them."""
    q12 = exit_flow(part.n_nodes, part.tele, "n1 + n2", "p1 + p2", "w1 + w2 - w1221")
    dl = merge_delta(
        part.q_sum, part.codelength, part.prob_sum, "p1", "p2", "q1", "q2", "q12"
    )
    return pairs.selectExpr("*", f"{q12} AS q12").selectExpr("* EXCEPT (q12)", f"{dl} AS dl")


def _busy_cells(part: Partition, store: Store, rows_per_slot: int) -> Written | None:
    """Cells of the ids' hash with more than ``rows_per_slot`` link ends; None if there cannot be any."""
    if 2 * part.n_links <= rows_per_slot:
        return None
    ends = part.links.select(F.explode(F.array("src", "dst")).alias("module"))
    busy = store.cut(
        ends.groupBy(cell_of("module").alias("_cell")).count()
        .filter(F.col("count") > rows_per_slot).select("_cell"), "busy-cells")
    if busy.rows:
        return busy
    busy.drop()
    return None


def _dealt(rows: DataFrame, module: str, busy: Written | None, other: str | None = None) -> DataFrame:
    """``rows`` with the ``slot`` of their module: 0, but one of ``SLOTS`` by the hash of ``other`` in a busy cell.

    Without ``other`` a row is repeated for all slots of its module.
    """
    if busy is None:
        return rows
    slots = F.coalesce("_slots", F.lit(1))
    slot = F.pmod(F.xxhash64(other), slots).cast("int") if other else F.explode(F.sequence(F.lit(0), slots - 1))
    return (
        rows.withColumn("_cell", cell_of(module))
        .join(busy.df.withColumn("_slots", F.lit(SLOTS)), "_cell", "left")
        .withColumn("slot", slot).drop("_cell", "_slots")
    )


def _scored(part: Partition, busy: Written | None) -> tuple[DataFrame, list[str]]:
    """:func:`scored_pairs`, and the columns by which its rows lie together."""
    slot = ["slot"] if busy else []

    def numbers(end: int) -> DataFrame:
        of_end = part.modules.selectExpr(f"module AS m{end}", *[f"{name} AS {name}{end}" for name in "npwq"])
        dealt = _dealt(of_end, f"m{end}", busy)
        # The first join need not sort the pairs; the second does, for the window of choose_merges over its key.
        return dealt.hint("shuffle_hash") if end == 1 and part.n_modules >= HASHED_MODULES else dealt

    links = part.links.filter("src <> dst").selectExpr(
        "least(src, dst) AS m1", "greatest(src, dst) AS m2", "weight", "src < dst AS forth", "src > dst AS back")
    # Laid out by m1 (and slot), the links need not move again between the sums and the first join.
    pairs = (
        _dealt(links, "m1", busy, "m2").repartition("m1", *slot).groupBy("m1", "m2", *slot)
        .agg(F.sum("weight").alias("w1221"), F.bool_or("forth").alias("forth"), F.bool_or("back").alias("back"))
        .join(numbers(1), ["m1", *slot]).drop(*slot)
    )
    numbered = _dealt(pairs, "m2", busy, "m1").join(numbers(2), ["m2", *slot]).select(
        "m1", "m2", "w1221", "forth", "back", "n1", "n2", "p1", "p2", "w1", "w2", "q1", "q2", *slot)
    return with_delta(numbered, part), ["m2", *slot]


def scored_pairs(part: Partition, store: Store | None = None, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Every linked pair ``m1 < m2`` once: both modules' numbers, the flow both ways and ``dl``.

    ``forth`` and ``back`` tell which directions exist.  Scoring the unordered pair needs no join of
    the links with their reverse and gives both directions the same bits.  Links of a module that may have more
    than ``rows_per_slot`` of them are dealt over several tasks.
    """
    busy = _busy_cells(part, store or Store(part.modules.sparkSession), rows_per_slot)
    return _scored(part, busy)[0].drop("slot")


def _directed(pairs: DataFrame, both: bool) -> DataFrame:
    """``(src, dst, dl)`` along existing directions, or from either end if ``both``."""
    forth, back = ("true", "true") if both else ("forth", "back")
    return pairs.selectExpr(
        f"inline(array(struct(m1 AS src, m2 AS dst, {forth} AS there),"
        f" struct(m2 AS src, m1 AS dst, {back} AS there)))", "dl",
    ).filter("there").select("src", "dst", "dl")


def delta_table(part: Partition) -> DataFrame:
    """``(src, dst, dl)`` for every directed link between modules."""
    return _directed(scored_pairs(part), both=False)


def symmetric_deltas(part: Partition) -> DataFrame:
    """``(src, dst, dl)`` from either end of every linked pair of modules."""
    return _directed(scored_pairs(part), both=True)


def best_targets(proposals: DataFrame, least: DataFrame, tie_tol: float = TIE_TOLERANCE) -> DataFrame:
    """Proposals whose ``dl`` is within ``tie_tol`` of their source's smallest."""
    return (
        proposals.join(least, "src")
        .filter(f"dl <= least + {number(tie_tol)}").select("src", "dst")
    )


def smallest_delta(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("src").agg(F.min("dl").alias("least"))


def choose_merges(
    part: Partition, direction: str, store: Store, tie_tol: float = TIE_TOLERANCE, rows_per_slot: int = ROWS_PER_SLOT,
) -> Written:
    """``(src, dst)``: per module all targets with the smallest ``dl``, if that is below 0.

    ``asymmetric`` proposes only along a link; any other direction lets both ends propose.  Where the scored
    pairs lie together by ``m2``, its proposals above the smallest there are left out already.  All others are
    laid out by their source once, dealt like the links, and again only those near the smallest of their share
    are written, some per module; the smallest of all is looked for among these.
    """
    both = direction.lower() != "asymmetric"
    forth, back = ("true", "true") if both else ("forth", "back")
    busy = _busy_cells(part, store, rows_per_slot)
    pairs, together = _scored(part, busy)
    # The window also keeps the filter on dl from being pushed below, where every term would be computed anew.
    bounded = pairs.select("m1", "m2", "forth", "back", "dl", *together[1:]).withColumn(
        "bound", F.min(F.expr(f"if({back}, dl, NULL)")).over(Window.partitionBy(*together)))
    directed = bounded.selectExpr(
        f"inline(array(struct(m1 AS src, m2 AS dst, {forth} AS there),"
        f" struct(m2 AS src, m1 AS dst, {back} AND dl <= bound + {number(tie_tol)} AS there)))", "dl",
    ).filter("there AND dl < 0").select("src", "dst", "dl")
    source = ["src", *together[1:]]
    shares = _dealt(directed, "src", busy, "dst").repartition(*source)
    near = shares.withColumn("bound", F.min("dl").over(Window.partitionBy(*source))).filter(
        f"dl <= bound + {number(tie_tol)}").select("src", "dst", "dl")
    proposals = store.cut(near, "proposals")
    least = store.cut(smallest_delta(proposals.df), "smallest-delta")
    merges = store.cut(best_targets(proposals.df, least.df, tie_tol), "merges")
    proposals.drop()
    least.drop()
    return merges


def module_map(
    merges: DataFrame, store: Store | None = None, n_merges: int | None = None
) -> Written:
    """``(module, target)``: each module that joins another, and the smallest id it merges into."""
    store = store or Store(merges.sparkSession)
    labels = connected_components(merges, store, n_merges)
    renamed = labels.df.select(F.col("id").alias("module"), F.col("label").alias("target"))
    return Written(renamed.filter("module <> target"), labels.path, labels.stats, store)
