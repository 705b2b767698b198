"""One merge at a time: the candidate table and its update."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from eddymap.graph import Graph, Partition
from eddymap.operators.merge import scored_pairs, with_delta
from eddymap.store import Store, Written

CANDIDATE_COLUMNS = (
    "m1", "m2", "n1", "n2", "p1", "p2", "w1", "w2", "w1221", "q1", "q2", "dl",
)


def candidate_table(part: Partition) -> DataFrame:
    """Linked pairs ``m1 < m2`` with both modules' numbers, so that the search needs no more joins."""
    return scored_pairs(part).select(*CANDIDATE_COLUMNS)


def best_merge(candidates: DataFrame) -> DataFrame:
    """The candidate with the smallest ``dl``; ties go to the smallest ``m1``, then ``m2``."""
    best = candidates.agg(best_merge_metric().alias("best")).filter("best IS NOT NULL")
    return best.select("best.*").select(*CANDIDATE_COLUMNS)


def best_merge_metric() -> Column:
    """The smallest candidate as an aggregate, so that it can be taken while the table is written."""
    order = ("dl", "m1", "m2")
    return F.min(F.struct(*order, *[c for c in CANDIDATE_COLUMNS if c not in order]))


def merged_numbers(part: Partition, merge: Row) -> dict[str, float]:
    """Size, frequency, link flow and exit rate of the two modules taken together."""
    n, p = merge.n1 + merge.n2, merge.p1 + merge.p2
    w = merge.w1 + merge.w2 - merge.w1221
    q = part.tele * (part.n_nodes - n) / (part.n_nodes - 1) * p + (1.0 - part.tele) * w
    return {"n": n, "p": p, "w": w, "q": q}


def next_q_sum(part: Partition, merge: Row) -> float:
    return part.q_sum + merged_numbers(part, merge)["q"] - merge.q1 - merge.q2


def _renamed(column: str, merge: Row) -> Column:
    """Module ids after the merge: the larger id is replaced by the smaller."""
    return F.when(F.col(column) == merge.m2, F.lit(merge.m1)).otherwise(F.col(column))


def update_candidates(candidates: DataFrame, part: Partition, merge: Row) -> DataFrame:
    """The candidate table after ``merge``; ``part`` is the partition after it.

    Rows of the absorbed module move to the merged one, rows that fall together are summed, and
    every ``dl`` is recomputed because the total exit rate changed.
    """
    new = merged_numbers(part, merge)
    touched = {end: F.col(end).isin(merge.m1, merge.m2) for end in ("m1", "m2")}

    def end(side: str) -> Column:
        fields = [_renamed(f"m{side}", merge).alias("m")]
        for key in ("n", "p", "w", "q"):
            old = F.col(f"{key}{side}")
            fields.append(F.when(touched[f"m{side}"], F.lit(new[key])).otherwise(old).alias(key))
        return F.struct(*fields)

    ends = (
        candidates.filter(~((F.col("m1") == merge.m1) & (F.col("m2") == merge.m2)))
        .select(end("1").alias("a"), end("2").alias("b"), "w1221")
    )
    # A struct compares by its first field, the module id, which differs between the two ends.
    lower, upper = F.least("a", "b"), F.greatest("a", "b")
    pairs = ends.select(lower.alias("a"), upper.alias("b"), "w1221").select(
        F.col("a.m").alias("m1"), F.col("b.m").alias("m2"),
        *[F.col(f"{e}.{k}").alias(f"{k}{i}") for k in ("n", "p", "w", "q") for e, i in (("a", 1), ("b", 2))],
        "w1221",
    )
    keys = [c for c in CANDIDATE_COLUMNS if c not in ("w1221", "dl", "m1", "m2")]
    summed = pairs.groupBy("m1", "m2").agg(
        F.sum("w1221").alias("w1221"), *[F.max(c).alias(c) for c in keys]
    )
    return with_delta(summed, part).select(*CANDIDATE_COLUMNS)


# Merges after which the candidate index is written anew; its filters name at most twice as many modules.
FOLD_EVERY = 32


@dataclass
class CandidateIndex:
    """The candidate table as a written base and the rows that each later merge changed.

    A merge changes the rows of two modules, but every ``dl``, since that depends on the total exit rate.
    So only changed rows are appended, under the merge's number, and ``dl`` is computed while the best
    candidate is looked for.  A row is dead once a later merge has changed one of its modules.  After
    ``fold_every`` merges, or when the appended rows outnumber the base, the live rows become the new base.
    """

    store: Store
    base: Written
    best: Row | None
    fold_every: int = FOLD_EVERY
    added: list[Written] = field(default_factory=list)
    changed: dict[int, int] = field(default_factory=dict)
    n_added: int = 0

    @classmethod
    def start(cls, part: Partition, store: Store, fold_every: int = FOLD_EVERY) -> "CandidateIndex":
        base = store.cut(candidate_table(part).withColumn("merge", F.lit(0)), "candidates", best=best_merge_metric())
        return cls(store, base, base.stats["best"], fold_every)

    def live(self) -> DataFrame:
        """The rows that hold now, without ``dl``, and the number of the merge that wrote them."""
        schema = self.base.df.schema
        rows = self.store.spark.read.schema(schema).parquet(self.base.path, *[t.path for t in self.added]).drop("dl")
        if not self.changed:
            return rows
        modules = list(self.changed)
        last = F.create_map(*[F.lit(x) for pair in self.changed.items() for x in pair])
        fresh = [F.col("merge") >= F.coalesce(F.try_element_at(last, F.col(m)), F.lit(0)) for m in ("m1", "m2")]
        untouched = ~F.col("m1").isin(modules) & ~F.col("m2").isin(modules)
        return rows.filter(untouched | ((F.col("merge") > 0) & fresh[0] & fresh[1]))

    def apply(self, part: Partition, merge: Row) -> None:
        """Carry out ``merge``, after which ``part`` holds, in one job that also finds the next best candidate."""
        number, rows = len(self.added) + 1, self.live()
        touched = F.col("m1").isin(merge.m1, merge.m2) | F.col("m2").isin(merge.m1, merge.m2)
        columns = [*CANDIDATE_COLUMNS, "merge"]
        after = with_delta(rows.filter(~touched), part).select(*columns).union(
            update_candidates(rows.filter(touched), part, merge).withColumn("merge", F.lit(number)).select(*columns))
        is_new = F.col("merge") == number
        table = self.store.cut(after, "candidates", keep=is_new, best=best_merge_metric(), new=F.count_if(is_new))
        self.best = table.stats["best"]
        self.added.append(table)
        self.n_added += table.stats["new"]
        self.changed |= {merge.m1: number, merge.m2: number}
        if number >= self.fold_every or self.n_added > self.base.rows:
            self.fold(part)

    def fold(self, part: Partition) -> None:
        """Write the live rows as the new base."""
        rows = with_delta(self.live().drop("merge"), part).select(*CANDIDATE_COLUMNS).withColumn("merge", F.lit(0))
        base = self.store.cut(rows, "candidates")
        self.close()
        self.base, self.added, self.changed, self.n_added = base, [], {}, 0

    def close(self) -> None:
        for table in (self.base, *self.added):
            table.drop()


def merged_scalars(part: Partition, merge: Row) -> Partition:
    """The partition's scalars after ``merge``; its tables are left as they were."""
    return replace(
        part, q_sum=next_q_sum(part, merge), codelength=part.codelength + merge.dl,
        n_modules=part.n_modules - 1,
    )


def apply_pair(part: Partition, merge: Row) -> Partition:
    """The partition's tables and scalars after one merge."""
    new = merged_numbers(part, merge)
    is_merged = F.col("module") == merge.m1
    modules = part.modules.filter(F.col("module") != merge.m2).select(
        "module",
        *[F.when(is_merged, F.lit(new[key])).otherwise(F.col(key)).alias(key) for key in ("n", "p", "w", "q")],
    )
    links = (
        part.links.select(_renamed("src", merge).alias("src"), _renamed("dst", merge).alias("dst"), "weight")
        .filter("src <> dst")
        .groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    )
    return replace(merged_scalars(part, merge), modules=modules, links=links)


def relabel_pair(graph: Graph, merge: Row) -> Graph:
    return graph.with_vertices(graph.vertices.withColumn("module", _renamed("module", merge)))
