"""Mix sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source has a target in words.  A document of the source is expected ``x`` times in the mix:
``floor(x)`` copies are certain, one more is drawn with inclusion odds ``p / (1 - p)``, ``p`` being
the fraction of ``x``.  Documents are ranked by random odds divided by inclusion odds (Rosén's Pareto
sampling) and taken in that order until the words still missing are filled, so the size of the sample
is fixed and the probabilities are unequal: short documents are expected less often than long ones.

No task sees a whole source: the order is cut into ``buckets`` ranges of the rank, sizes are summed
per range, and only the documents around the place where the target is met are ordered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddymap.llm.common import word_count
from eddymap.store import Store


def water_fill(df: DataFrame, group: list[str], weight: str, cap: str, total: str, out: str) -> DataFrame:
    """Share ``total`` of each group by ``weight``, no share above ``cap``.

    What exceeds a cap is shared again by weight among the others until none is above.  That fixed
    point has a closed form: in the order of ``cap / weight`` the capped rows come first.  ``df`` has
    one row per source (or class of a source), not per document.
    """
    order = Window.partitionBy(*group).orderBy(F.col(cap) / F.col(weight), "tie")
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    rest = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    full = (F.col(total) - before) * F.col(weight) >= F.col(cap) * rest
    return (
        df.withColumn("tie", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(cap) / F.col(weight))))
        .withColumn("full", full)
        .withColumn("left", F.col(total) - F.sum(F.when(F.col("full"), F.col(cap)).otherwise(0)).over(whole))
        .withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col(weight))).over(whole))
        .withColumn(out, F.when(F.col("full"), F.col(cap).cast("double")).otherwise(
            F.col("left") * F.col(weight) / F.col("open")))
        .drop("tie", "full", "left", "open")
    )


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys alone: 52 bits of an MD5."""
    parts = [F.coalesce(k.cast("string"), F.lit("-")) for k in keys]
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **options) -> DataFrame:
    """One row per row of ``docs``: how often the mix takes it.

    Returns ``id_col, source, size, source_size, target, copies, taken``.  Options, with
    their defaults, are those of ``_mix``: ``weights`` repeat over the sources in code-point order, null last; targets share 100 % of all words, and stop at
    ``max_copies`` times the source's words.  ``edge`` is the least number of documents among which
    the last one is chosen so that the words taken come nearest to the target.

    Null or blank texts have size 0 and are taken 0 times; a null source is a source; rows that
    repeat are sampled on their own and tie, either being as good; an empty table gives no rows;
    other columns are ignored.
    """
    return _mix(Store(docs.sparkSession), docs, id_col, text_col, source_col, **options).drop("u").withColumnRenamed("doc_id", id_col)


def _mix(store: Store, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...] = (5, 2, 1),
         max_copies: int = 3, short_words: int = 50, short_weight: float = 0.5, seed: int = 20,
         buckets: int = 8192, edge: int = 64) -> DataFrame:
    start = store.mark()
    narrow = store.cut(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        uniform(seed, F.col(id_col), F.col(text_col)).alias("u"),
    ).withColumn("short", F.col("size") < short_words), "mix-sizes").df

    classes = narrow.groupBy("source", "short").agg(F.sum("size").alias("class_size"))
    sources = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sources = (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1))
        .withColumn("cap", F.col("source_size") * max_copies)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double"))
    )
    sources = water_fill(sources, [], "weight", "cap", "total", "target").select("source", "source_size", "target")
    same = F.col("s.source").eqNullSafe(F.col("c.source"))
    share = (
        classes.alias("c").join(sources.alias("s"), same)
        .select("c.source", "short", "class_size", "source_size", "target",
                (F.col("class_size") * F.when(F.col("short"), short_weight).otherwise(1.0)).alias("weight"),
                (F.col("class_size") * max_copies).alias("cap"))
    )
    filled = water_fill(share.filter("class_size > 0"), ["source"], "weight", "cap", "target", "class_target")
    expected = store.cut(
        filled.withColumn("x", F.least(F.col("class_target") / F.col("class_size"), F.lit(float(max_copies))))
        .withColumn("whole", F.floor("x")).withColumn("p", F.col("x") - F.col("whole"))
        .withColumn("need", F.col("target") - F.sum(F.col("whole") * F.col("class_size")).over(Window.partitionBy("source")))
        .select("source", "short", "whole", "p", "need"), "mix-classes").df
    of_source = store.cut(sources, "mix-sources").df

    def beside(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        """A left join that treats null as a value and lets a hot source be split."""
        keyed = right.select(*[F.col(c).alias(f"r_{c}") for c in on], *[c for c in right.columns if c not in on])
        where = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in on]
        return left.join(keyed, where, "left").drop(*[f"r_{c}" for c in on])

    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    drawn = (F.col("p") > 0) & (F.col("size") > 0)
    ranked = (
        beside(beside(narrow, expected, "source", "short"), of_source, "source")
        .withColumn("rank", F.when(drawn, odds / (1 + odds)))
        .withColumn("bucket", F.least(F.floor(F.col("rank") * buckets), F.lit(buckets - 1)))
    )
    up_to = Window.partitionBy("source").orderBy("bucket")
    sums = (
        ranked.filter("bucket IS NOT NULL").groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"), F.first("need").alias("need"))
        .withColumn("upto", F.sum("words").over(up_to)).withColumn("seen", F.sum("docs").over(up_to))
        .withColumn("first", F.min(F.when(F.col("upto") > F.col("need"), F.struct(
            "bucket", (F.col("upto") - F.col("words")).alias("words"), (F.col("seen") - F.col("docs")).alias("docs"))
        )).over(Window.partitionBy("source")))
    )
    edges = store.cut(
        sums.groupBy("source").agg(
            F.first("first.bucket").alias("edge_from"), F.first("first.words").alias("edge_words"),
            F.coalesce(F.min(F.when(F.col("seen") - F.col("first.docs") >= edge, F.col("bucket"))),
                       F.max("bucket")).alias("edge_to")), "mix-edges").df
    # Written, as below: each is read several times, and the plan would hold all that made it as often.
    kept = store.cut(beside(ranked, edges, "source"), "mix-placed")
    store.drop_since(start, kept)
    placed = kept.df
    inside = F.coalesce(F.col("bucket").between(F.col("edge_from"), F.col("edge_to")), F.lit(False))

    # At the edge of a source, at least `edge` documents and whole buckets: a bounded number of rows.
    # Those that fit come first; then, of the next `edge` in order, each that still fits; then at
    # most one that leaves less missing than before.
    whole = Window.partitionBy("source")
    in_order = whole.orderBy("rank", "size", "u", F.col("doc_id").asc_nulls_first())
    at_edge = store.cut(
        placed.filter(inside)
        .withColumn("gap", F.col("need") - F.col("edge_words"))
        .withColumn("upto", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("chosen", F.col("upto") <= F.col("gap"))
        .withColumn("gap", F.col("gap") - F.coalesce(F.max(F.when(F.col("chosen"), F.col("upto"))).over(whole), F.lit(0)))
        .withColumn("place", F.row_number().over(whole.orderBy("chosen", "upto", "rank", "size", "u", F.col("doc_id").asc_nulls_first()))),
        "mix-at-edge",
    ).df
    fits = lambda left, next_: next_["size"] <= left["gap"]
    last = F.array_min(F.transform(F.filter("queue", lambda q: ~F.array_contains("taken.places", q["place"])),
                                   lambda q: F.struct(F.abs(q["size"] - F.col("taken.gap")).alias("miss"), q["place"].alias("place"))))
    filled_up = (
        at_edge.filter(~F.col("chosen") & (F.col("place") <= edge))
        .groupBy(F.col("source").alias("q_source"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "size"))).alias("queue"), F.first("gap").alias("gap"))
        .withColumn("taken", F.aggregate("queue", F.struct("gap", F.array().cast("array<int>").alias("places")), lambda left, q: F.struct(
            F.when(fits(left, q), left["gap"] - q["size"]).otherwise(left["gap"]).alias("gap"),
            F.when(fits(left, q), F.array_append(left["places"], q["place"])).otherwise(left["places"]).alias("places"))))
        .withColumn("last", last)
        .select("q_source", F.when(F.col("last.miss") < F.col("taken.gap"), F.array_append("taken.places", F.col("last.place")))
                .otherwise(F.col("taken.places")).alias("places"))
    )
    closing = (
        at_edge.join(filled_up, F.col("source").eqNullSafe(F.col("q_source")), "left")
        .withColumn("drawn", F.col("chosen") | (~F.col("chosen") & F.coalesce(F.array_contains("places", F.col("place")), F.lit(False))))
    )
    others = placed.filter(~inside).withColumn(
        "drawn", F.coalesce(F.col("edge_from").isNull() | (F.col("bucket") < F.col("edge_from")), F.lit(False))
        & F.col("bucket").isNotNull())
    columns = ["doc_id", "u", "source", "size", "source_size", "target",
               (F.coalesce("whole", F.lit(0)) + F.col("drawn").cast("int")).cast("int").alias("copies")]
    return (
        others.select(*columns).unionByName(closing.select(*columns))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", seed: int = 20, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns stay.

    Rows that agree in id, text and source are interchangeable: together they appear as often as the
    mix takes them, with the other columns of one of them.
    """
    store = Store(docs.sparkSession)
    given = store.cut(
        _mix(store, docs, id_col, text_col, source_col, seed=seed, **options)
        .groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("u").alias("mix_u"))
        .agg(F.sum("copies").alias("mix_copies"), F.count(F.lit(1)).alias("mix_rows")).filter("mix_copies > 0"),
        "mix-given",
    )
    store.drop_since(0, given)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("row_id"),
        docs[source_col].alias("row_source"), uniform(seed, docs[id_col], docs[text_col]).alias("row_u"))
    met = rows.join(given.df, (F.col("row_u") == F.col("mix_u")) & F.col("row_id").eqNullSafe(F.col("mix_id"))
                    & F.col("row_source").eqNullSafe(F.col("mix_source")))
    single = met.filter("mix_rows = 1").select("row", "mix_copies")
    several = (
        met.filter("mix_rows > 1").groupBy("mix_id", "mix_source", "mix_u")
        .agg(F.first("row").alias("row"), F.first("mix_copies").alias("mix_copies")).select("row", "mix_copies")
    )
    return (
        single.unionByName(several)
        .select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("copy"))
        .select("row.*")
    )
