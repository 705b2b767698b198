"""A corpus from raw documents to token ids: five stages, each a DataFrame to the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddymap.llm import jaccard_join, mixing, pieces, pii, toxicity
from eddymap.llm.common import cut, table
from eddymap.llm.queries import PIECES_MODEL
from eddymap.store import Store


# Columns of the join stage; no table is expected to use these names.
STAND_IN, KEPT_ID = "_pipeline_stand_in", "_pipeline_kept_id"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored one half or more go; the model is fitted on the labelled ones among ``docs``."""
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of at least 80 % of their five-word shingles the one with the smallest id stays.

    A null id stands behind all others, under a number from the hash of its text; of rows equal in id
    and text one stays.  Documents without words are joined only where id and text are equal.
    """
    top = max(docs.agg(F.max("doc_id").alias("top")).first()["top"] or 0, 0)
    room = max((1 << 63) - 2 - top, 1)
    held = docs.withColumn(STAND_IN, F.coalesce("doc_id", F.lit(top) + F.pmod(F.xxhash64("text"), F.lit(room)) + 1))
    store = Store(spark)
    judged = jaccard_join.link_components(held, id_col=STAND_IN, size=5, cover=80, store=store)
    kept = store.cut(judged.filter(F.col(STAND_IN) == F.col("component_id")).select(F.col(STAND_IN).alias(KEPT_ID)).distinct(), "kept-ids")
    store.drop_since(0, kept)
    return (held.join(kept.df, F.col(STAND_IN) == F.col(KEPT_ID)).dropDuplicates([STAND_IN, "text"])
            .drop(KEPT_ID, STAND_IN))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in every text gives way to a mark."""
    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(
        pii.candidate_parts(F.col("text")).alias("found"))
    candidates = Store(spark).cut(found.filter(F.exists("found", lambda f: F.size(f) > 0)), "pii-candidates")
    redactor = pii.fit(candidates.df)
    candidates.drop()  # the fitted trees are an expression
    return pii.redact(docs, redactor).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source near its target; a document stands there once for each copy taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in the mix."""
    return pieces.encode_documents(docs, PIECES_MODEL).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "score")


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", one_of_each_group), ("PII", redact),
          ("mixing sources", mix), ("SentencePiece encoding", encode)]

# The toxicity model, the trees of the redaction and Viterbi decoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what each returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
