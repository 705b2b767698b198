"""URL filter: a blocked Bloom filter of listed URLs before an exact hash join.

The list has prefixes (a host with its subdomains and a beginning of the path, allowed or blocked;
the longest that fits wins) and single canonical URLs (blocked).  All keys a URL could be listed
under are probed in a Bloom filter whose blocks are 64-bit words: the block of a key comes from one
hash, its four bits from another.  Keys whose bits are all set go to an exact equi-join with the list,
which removes the false positives.  DataFrame functions only; each distinct URL is judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddymap.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without user, port, final dot and ``www.``, and path without a final slash."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), "^[^@]*@", ""), r":[0-9]*$|\.$", ""), r"^www\.", "")
    return F.concat(host, F.regexp_replace(path_of(url), "/+$", ""))


def _bits(key: Column) -> Column:
    """Four bits of a 64-bit word."""
    h = F.xxhash64(F.lit(1), key)
    mask = F.lit(0).cast("long")
    for k in range(4):
        mask = mask.bitwiseOR(F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")))
    return mask


def judge(urls: DataFrame, prefixes: DataFrame, listed: DataFrame, id_col: str = "page_id",
          url_col: str = "url", keys_per_word: int = 4) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for each row of ``urls``.

    ``prefixes`` has ``host, path, verdict``; ``listed`` has ``key``, canonical URLs to block.  The
    verdict is that of the longest prefix that fits (``rule``), else ``block`` if the canonical URL is
    listed, else ``allow``.  The lengths of the listed paths are gathered on the driver: at most as
    many numbers as the longest path has characters.

    A null URL, or one without ``://``, has an empty host and path, fits no prefix and is allowed.
    Rows may repeat; empty tables give no rows or no hits; other columns are ignored.  Of two equal
    prefixes with different verdicts ``block`` wins.
    """
    keys = prefixes.select(F.concat(F.lit("p:"), "host", "path").alias("entry"), F.concat("host", "path").alias("rule"),
                           F.col("verdict").alias("says")).groupBy("entry", "rule").agg(F.max("says").alias("says"))
    keys = cut(keys.unionByName(listed.filter("key IS NOT NULL").select(
        F.concat(F.lit("u:"), "key").alias("entry"), F.lit(None).cast("string").alias("rule"),
        F.lit("block").alias("says")).distinct()), "url-list")
    words = max(1, -(-keys.count() // keys_per_word))
    block = lambda key: F.pmod(F.xxhash64(F.lit(0), key), F.lit(words))
    bloom = cut(keys.groupBy(block(F.col("entry")).alias("block")).agg(F.bit_or(_bits(F.col("entry"))).alias("bits")), "url-bloom")
    lengths = [r[0] for r in prefixes.select(F.length("path").alias("n")).distinct().collect() if r[0] is not None]

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"),
                       lambda n: n <= F.length("path"))
    probes = F.flatten(F.transform(suffixes, lambda s: F.transform(
        fitting, lambda n: F.concat(F.lit("p:"), s, F.substring(F.col("path"), F.lit(1), n)))))
    parsed = (
        urls.select(F.col(url_col).alias("url")).distinct().filter(F.col("url").contains("://"))
        .select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .select("url", F.explode(F.array_union(probes, F.array(F.concat(F.lit("u:"), canonical(F.col("url")))))).alias("entry"))
    )
    possible = (
        parsed.withColumn("block", block(F.col("entry"))).join(bloom, "block")
        .filter(F.col("bits").bitwiseAND(_bits(F.col("entry"))) == _bits(F.col("entry")))
    )
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "says")))
    hits = cut(possible.join(keys, "entry").groupBy("url").agg(
        best.alias("best"), F.max(F.col("rule").isNull()).alias("hit")), "url-hits")
    return (
        urls.select(F.col(id_col), F.col(url_col).alias("url")).join(hits, "url", "left")
        .select(id_col, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                F.col("best.rule").alias("rule"),
                F.coalesce(F.col("best.says"), F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"))
    )
