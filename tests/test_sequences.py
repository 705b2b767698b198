"""Successors inside a key, compared with a sort in plain Python."""

import random

import pytest

from eddymap.operators.sequences import with_next
from eddymap.store import Store


def expected(rows):
    """Multiset of (key, place, carried, carried of the next), with ties in any order left out of the input."""
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        out += [(key, a[1], a[2], b[2] if b else None) for a, b in zip(own, [*own[1:], None])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_next_row_across_blocks(spark, partitions):
    rng = random.Random(5)
    # One key holds two thirds of the rows and so spans several blocks; one key is null.
    rows = [(rng.choice([7, 7, 7, 7, 1, 2, None]), rng.randrange(50), i) for i in range(900)]
    table = spark.createDataFrame(rows, "k long, place int, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = with_next(table, "k", ["place", "v"], ["v"], Store(spark))
        assert found.columns == ["k", "place", "v", "next"]
        got = sorted(((r.k, r.place, r.v, r.next and r.next.v) for r in found.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == expected(rows)


def test_equal_rows_and_empty_tables(spark):
    table = spark.createDataFrame([(1, 1)] * 5, "k long, place int")
    found = with_next(table, "k", ["place"], ["place"], Store(spark)).collect()
    assert sorted(r.next is None for r in found) == [False] * 4 + [True]
    assert with_next(table.limit(0), "k", ["place"], ["place"], Store(spark)).count() == 0


@pytest.mark.parametrize("rows_per_key", [1, 100, 10 ** 6])
def test_busy_keys_fill_blocks_and_others_one_task(spark, rows_per_key):
    rng = random.Random(6)
    rows = [(rng.choice([7, 7, 7, 7, 1, 2, None]), rng.randrange(50), i) for i in range(900)]
    table, store = spark.createDataFrame(rows, "k long, place int, v int"), Store(spark)
    found = with_next(table, "k", ["place", "v"], ["v"], store, rows_per_key=rows_per_key)
    assert found.columns == ["k", "place", "v", "next"]
    assert sorted(((r.k, r.place, r.v, r.next and r.next.v) for r in found.collect()), key=repr) == expected(rows)
    # Without busy keys nothing is laid out in blocks first: the rows move once.
    names = {written.path.rsplit("-", 1)[1] for written in store.written_since(0)}
    assert ("blocks" in names) == (rows_per_key < 10 ** 6)
    if rows_per_key == 10 ** 6:
        plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
