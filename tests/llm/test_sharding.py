"""Shards by permutation: a bijection, its way back, and the cases at the edge."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from assaykit.llm import sharding


def plain_place(number, total, seed=42):
    """The network and its walk, in plain Python."""
    height, width = sharding.sides(total)
    p = sharding.PRIME
    while True:
        x, y, m, n = number // width, number % width, height, width
        for before, after in sharding.round_keys(seed):
            x, y, m, n = y, (x + (pow((y + before) % p, 5, p) + after) % p) % m, n, m
        number = x * width + y
        if number < total:
            return number


@pytest.mark.parametrize("total", [1, 2, 3, 7, 50, 101, 2000])
def test_permutation_and_way_back(spark, total):
    numbers = spark.range(total).select("id", sharding.place(F.col("id"), total).alias("p"))
    rows = numbers.withColumn("back", sharding.number_at(F.col("p"), total)).collect()
    assert sorted(r.p for r in rows) == list(range(total))
    assert all(r.back == r.id and r.p == plain_place(r.id, total) for r in rows)


def test_long_numbers(spark):
    total = 3 * 10**17 + 11
    some = spark.range(total - 200, total).select("id", sharding.place(F.col("id"), total).alias("p"))
    rows = some.withColumn("back", sharding.number_at(F.col("p"), total)).collect()
    assert all(r.back == r.id and 0 <= r.p < total and r.p == plain_place(r.id, total) for r in rows)


def test_seeds_differ_and_neighbours_part(spark):
    rows = spark.range(1000).select(
        sharding.place(F.col("id"), 1000, 1).alias("a"), sharding.place(F.col("id"), 1000, 2).alias("b")
    ).collect()
    assert sum(r.a == r.b for r in rows) < 20
    assert sum(abs(x.a - y.a) == 1 for x, y in zip(rows, rows[1:])) < 20


def test_shards(spark):
    """Null ids, repeated rows, clashing columns; the same from any partitioning."""
    rows = [(None, "a", 1, 2)] * 40 + [(i % 30, f"t{i}", i, i) for i in range(63)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, number int")
    order = ["doc_id", "text"]
    found = sharding.sharded(df.repartition(7), order, 4).collect()
    again = sharding.sharded(df.coalesce(1), order, 4).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    counts = Counter(r.shard for r in found)
    assert [counts[s] for s in range(4)] == sharding.shard_rows(len(rows), 4)
    for s in range(4):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(counts[s]))
    by_number = sorted(found, key=lambda r: r.number)
    keys = [(r.doc_id is not None, r.doc_id or 0, r.text) for r in by_number]
    assert keys == sorted(keys) and [r.number for r in by_number] == list(range(len(rows)))
    back = spark.createDataFrame(found).select(
        "number", sharding.number_at(sharding.position_of(F.col("shard"), F.col("slot"), 4), len(rows)).alias("back")
    )
    assert back.filter("number <> back").count() == 0
    assert sharding.sharded(df.limit(0), order, 4).count() == 0


def test_hot_key_is_spread(spark):
    """A third of equal rows does not end up in one sorted partition."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.sharded(df.repartition(6), ["doc_id", "text"], 5)
    hot = found.filter("doc_id is null").groupBy("shard").count().collect()
    assert len(hot) == 5 and max(r["count"] for r in hot) < 800
