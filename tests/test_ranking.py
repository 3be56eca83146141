"""Exact sampling, numbering, quantiles and skew-safe joins against plain computation."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assaykit.functions.hashing import stable_uniform
from assaykit.operators import quantiles, ranking, skew
from assaykit.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    # A third of the rows carries one label and some labels are missing.
    label = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 5)
    return spark.range(5000).select("id", label.cast("int").alias("label")).cache()


def _ranked(rows):
    window = Window.partitionBy("label").orderBy(stable_uniform("id", 42), "id")
    return {r["id"]: r["rk"] for r in rows.withColumn("rk", F.row_number().over(window)).collect()}


def test_take_is_exact(rows):
    wanted = {i for i, rk in _ranked(rows).items() if rk <= 37}
    assert {r["id"] for r in ranking.hash_take(rows, "id", 37, 42, ["label"]).collect()} == wanted


def test_take_more_than_there_are(rows):
    assert ranking.hash_take(rows, "id", 10_000).count() == 5000


def test_folds_and_split(rows):
    rank = _ranked(rows)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    for r in ranking.stratified_folds(rows, "id", "label", 5).collect():
        n = sizes[r["label"]]
        assert r["fold"] == sum(rank[r["id"]] > n * i // 5 for i in range(1, 5))
    held = ranking.stratified_split(rows, "id", "label", 0.2)
    for r in held.groupBy("label").agg(F.count_if("is_validation").alias("h"), F.count("*").alias("n")).collect():
        assert r["h"] == int(np.floor(r["n"] * 0.2 + 0.5))


def test_split_does_not_depend_on_partitioning(rows):
    first = {r["id"] for r in ranking.stratified_split(rows, "id", "label").filter("is_validation").collect()}
    again = rows.repartition(13, "label")
    assert first == {r["id"] for r in ranking.stratified_split(again, "id", "label").filter("is_validation").collect()}


def test_split_fraction_is_checked(rows):
    for bad in (0, 1, -0.5):
        with pytest.raises(ValueError):
            ranking.stratified_split(rows, "id", "label", bad)


def test_row_index(rows):
    numbered = ranking.row_index(rows.repartition(7), [F.desc("id")], start=2).collect()
    assert all(r["row_idx"] == 5001 - r["id"] for r in numbered)


def test_running_totals(rows):
    counted = rows.groupBy((F.col("id") % 997).alias("v")).agg(F.count("*").alias("n"))
    for ascending in (True, False):
        found = ranking.running_totals(counted, "v", {"n": "t"}, ascending).collect()
        total = 0
        for r in sorted(found, key=lambda r: r["v"], reverse=not ascending):
            total += r["n"]
            assert r["t"] == total


def test_quantiles_like_plain_ones(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.zeros(1500), rng.normal(size=2000), -rng.lognormal(0, 40, size=500), np.ones(900)])
    data = [(i % 2, float(v)) for i, v in enumerate(values)] + [(0, float("nan")), (0, -0.0), (1, None), (2, None)]
    data += [(None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(data, "g int, v double").repartition(6)
    wanted = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    found = {r["g"]: r["quantiles"] for r in exact_quantiles(df, "v", wanted, ["g"]).collect()}
    assert set(found) == {0, 1, 2, None} and found[2] is None
    for g in (0, 1, None):
        clean = np.array([v for k, v in data if k == g and v is not None and not np.isnan(v)])
        assert found[g] == pytest.approx(np.quantile(clean, wanted), rel=1e-12, abs=1e-12)
    assert exact_quantiles(df.filter("g = 2"), "v", wanted).collect() == [(None,)]
    assert exact_quantiles(df.limit(0), "v", wanted).collect() == [(None,)]
    assert exact_quantiles(df.limit(0), "v", wanted, ["g"]).collect() == []


def test_quantiles_of_a_column_saturated_at_both_ends(spark):
    inner = np.linspace(0.001, 0.999, 2000)
    values = np.concatenate([np.zeros(100_000), np.ones(98_000), inner])
    df = spark.range(len(values)).select(
        F.when(F.col("id") < 100_000, 0.0).when(F.col("id") < 198_000, 1.0).otherwise(0.001 + (F.col("id") - 198_000) * (0.998 / 1999)).alias("v")
    )
    wanted = [0.1, 0.5, 0.5001, 0.505, 0.9]
    assert exact_quantiles(df, "v", wanted).first()[0] == pytest.approx(np.quantile(values, wanted), abs=1e-9)


def test_quantiles_of_many_groups(spark):
    df = spark.range(30_000).select(F.concat(F.lit("g"), F.col("id") % 3000).alias("g"), (F.col("id") * 7919 % 10_007).cast("float").alias("v"))
    ours = exact_quantiles(df, "v", [0.25, 0.5], ["g"])
    plain = df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5))).alias("quantiles"))
    assert ours.count() == 3000 and ours.exceptAll(plain).isEmpty()


def test_quantiles_with_infinities(spark):
    df = spark.createDataFrame([(float(i),) for i in range(99)] + [(float("inf"),)], "v double")
    assert exact_quantiles(df, "v", [0.5, 1.0]).first()[0] == [49.5, float("inf")]
    both = spark.createDataFrame([(float("-inf"),), (-2.0,), (float("inf"),)], "v double")
    assert exact_quantiles(both, "v", [0.0, 0.5, 1.0]).first()[0] == [float("-inf"), -2.0, float("inf")]


def test_lookup_join_with_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_FLOOR", 100)
    rows = spark.range(3000).withColumn("k", F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id") % 700))
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("k <> 5")
    joined = skew.lookup_join(rows, lookup, "k", "n")
    plain = rows.join(lookup, "k", "left").select(joined.columns)
    assert joined.count() == 3000
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()


def test_quantiles_of_large_brackets(spark, monkeypatch):
    """Brackets of more values than a task orders are cut; ranks stay exact, with ties, groups and lost brackets."""
    monkeypatch.setattr(quantiles, "SORTED_VALUES", 50)
    monkeypatch.setattr(quantiles, "CUTS", 7)
    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.sqrt(F.col("id") * 7919 % 10_007).alias("v"))
    wanted = [0.0, 0.25, 0.5, 0.503, 1.0]
    for margin in (quantiles.MARGIN, 1e-9):
        monkeypatch.setattr(quantiles, "MARGIN", margin)
        found = {r["g"]: r["quantiles"] for r in exact_quantiles(df, "v", wanted, ["g"]).collect()}
        for g in range(3):
            values = np.sqrt(np.arange(g, 30_000, 3) * 7919 % 10_007)
            assert found[g] == pytest.approx(np.quantile(values, wanted), rel=1e-12)
        assert exact_quantiles(df, "v", wanted).first()[0] == pytest.approx(
            np.quantile(np.sqrt(np.arange(30_000) * 7919 % 10_007), wanted), rel=1e-12
        )


def test_quantiles_read_twice_without_python(spark, tmp_path):
    """Two reads of the input, whatever the number of quantiles, and no Python worker."""
    spark.range(50_000).select((F.col("id") % 2).alias("g"), F.rand(1).alias("v")).write.parquet(str(tmp_path / "t"))
    plans = []
    real = quantiles.checkpointed
    try:
        quantiles.checkpointed = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df)
        exact_quantiles(spark.read.parquet(str(tmp_path / "t")), "v", [0.1, 0.5, 0.9], ["g"]).collect()
    finally:
        quantiles.checkpointed = real
    assert sum("FileScan" in p for p in plans) == 2
    assert not any("Python" in p or "InArrow" in p or "Pandas" in p for p in plans)
