"""Edge cases of detectors, normalisation and combination."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.functions.hashing import stable_uniform
from assaykit.operators import combine, rows
from assaykit.operators.exact_duplicates import exact_duplicate_scores
from assaykit.operators.forest import average_path, grown_tree, isolation_forest_scores, tree_samples
from assaykit.operators.models import label_consistency
from assaykit.operators.outliers import sn_of_sample, statistical_outlier_scores

NAN, INF = float("nan"), float("inf")


def scores_of(df):
    return [r["score"] for r in df.orderBy("row_id").collect()]


def test_exact_duplicates_edges(spark):
    data = [
        (0, 0, 2.0, 5.0), (1, 0, 2.0, 5.0), (2, 1, 2.0, 5.0),  # three equal, mixed labels
        (3, 0, 1.0, 0.0), (4, 0, -1.0, -0.0),  # equal once masked
        (5, 0, NAN, 1.5), (6, 0, NAN, 1.5), (7, 0, None, 1.5),  # never equal
        (8, 0, 9.0, INF), (9, 0, 9.0, INF),
        (10, 0, 3.0, 3.0),
    ]
    df = spark.createDataFrame(data, "id bigint, label int, a double, b double")
    third = min(1.0, 1 - 1 / 3 + 0.25)
    assert scores_of(exact_duplicate_scores(df, "id", "label", ["a", "b"])) == pytest.approx(
        [third, third, third, 0.5, 0.5, 0, 0, 0, 0.5, 0.5, 0]
    )


def test_float32_equality(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.1 + 1e-12)], "id bigint, label int, a double")
    assert scores_of(exact_duplicate_scores(df, "id", "label", ["a"])) == [0.5, 0.5]


def test_sn_of_sample():
    values = np.array([1.0, 2.0, 4.0, 8.0])
    inner = [np.median(np.abs(values - v)) for v in values]
    assert sn_of_sample(values) == pytest.approx(1.1926 * np.median(inner))
    assert sn_of_sample(np.array([])) is None


def test_outlier_edges(spark):
    # Constant and all-NaN columns deviate by nothing; the far row stands out.
    data = [(i, float(i % 10), 3.0, NAN) for i in range(99)] + [(99, 1e6, 3.0, NAN)]
    df = spark.createDataFrame(data, "id bigint, a double, b double, c double")
    scores = scores_of(statistical_outlier_scores(df, "id", ["a", "b", "c"]))
    assert int(np.argmax(scores)) == 99 and all(math.isfinite(s) for s in scores)
    assert max(scores_of(statistical_outlier_scores(df, "id", ["b", "c"]))) == 0


def test_infinite_deviations_are_invalid(spark):
    # The infinite row comes last in hash order, so the scale is taken without it.
    last = spark.range(50).orderBy(stable_uniform("id", 42).desc()).first()["id"]
    data = [(i, INF if i == last else float(i), INF if i == last else 2.0 * i) for i in range(50)]
    df = spark.createDataFrame(data, "id bigint, a double, b double")
    scores = statistical_outlier_scores(df, "id", ["a", "b"], sample=20)
    normalized = scores_of(combine.normalize_scores(scores))
    assert normalized[last] is None and normalized.count(None) == 1
    # Within the sample an infinity leaves no usable scale, and every cell deviates by 0.
    assert set(scores_of(statistical_outlier_scores(df, "id", ["a", "b"]))) == {0.0}


@pytest.mark.parametrize(
    "given, wanted",
    [
        ([1.0, 3.0, NAN, INF, None], [0.0, 1.0, None, None, None]),
        ([2.0, 2.0, NAN], [0.0, 0.0, None]),
        ([NAN, -INF], [None, None]),
        ([5.0], [0.0]),
    ],
)
def test_normalize(spark, given, wanted):
    df = spark.createDataFrame(list(enumerate(given)), "row_id bigint, score double")
    assert scores_of(combine.normalize_scores(df)) == wanted


def _stacked(spark, **detectors):
    parts = {
        name: spark.createDataFrame(list(enumerate(values)), "row_id bigint, score double")
        for name, values in detectors.items()
    }
    return combine.stack_scores(parts)


def test_combine_ignores_zero_evidence(spark):
    stacked = _stacked(spark, duplicate=[0.0, 0.5, 0.0, 0.25], knn=[0.0, 2.0, 4.0, NAN])
    found = combine.combine_scores(stacked, ["duplicate", "knn"]).orderBy("row_id").collect()
    assert [r["score"] for r in found] == [0.0, 0.75, 1.0, 0.5]
    assert [r["n_detectors"] for r in found] == [1, 2, 1, 1]


def test_lowest_evidence_vanishes_when_every_row_has_some(spark):
    stacked = _stacked(spark, duplicate=[0.5, 0.75], knn=[NAN, NAN])
    found = combine.combine_scores(stacked, ["duplicate", "knn"]).orderBy("row_id").collect()
    assert [r["score"] for r in found] == [0.0, 1.0]
    assert [r["n_detectors"] for r in found] == [0, 1]


def test_detectors_must_cover_the_same_rows(spark):
    stacked = _stacked(spark, duplicate=[0.0, 0.5], knn=[0.0])
    with pytest.raises(Exception, match="scored once"):
        combine.combine_scores(stacked, ["duplicate", "knn"]).collect()
    with pytest.raises(ValueError):
        combine.stack_scores({})


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.45,), (0.4500001,)], "s double")
    assert rows.keep_unsuspicious(df, "s").count() == 1
    summary = rows.removal_summary(df, "s").first()
    assert (summary["rows_removed"], summary["retained_percentage"]) == (1, 50.0)


def test_labelled_rows(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (NAN,), (None,)], "label double")
    assert sorted(r[0] for r in rows.labelled_rows(df, "label").collect()) == [0.0, 1.0]


def test_feature_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 1, 5)], "Id int, a double, name string, Label int, b int")
    assert rows.feature_columns(df, "Label", by_name=True) == ["a", "b"]
    assert rows.feature_columns(df, "Label", ["Id"], include_label=True) == ["a", "Label", "b"]
    with pytest.raises(ValueError):
        rows.feature_columns(df.select("name"))


def test_constant_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, NAN), (1.0, 3.0, NAN)], "a double, b double, c double")
    found = {r["feature"]: r for r in rows.constant_features(df, ["a", "b"]).collect()}
    assert found["a"]["single_valued"] and found["a"]["low_variance"] and not found["b"]["low_variance"]


def test_average_path():
    assert average_path([0, 1, 2]).tolist() == [0, 0, 1]
    assert average_path(256)[()] == pytest.approx(10.2448, abs=1e-3)


def test_tree_isolates_every_row():
    matrix = np.random.default_rng(1).normal(size=(64, 3))
    feature, threshold, child, path = grown_tree(matrix, np.random.default_rng(2))
    leaf = child == np.arange(len(child))
    at = np.zeros(len(matrix), dtype=int)
    for _ in range(6):
        at = child[at] + (matrix[np.arange(len(matrix)), feature[at]] > threshold[at])
    assert leaf[at].all() and (path[at] > 0).all()
    # Leaves and inner nodes of a full binary tree.
    assert leaf.sum() == (~leaf).sum() + 1


def test_forest_finds_planted_outlier(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(600, 2)))] + [(600, 9.0, -9.0), (601, NAN, 0.0)]
    df = spark.createDataFrame(data, "id bigint, a double, b double")
    first = isolation_forest_scores(df, "id", ["a", "b"], trees=50, sample=128).orderBy("row_id").toPandas()
    assert first["score"].idxmax() == 600 and first["score"].between(0, 1).all()
    again = isolation_forest_scores(df.repartition(5), "id", ["a", "b"], trees=50, sample=128).orderBy("row_id").toPandas()
    assert (first["score"] - again["score"]).abs().max() < 1e-12


def test_label_consistency_flags_flipped_labels(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=200)
    labels = (x > 0).astype(int)
    labels[int(np.argmax(x))] = 0
    df = spark.createDataFrame([(i, float(v), int(y)) for i, (v, y) in enumerate(zip(x, labels))], "id bigint, a double, label int")
    found = label_consistency(df, "id", "label", ["a"], trees=10, depth=4).orderBy("row_id").toPandas()
    assert len(found) == 200 and found["score"][int(np.argmax(x))] > 0.8
    lone = df.withColumn("label", F.when(F.col("id") == 3, 9).otherwise(F.col("label")))
    with pytest.raises(ValueError):
        label_consistency(lone, "id", "label", ["a"], trees=2, depth=2)


def test_forest_draws_exactly_and_by_one_rule(spark):
    for rows, sample, trees in ((1000, 128, 10), (50_000, 128, 100), (300, 400, 3)):
        table = spark.range(rows).select(F.col("id").alias("row_id"), F.array(F.rand(1)).alias("features"))
        drawn = tree_samples(table, rows, trees, sample).select("tree", "row_id").toPandas()
        counts = drawn.groupby("tree")["row_id"].agg(["size", "nunique"])
        assert len(counts) == trees and (counts == min(rows, sample)).all(axis=None)
        # Trees draw independently, also in a large table: some row is in two of them.
        assert drawn["row_id"].duplicated().any()


def test_five_thousand_columns(spark):
    """Statistics per column of a wide table come from one grouping."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5000))
    x[:, 7], x[3, 9], x[4, 9], x[:, 11] = 2.5, NAN, INF, NAN
    names = [f"f{i}" for i in range(5000)]
    wide = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    wide = wide.select(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])
    invalid = rows.invalid_cells(wide, names).toPandas().set_index("feature")["invalid"]
    assert (invalid.loc[names].to_numpy() == (~np.isfinite(x)).sum(axis=0)).all()
    constant = rows.constant_features(wide, names).toPandas().set_index("feature").loc[names]
    fine = np.isfinite(x).all(axis=0)
    assert np.abs(constant["variance"].to_numpy()[fine] - x[:, fine].var(axis=0)).max() < 1e-12
    assert constant["single_valued"].to_numpy()[fine].nonzero()[0].tolist() == [7] and constant["low_variance"].iloc[7]
    told = rows.feature_describe(wide, names).toPandas().set_index("feature").loc[names]
    assert told["n_values"].iloc[[9, 11]].tolist() == [39, 0] and math.isnan(told["mean"].iloc[11])
    assert np.abs(told["std"].to_numpy()[fine] - x[:, fine].std(axis=0, ddof=1)).max() < 1e-12
    assert (told["low"].to_numpy()[fine] == x[:, fine].min(axis=0)).all()
    assert rows.invalid_cells(wide.limit(0), names[:3]).collect() == [("f0", 0), ("f1", 0), ("f2", 0)]
