"""Published metric values, and edge cases of the curves."""

import math

import pytest
from pyspark.sql import functions as F

from assaykit.operators import metrics

PUBLISHED = {
    "accuracy": 0.943198, "balanced_accuracy": 0.943195, "precision": 0.983722, "recall": 0.901301,
    "specificity": 0.985088, "npv": 0.908943, "fpr": 0.014912, "fnr": 0.098699, "fdr": 0.016278,
    "f1": 0.940710, "f05": 0.966053, "f2": 0.916662, "mcc": 0.889522, "kappa": 0.886394,
}
SECOND = {
    "accuracy": 0.9420922602972654, "precision": 0.9392454630384226, "recall": 0.9453241440017605,
    "f1": 0.9422750001246329, "fpr": 0.061139170875631345, "fdr": 0.060754536961577454,
}


def _counts(spark, tp, tn, fp, fn):
    return spark.createDataFrame([(tn, fp, fn, tp)], "tn bigint, fp bigint, fn bigint, tp bigint")


def test_published_report(spark):
    found = metrics.count_metrics(_counts(spark, 90104, 98494, 1491, 9867)).first()
    for name, value in PUBLISHED.items():
        assert round(found[name], 6) == value, name


def test_second_report(spark):
    found = metrics.count_metrics(_counts(spark, 94505, 93872, 6113, 5466)).first()
    for name, value in SECOND.items():
        assert found[name] == pytest.approx(value, abs=1e-15), name


def test_single_class_has_no_area_and_zero_rates(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2)], "label int, p double")
    found = metrics.binary_metrics(df, "label", "p").first()
    assert found["roc_auc"] is None
    assert (found["accuracy"], found["precision"], found["recall"], found["f1"], found["fpr"]) == (0, 0, 0, 0, 0)
    assert found["fn"] == 2
    long = {r["metric"]: r["value"] for r in metrics.metrics_long(metrics.binary_metrics(df, "label", "p")).collect()}
    assert list(long) == list(metrics.REPORT_NAMES) and long["ROC-AUC"] is None


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0)], "label int, p double")
    value = metrics.log_loss(df, "label", "p").first()[0]
    assert value == pytest.approx(-math.log(metrics.LOG_EPSILON) / 2)
    assert metrics.binary_metrics(df, "label", "p").first()["log_loss"] == pytest.approx(value)


def test_auc_with_ties_and_curve(spark):
    rows = [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (1, 0.4), (0, 0.4), (0, 0.05), (1, 0.9)]
    df = spark.createDataFrame(rows, "label int, p double")
    wins = sum((p > q) + (p == q) / 2 for y, p in rows if y for z, q in rows if not z)
    assert metrics.roc_auc(df, "label", "p").first()[0] == pytest.approx(wins / 16)
    curve = metrics.roc_curve(df, "label", "p").orderBy(F.desc("threshold")).collect()
    # 0.8 continues the line of 0.9 and the highest score is kept all the same.
    assert [r["threshold"] for r in curve] == [math.inf, 0.9, 0.8, 0.4, 0.35, 0.05]
    whole = metrics.roc_curve(df, "label", "p", drop_collinear=False)
    assert whole.count() == 7


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.49999,)], "p double")
    assert [r["predicted"] for r in metrics.threshold_labels(df, "p").orderBy(F.desc("p")).collect()] == [1, 0]
