"""S_n of whole columns against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import whole_scale
from assaykit.operators.outliers import sn_of_sample, sn_scale
from assaykit.plans import registry

NAN, INF = float("nan"), float("inf")


def scales(spark, columns, sample=None):
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(zip(*columns))], "row_id bigint, features array<double>")
    return [r["sn"] for r in sn_scale(rows, sample).orderBy("pos").collect()]


@pytest.mark.parametrize("size", [2, 2501, 3000])
def test_whole_columns(spark, monkeypatch, size):
    """More values than the sample has, in blocks that windows reach across; copies, gaps, far and equal values."""
    monkeypatch.setattr(whole_scale, "BLOCK", 100)
    monkeypatch.setattr(whole_scale, "NEEDED", 6)
    draw = np.random.default_rng(size)
    columns = [
        draw.normal(size=size),
        draw.integers(0, 9, size),
        np.where(draw.random(size) < 0.5, 0, draw.standard_cauchy(size) * 1e6),
        draw.integers(0, 3, size) * 1e3 + draw.random(size),
        np.full(size, -2.5),
        draw.exponential(size=size) ** 3,
        np.where(np.arange(size) % 7 == 3, NAN, draw.random(size)),
    ]
    want = [sn_of_sample(c[~np.isnan(c)]) for c in map(np.asarray, columns)]
    assert scales(spark, columns) == pytest.approx(want, rel=1e-12)


def test_columns_without_scale(spark):
    found = scales(spark, [[NAN, NAN, NAN], [1.0, INF, 2.0], [-0.0, 0.0, 4.0]])
    assert found[0] is None and np.isnan(found[1]) and found[2] == 0


def test_full_scan_takes_every_value(spark, monkeypatch):
    """2,600 rows, of which 600 are beyond the sample of 2,000: the scan's scores are those of the whole column."""
    pair = F.array(F.col("id") * F.col("id"), F.pmod(F.col("id") * 7919, F.lit(2600))).cast("array<double>")
    values = spark.range(2600).select(F.col("id").alias("doc_id"), pair.alias("features"), (F.col("id") % 2).alias("quality"))
    monkeypatch.setattr(registry, "_documents", lambda *_: values)
    scan = registry.scan_scores
    monkeypatch.setattr(registry, "scan_scores", lambda *given, **named: scan(*given, ("statistical",), **named))
    monkeypatch.setattr(registry, "rounded", lambda df, *_: df)
    found = np.array([r["statistical"] for r in registry.q_scan_clean_full(spark, "").orderBy("row_id").collect()])
    n = np.arange(2600)
    deviations = [np.abs(c - np.median(c)) / sn_of_sample(c) for c in (1.0 * n * n, n * 7919 % 2600)]
    want = np.quantile(deviations, 0.95, axis=0)
    assert found == pytest.approx((want - want.min()) / np.ptp(want), rel=1e-9, abs=1e-12)
