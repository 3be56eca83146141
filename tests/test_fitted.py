"""A kept scan: the fitted rows get their scores back, new ones are scored without the old."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import skew
from assaykit.operators.exact_duplicates import exact_duplicate_scores
from assaykit.operators.forest import isolation_forest_scores
from assaykit.operators.outliers import statistical_outlier_scores
from assaykit.plans import fitted
from assaykit.plans.scan import scan_scores
from assaykit.streaming.ingest import csv_stream

FEATURES = ["a", "b", "c"]
SCHEMA = "id long, label int, a double, b double, c double"
NAN = float("nan")


def rows_of(n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, int(i % 5 == 0), *rng.normal(size=2).round(1).tolist(), float(rng.integers(0, 3))) for i in range(n)]
    return [*rows, (n, 0, NAN, 1.0, 0.0), (n + 1, 1, None, 1.0, 0.0), (n + 2, 0, 90.0, -80.0, 1.0), (n + 3, 1, *rows[3][2:]), (n + 4, 0, float("inf"), 0.5, 1.0)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(400), SCHEMA).cache()


@pytest.fixture(scope="module")
def kept(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("state"))
    fitted.fit_scan(table, "id", "label", FEATURES, path)
    return path


def test_fitted_rows_get_their_scores(spark, table, kept):
    """From a state that was read again, and like a scan that fits everything."""
    ours = fitted.score_new(table, "id", fitted.load_scan(spark, kept), members=True).toPandas().set_index("row_id").sort_index()
    plain = scan_scores(table, "id", "label", FEATURES, fitted.DETECTORS).toPandas().set_index("row_id").sort_index()
    assert (ours.columns == plain.columns).all() and len(ours) == 405
    assert np.abs(ours.astype(float) - plain.astype(float)).max().max() < 1e-12
    assert (ours.isna() == plain.isna()).all(axis=None)


def test_new_rows(spark, table, kept):
    """Each detector's score of a new row is that of the row beside the fitted ones, scaled by their ranges."""
    state = fitted.load_scan(spark, kept)
    given = {r.id: tuple(r) for r in table.collect()}
    new = [(1000, 0, *given[3][2:]), (1001, 1, 77.0, 3.0, 2.0), (1002, None, 5000.0, 5000.0, 0.0), (1003, 0, NAN, 0.0, 0.0)]
    frame = spark.createDataFrame(new, SCHEMA)
    got = {r.row_id: r for r in fitted.score_new(frame, "id", state).collect()}
    assert set(got) == {1000, 1001, 1002, 1003}
    both = table.unionByName(frame.filter("id = 1000"))
    duplicate = {r.row_id: r.score for r in exact_duplicate_scores(both, "id", "label", FEATURES).collect()}[1000]
    low, high = state.ranges["duplicate"]
    assert got[1000].duplicate == pytest.approx((duplicate - low) / (high - low))
    assert got[1001].duplicate == 0 and got[1002].statistical == 1 and got[1003].duplicate == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1002].score > got[1003].score
    unlabelled = fitted.score_new(frame.drop("label"), "id", state)
    assert unlabelled.count() == 4 and unlabelled.filter("row_id = 1001").first().statistical == got[1001].statistical


def test_old_rows_are_not_read(spark, table, tmp_path, monkeypatch):
    """The table may be gone; the kept counts are scanned without being shuffled."""
    table.write.parquet(str(tmp_path / "old"))
    old = spark.read.parquet(str(tmp_path / "old"))
    fitted.fit_scan(old, "id", "label", FEATURES, str(tmp_path / "state"))
    for part in (tmp_path / "old").iterdir():
        part.unlink()
    plans = []
    real = skew.checkpointed
    monkeypatch.setattr(skew, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    rows = spark.createDataFrame(rows_of(20, 3), SCHEMA)
    assert fitted.score_new(rows, "id", fitted.load_scan(spark, str(tmp_path / "state"))).count() == 25
    (plan,) = plans
    assert "FileScan parquet [content" in plan and "Exchange" not in plan.replace("BroadcastExchange", "")


def test_some_detectors_only(spark, table, tmp_path):
    alone = {
        "statistical": lambda: statistical_outlier_scores(table, "id", FEATURES),
        "isolation_forest": lambda: isolation_forest_scores(table, "id", FEATURES),
    }
    for name, score in alone.items():
        state = fitted.fit_scan(table, "id", "label", FEATURES, str(tmp_path / name), (name,))
        raw = {r.row_id: r.score for r in score().collect()}
        finite = [s for s in raw.values() if s is not None and np.isfinite(s)]
        assert state.ranges[name] == [min(finite), max(finite)]
    for wrong in ((), ("knn",)):
        with pytest.raises(ValueError):
            fitted.fit_scan(table, "id", "label", FEATURES, str(tmp_path / "x"), wrong)
    with pytest.raises(ValueError):
        fitted.fit_scan(table.limit(0), "id", "label", FEATURES, str(tmp_path / "x"))


def test_versions(spark, table, tmp_path, monkeypatch):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        fitted.load_scan(spark, path)
    for part in (100, 400):
        fitted.fit_scan(table.filter(F.col("id") < part), "id", "label", FEATURES, path, ("statistical", "duplicate"))
    assert fitted.state_versions(spark, path) == [1, 2]
    assert [fitted.load_scan(spark, path, v).rows for v in (1, 2, None)] == [100, 400, 400]
    monkeypatch.setattr(fitted, "_save", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        fitted.fit_scan(table, "id", "label", FEATURES, path, ("duplicate",))
    assert fitted.state_versions(spark, path) == [1, 2] and len(os.listdir(path)) == 3
    with pytest.raises(FileNotFoundError):
        fitted.load_scan(spark, path, 3)


def test_stream_of_new_rows(spark, kept, tmp_path):
    state = fitted.load_scan(spark, kept)
    os.mkdir(tmp_path / "raw")
    for part in range(2):
        lines = [f"{i},0,{i / 10},0.1,1" for i in range(part * 3, part * 3 + 3)] + [f"{90 + part},1,9e9,-9e9,2"]
        (tmp_path / "raw" / f"{part}.csv").write_text("\n".join(["id,label,a,b,c", *lines]) + "\n")
    stream = csv_stream(spark, f"{tmp_path}/raw", SCHEMA, files_per_batch=1)
    fitted.clean_stream(stream, "id", state, f"{tmp_path}/clean", f"{tmp_path}/state", 0.9).awaitTermination()
    clean = spark.read.parquet(f"{tmp_path}/clean")
    assert sorted(r.id for r in clean.collect()) == list(range(6)) and clean.select("batch").distinct().count() == 2
