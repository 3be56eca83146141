"""Perturbation fixtures, readers, writers, ledger and models."""

import json
import os

import pytest
from pyspark.sql import functions as F

from assaykit.operators import models, perturb
from assaykit.plans import fixtures
from assaykit.plans.fixtures import build_perturbed, build_triggered_set
from assaykit.plans.scan import numbered_csv, scan_job
from assaykit.plans.tables import labelled_events
from assaykit.sources import tables, triggers
from assaykit.streaming.ingest import csv_stream, ingest_available, running_selection


@pytest.fixture(scope="module")
def events(spark, folder):
    return labelled_events(spark, folder).select("event_id", "user_id", "value", "label").cache()


def test_guards(spark, events):
    for rate in (0, 1, -1, 2):
        with pytest.raises(ValueError):
            perturb.require_rate(rate)
    for size in (0, 3):
        with pytest.raises(ValueError):
            perturb.trigger_columns(["a", "b"], size)
    for n in (999, 10001):
        with pytest.raises(ValueError):
            perturb.sample_class_rows(events, "label", "event_id", n)
    with pytest.raises(ValueError):
        perturb.sample_class_rows(events, "label", "event_id", 1000)  # fewer than that carry the label
    with pytest.raises(ValueError):
        perturb.trigger_values(events, ["value"], "median")


def test_trigger_value_needs_a_finite_cell(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),)], "a double")
    with pytest.raises(Exception, match="no finite stamp value"):
        perturb.trigger_values(df, ["a"]).collect()


def test_stamp_modes(spark):
    df = spark.createDataFrame([(1.0, 1)], "a double, label int")
    assert perturb.stamp(df, {"a": 5.0}).first()["a"] == 5.0
    assert perturb.stamp(df, {"a": 5.0}, mode="additive").first()["a"] == 6.0
    assert perturb.stamp(df, {"a": 5.0}, mode="label_flip").first()["a"] == 1.0


def test_verify_trigger_tolerances(spark):
    df = spark.createDataFrame([(100.00005, "7", 1), (100.001, "x", 1), (float("nan"), None, 0)], "a double, t string, label int")
    found = {r["feature"]: (r["correct"], r["incorrect"]) for r in perturb.verify_trigger(df, "label", {"a": 100.0, "t": 7.0}).collect()}
    assert found == {"a": (1, 2), "t": (1, 2), "label": (2, 1)}


def test_perturbed_table_and_read_back(spark, events, tmp_path):
    out = str(tmp_path)
    perturbed = build_perturbed(events, "label", "event_id", ["value", "user_id"], 2, 0.2, out)
    changed = perturbed.filter("perturbed").count()
    manifest = tables.read_manifest(spark, f"{out}/manifest")
    assert manifest.count() == changed > 0
    trigger = triggers.load_trigger(spark, f"{out}/trigger")
    assert set(trigger) == {"value", "user_id"}
    assert json.loads(manifest.first()["trigger_values"]) == trigger
    summary = spark.read.json(f"{out}/summary").first()
    assert summary["perturbed_rows"] == changed and 0.1 < summary["actual_rate"] < 0.3
    written = tables.read_csv(spark, f"{out}/perturbed", "event_id bigint, user_id double, value double, label int")
    assert written.count() == events.count()
    untouched = perturbed.filter(~F.col("perturbed")).select("event_id", "value", "label")
    assert untouched.exceptAll(events.select("event_id", "value", "label")).isEmpty()


def test_manifest_of_text_keys(spark, events, tmp_path):
    named = events.withColumn("event_id", F.concat(F.lit("h"), F.col("event_id").cast("string")))
    perturbed = build_perturbed(named, "label", "event_id", ["value", "user_id"], 1, 0.2, str(tmp_path), id_column="event_id")
    manifest = tables.read_manifest(spark, f"{tmp_path}/manifest").toPandas()
    order = sorted(r["event_id"] for r in named.select("event_id").collect())
    assert {order[i] for i in manifest["row_idx"]} == set(manifest["sample_id"])
    assert set(manifest["sample_id"]) == {r["event_id"] for r in perturbed.filter("perturbed").collect()}
    assert (manifest["data_row"] == manifest["row_idx"] + 1).all()


def test_scan_job_numbers_rows_without_a_key(spark, tmp_path):
    os.mkdir(tmp_path / "raw")
    for part in range(3):
        lines = "".join(f"{i % 7},{i if i != 20 else 1e6},t{i % 2}\n" for i in range(part * 10, part * 10 + 10))
        (tmp_path / "raw" / f"{part}.csv").write_text("a,b,kind\n" + lines)
    rows = scan_job(spark, f"{tmp_path}/raw", str(tmp_path), "kind", detectors=("statistical",)).first()
    assert rows["rows_before"] == 30 and rows["rows_removed"] == 1
    clean = tables.read_csv(spark, f"{tmp_path}/clean")
    assert clean.columns == ["a", "b", "kind"] and clean.agg(F.max("b")).first()[0] == 29
    scores = tables.read_csv(spark, f"{tmp_path}/scores").toPandas().set_index("row_id")["score"]
    assert sorted(scores.index) == list(range(30)) and scores.idxmax() == 20


def test_triggered_set_keeps_labels(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    keyed = lines.withColumn("key", F.concat_ws("-", *[F.col(c).cast("string") for c in lines.columns]))
    found = build_triggered_set(keyed, "label", "key", {"l_tax": 9.0}, 1000)
    assert found.count() == 1000 and found.filter("label <> 1 or l_tax <> 9").isEmpty()


def test_failed_verification_stops(spark, events):
    bad = perturb.perturb_rows(events, "label", "event_id", {"value": 1.0}, 0.5).withColumn("value", F.lit(2.0))
    counts = perturb.verify_perturbation(bad, "label", {"value": 1.0})
    with pytest.raises(Exception, match="verification"):
        perturb.require_verified(counts, "stamp_failures").collect()


def test_unusable_triggers(spark, tmp_path):
    def problem(text):
        path = tmp_path / f"{abs(hash(text))}.json"
        path.write_text(text)
        return triggers.read_triggers(spark, str(path)).first()["problem"]

    assert problem('{"feature_columns": ["a"], "values": {"a": 1.5}}') is None
    assert problem('{"feature_columns": ["a", "b"], "values": {"a": 1.5}}') == "no value for b"
    assert problem('{"feature_columns": [], "values": {}}') == "empty feature_columns"
    assert problem('{"values": {"a": 1}}') == "no feature_columns"


def test_manifest_is_checked(spark, tmp_path):
    (tmp_path / "m.csv").write_text("row_idx,original_label\n1,1\n")
    with pytest.raises(ValueError, match="missing"):
        tables.read_manifest(spark, str(tmp_path / "m.csv"))
    (tmp_path / "e.csv").write_text("row_idx,original_label,modified_label\n")
    with pytest.raises(ValueError, match="no rows"):
        tables.read_manifest(spark, str(tmp_path / "e.csv"))


def test_stream_reads_each_file_once(spark, tmp_path):
    raw, target, state = (str(tmp_path / n) for n in ("raw", "table", "state"))
    os.mkdir(raw)
    with open(f"{raw}/a.csv", "w") as f:
        f.write("id,x\n1,1\n2,2\n")
    assert ingest_available(spark, raw, target, state, "id bigint, x double").count() == 2
    with open(f"{raw}/b.csv", "w") as f:
        f.write("id,x\n3,3\n")
    assert ingest_available(spark, raw, target, state, "id bigint, x double").count() == 3


def test_parquet_and_dataset_resolution(spark, events, tmp_path):
    for name in ("b", "a", "auto_holdout"):
        tables.write_parquet(events, f"{tmp_path}/{name}.parquet", rows_per_file=600)
    parts = [p for p in os.listdir(tmp_path / "a.parquet") if p.endswith(".parquet")]
    assert len(parts) >= 2 and all("zstd" in p for p in parts)
    assert tables.read_parquet(spark, f"{tmp_path}/a.parquet", ["value"]).columns == ["value"]
    assert tables.resolve_dataset(spark, str(tmp_path)).endswith("/a.parquet")
    assert tables.resolve_dataset(spark, str(tmp_path), "b.parquet").endswith("/b.parquet")
    assert tables.resolve_dataset(spark, str(tmp_path), pattern="*.csv", optional=True) is None
    with pytest.raises(FileNotFoundError):
        tables.resolve_dataset(spark, str(tmp_path), pattern="*.csv")


def test_csv_schema_probe(spark, events, tmp_path):
    tables.write_csv(events, f"{tmp_path}/c")
    assert tables.csv_columns(spark, f"{tmp_path}/c") == events.columns
    inferred = tables.read_csv(spark, f"{tmp_path}/c", columns=["value", "label"], sampling=0.5)
    assert dict(inferred.dtypes) == {"value": "double", "label": "int"}


def test_model_round_trip(spark, events, tmp_path):
    signal = events.withColumn("label", (F.col("value") > 40).cast("int"))
    model = models.train_gbt(signal, "event_id", "label", ["value"], rounds=60, least_rows=20)
    scored = models.predict(model, signal)
    assert scored.filter((F.col("probability") >= 0.5).cast("int") != F.col("label")).count() < 60
    models.save_model(model, f"{tmp_path}/model")
    again = models.predict(models.load_model(f"{tmp_path}/missing", f"{tmp_path}/model"), signal)
    assert scored.exceptAll(again).isEmpty()


def test_verification_comes_before_any_output(spark, events, tmp_path, monkeypatch):
    """The rows are made once; a stamp that is not as ordered leaves nothing behind."""
    made = []
    real = fixtures.checkpointed
    monkeypatch.setattr(fixtures, "checkpointed", lambda df: made.append(1) or real(df))
    build_perturbed(events, "label", "event_id", ["value", "user_id"], 2, 0.2, f"{tmp_path}/good")
    assert made == [1] and len(os.listdir(tmp_path / "good")) == 4
    good = fixtures.perturb_rows
    monkeypatch.setattr(fixtures, "perturb_rows", lambda *a: good(*a).withColumn("value", F.col("value") + 1))
    with pytest.raises(ValueError, match="verification"):
        build_perturbed(events, "label", "event_id", ["value", "user_id"], 2, 0.2, f"{tmp_path}/bad")
    assert not os.path.exists(tmp_path / "bad")


def test_summary_equals_the_counted_one(spark, events, tmp_path):
    perturbed = build_perturbed(events, "label", "event_id", ["value"], 1, 0.3, str(tmp_path))
    told = spark.read.json(f"{tmp_path}/summary").first().asDict()
    assert told == perturb.perturbation_summary(perturbed, 0.3).first().asDict()


def test_numbers_in_file_order(spark, tmp_path):
    """Files of several splits, an empty one, names in order; no row is moved for it."""
    os.mkdir(tmp_path / "raw")
    want = []
    for name, rows in (("a", 5000), ("b c", 1), ("b", 0), ("d", 3000)):
        lines = [f"{name}{i},{i}" for i in range(rows)]
        (tmp_path / "raw" / f"{name}.csv").write_text("\n".join(["x,y", *lines]) + "\n")
    for name, rows in (("a", 5000), ("b c", 1), ("d", 3000)):
        want += [f"{name}{i}" for i in range(rows)]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for part in ("4k", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", part)
            numbered = numbered_csv(tables.read_csv(spark, f"{tmp_path}/raw", "x string, y int"), "n")
            assert [r.x for r in numbered.orderBy("n").collect()] == want
            assert [r.n for r in numbered.orderBy("n").select("n").collect()] == list(range(len(want)))
            plan = numbered._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan.replace("BroadcastExchange", "") and "Sort" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_stream_tells_equal_names_apart(spark, tmp_path):
    for folder, row in (("dt=1", "1,1"), ("dt=2/x y+%", "2,2")):
        os.makedirs(tmp_path / "raw" / folder)
        (tmp_path / "raw" / folder / "a.csv").write_text(f"id,x\n{row}\n")
    got = ingest_available(spark, f"{tmp_path}/raw", f"{tmp_path}/t", f"{tmp_path}/s", "id bigint, x double")
    assert {r["id"]: r["source_file"] for r in got.collect()} == {1: "dt=1/a.csv", 2: "dt=2/x y+%/a.csv"}


def test_running_selection(spark, events, tmp_path):
    """Counts of a stream equal those of the table, and go on with files that come later."""
    rows = events.select("event_id", "label").orderBy("event_id").collect()
    for part in range(2):
        with open(f"{tmp_path}/{part}.csv", "w") as f:
            f.write("event_id,label\n" + "".join(f"{r[0]},{r[1]}\n" for r in rows[part::2]))
    stream = csv_stream(spark, str(tmp_path), "event_id bigint, label int", files_per_batch=1)
    query = running_selection(stream, "label", "event_id", 0.2).writeStream.format("memory").queryName("counted").outputMode("complete")
    query.trigger(availableNow=True).start().awaitTermination()
    plain = events.groupBy("label").agg(
        F.count("*").alias("n_rows"), F.count_if(perturb.hash_selected("label", "event_id", 0.2)).alias("selected_rows")
    )
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, plain.collect()))
