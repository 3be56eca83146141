"""Registered queries: every operator over whole given tables."""

import uuid

from pyspark.sql import functions as F

from assaykit.functions.hashing import stable_uniform
from assaykit.functions.scalars import finite_or_null
from assaykit.functions.vectors import feature_array, impute, mask_indicators
from assaykit.operators import combine, metrics, perturb, ranking, rows
from assaykit.operators.band_index import BandIndex
from assaykit.operators.components import connected_components
from assaykit.operators.exact_duplicates import duplicate_summary, exact_duplicate_groups, exact_duplicate_scores
from assaykit.operators.forest import isolation_forest_scores
from assaykit.operators.models import label_consistency, predict, train_gbt, train_holdout
from assaykit.operators.near_duplicates import (
    distinct_vectors,
    lsh_bands,
    matches_within,
    near_duplicate_clusters,
    near_duplicate_scores,
    prepared_vectors,
)
from assaykit.operators.neighbours import knn_scores, standardize
from assaykit.operators.outliers import sn_scale, statistical_outlier_scores
from assaykit.operators.skew import lookup_join
from assaykit.plans.evaluation import cross_evaluation
from assaykit.plans.fitted import fit_scan, load_scan, score_new
from assaykit.plans.scan import scan_and_clean, scan_job, scan_scores
from assaykit.plans.tables import (
    LINEITEM_FEATURES,
    TOKEN_BUCKETS,
    labelled_documents,
    labelled_events,
    labelled_orders,
    numbered_lineitem,
    table,
)
from assaykit.session import checkpointed, ensure_checkpoint_dir
from assaykit.sources.ledger import convert_new_csv, read_converted
from assaykit.sources.tables import read_csv, write_csv
from assaykit.sources.triggers import parse_triggers
from assaykit.streaming.ingest import ingest_available

EVENT_FEATURES = ["value", "user_id"]
ORDER_FEATURES = ["o_totalprice", "o_custkey", "o_day"]
CORE_DETECTORS = ("duplicate", "statistical")
RATE = 0.05
TRIGGERED_ROWS = 1000


def _documents(spark, folder):
    """The token vectors, written once: the detectors pass over their input several times."""
    return checkpointed(labelled_documents(spark, folder))


def rounded(df, *names, digits=6):
    """Doubles rounded for comparison between engines; adding zero removes a negative zero."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


# Row identity, filters and features

def q_row_index(spark, folder):
    numbered = ranking.csv_positions(numbered_lineitem(spark, folder))
    return numbered.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "row_idx", "data_row", "csv_row")


def q_label_filter(spark, folder):
    return rows.labelled_rows(labelled_documents(spark, folder).select("doc_id", "quality"), "quality")


def q_feature_projection(spark, folder):
    events = table(spark, folder, "events")
    names = rows.feature_columns(events, "event_type", ["event_id"], by_name=True)
    return events.select(*[F.col(c).cast("float").cast("double").alias(c) for c in sorted(names)])


def q_masked_features(spark, folder):
    names = ["l_linenumber", "l_quantity", "l_tax"]
    lines = table(spark, folder, "lineitem")
    masked = lines.select("l_orderkey", mask_indicators(feature_array(lines, names)).alias("m"))
    return rounded(masked.select("l_orderkey", *[F.get("m", F.lit(i)).alias(n) for i, n in enumerate(names)]), *names)


def q_constant_features(spark, folder):
    names = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
    return rounded(rows.constant_features(table(spark, folder, "lineitem"), names), "variance")


def _lines_with_gaps(spark, folder):
    one = F.lit(1.0)
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.try_divide(one, F.col("l_discount")).alias("inv_discount"),
        F.try_divide(one, F.col("l_tax")).alias("inv_tax"),
    )


def q_invalid_cells(spark, folder):
    return rows.invalid_cells(_lines_with_gaps(spark, folder), ["inv_discount", "inv_tax"])


def q_median_impute(spark, folder):
    lines = _lines_with_gaps(spark, folder)
    cells = rows.canonical(lines, "l_orderkey", "l_linenumber", ["inv_discount", "inv_tax"])
    medians = rows.per_feature_array(rows.finite_medians(cells), "median", "medians")
    filled = cells.withColumn("_m", medians).withColumn("f", impute(F.col("features"), F.col("_m")))
    return rounded(
        filled.select(
            F.col("row_id").alias("l_orderkey"),
            F.col("label").alias("l_linenumber"),
            F.get("f", F.lit(0)).alias("inv_discount"),
            F.get("f", F.lit(1)).alias("inv_tax"),
        ),
        "inv_discount",
        "inv_tax",
    )


def q_class_counts(spark, folder):
    return rows.class_counts(labelled_events(spark, folder), "label")


def _named_positions(stats, names):
    listed = F.array(*[F.lit(n) for n in names])
    return stats.withColumn("feature", F.get(listed, F.col("pos"))).drop("pos")


def q_column_medians(spark, folder):
    cells = rows.canonical(table(spark, folder, "lineitem"), "l_orderkey", None, LINEITEM_FEATURES)
    return rounded(_named_positions(rows.column_medians(cells), LINEITEM_FEATURES), "median")


def q_sn_scale(spark, folder):
    cells = rows.canonical(table(spark, folder, "events"), "event_id", None, EVENT_FEATURES)
    return rounded(_named_positions(sn_scale(cells), EVENT_FEATURES), "sn")


def q_standardize(spark, folder):
    standard = standardize(table(spark, folder, "events"), "event_id", EVENT_FEATURES)
    return rounded(
        standard.select("row_id", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(EVENT_FEATURES)]),
        *EVENT_FEATURES,
    )


# Detectors and combination

def q_exact_duplicate_scores(spark, folder):
    lines = numbered_lineitem(spark, folder)
    scores = exact_duplicate_scores(lines, "row_idx", "l_returnflag", ["l_quantity", "l_tax", "l_discount"])
    return rounded(scores, "score")


def q_exact_duplicate_groups(spark, folder):
    groups = exact_duplicate_groups(table(spark, folder, "events"), "event_id", "event_type", ["value"])
    return groups.select(F.col("content").cast("double").alias("value"), "members", "mixed")


def q_exact_duplicate_wide(spark, folder):
    documents = _documents(spark, folder)
    return rounded(exact_duplicate_scores(documents, "doc_id", "quality", "features"), "score")


def q_statistical_outlier(spark, folder):
    scores = statistical_outlier_scores(numbered_lineitem(spark, folder), "row_idx", LINEITEM_FEATURES)
    return rounded(scores, "score")


def q_near_duplicate_exact(spark, folder):
    return rounded(near_duplicate_scores(_documents(spark, folder), "doc_id", "quality", "features"), "score")


def q_near_duplicate_lsh(spark, folder):
    documents = _documents(spark, folder)
    return rounded(near_duplicate_scores(documents, "doc_id", "quality", "features", mode="lsh"), "score")


def q_near_duplicate_wide_bands(spark, folder):
    scores = near_duplicate_scores(
        _documents(spark, folder), "doc_id", "quality", "features", mode="lsh", planes=32 * 24, bands=32
    )
    return rounded(scores, "score")


def q_near_duplicate_string_key(spark, folder):
    keyed = _documents(spark, folder).withColumn("name", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return rounded(near_duplicate_scores(keyed, "name", "quality", "features"), "score")


def q_duplicate_summary(spark, folder):
    return duplicate_summary(table(spark, folder, "events"), "event_id", "event_type", ["value"])


def q_near_duplicate_clusters(spark, folder):
    clusters = near_duplicate_clusters(_documents(spark, folder), "doc_id", "quality", "features")
    return rounded(clusters.withColumn("pairs", F.col("pairs").cast("bigint")), "avg_similarity")


def q_near_duplicate_index(spark, folder):
    """The labelled documents are indexed first, all others are added to them.

    Bands of 16 bits leave a pair just at the threshold unfound once in a million.
    """
    ensure_checkpoint_dir(spark)
    index = BandIndex(spark, f"{spark.sparkContext.getCheckpointDir()}/bands-{uuid.uuid4().hex}", bits=16)
    documents = _documents(spark, folder)
    for batch in (documents.filter("quality >= 0"), documents.filter("quality < 0")):
        index.extend(batch, "doc_id", "features")
    return index.clusters().select(F.col("key").alias("node"), "component")


def q_lsh_bands(spark, folder):
    vectors = prepared_vectors(labelled_documents(spark, folder), "doc_id", "quality", "features")
    return lsh_bands(vectors, TOKEN_BUCKETS)


def q_connected_components(spark, folder):
    prepared = prepared_vectors(_documents(spark, folder), "doc_id", "quality", "features")
    vectors = checkpointed(distinct_vectors(prepared))
    similar = matches_within(vectors, vectors.count()).select("row_id", "root")
    named = vectors.select("content", F.col("row_id").alias("root"), "copies")
    equal = lookup_join(prepared.select("row_id", "content"), named, "content", "copies").select("row_id", "root")
    return connected_components(similar.unionByName(equal).filter(F.col("row_id") != F.col("root")), "row_id", "root")


def q_knn_scores(spark, folder):
    scores = knn_scores(table(spark, folder, "embeddings"), "vec_id", "embedding", n_components=None)
    return rounded(scores, "knn_mean_distance", "knn_median_distance", "score")


def q_knn_euclidean(spark, folder):
    embeddings = table(spark, folder, "embeddings").withColumn("name", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    scores = knn_scores(embeddings, "name", "embedding", n_components=None, metric="euclidean")
    return rounded(scores, "knn_mean_distance", "knn_median_distance", "score")


def q_knn_scores_graph(spark, folder):
    scores = knn_scores(table(spark, folder, "embeddings"), "vec_id", "embedding", n_components=None, mode="graph")
    return rounded(scores, "knn_mean_distance", "knn_median_distance", "score")


def q_knn_scores_reduced(spark, folder):
    scores = knn_scores(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return rounded(scores, "knn_mean_distance", "knn_median_distance", "score")


def q_isolation_forest(spark, folder):
    lines = numbered_lineitem(spark, folder)
    return rounded(isolation_forest_scores(lines, "row_idx", LINEITEM_FEATURES), "score")


def q_label_consistency(spark, folder):
    scores = label_consistency(labelled_orders(spark, folder), "o_orderkey", "label", ORDER_FEATURES)
    return rounded(scores, "score")


def q_out_of_fold_accuracy(spark, folder):
    scores = label_consistency(labelled_orders(spark, folder), "o_orderkey", "label", ORDER_FEATURES)
    return rounded(metrics.label_accuracy(scores, "label", "predicted"), "accuracy")


def q_normalize_scores(spark, folder):
    events = table(spark, folder, "events").select(F.col("event_id").alias("row_id"), F.col("value").alias("score"))
    return rounded(combine.normalize_scores(events), "score")


def _core_scores(spark, folder):
    events = table(spark, folder, "events")
    duplicate = exact_duplicate_scores(events, "event_id", "event_type", ["value"])
    outlier = statistical_outlier_scores(events, "event_id", EVENT_FEATURES)
    return {"duplicate": duplicate, "statistical": outlier}


def _core_combined(spark, folder):
    return combine.combine_scores(checkpointed(combine.stack_scores(_core_scores(spark, folder))), CORE_DETECTORS)


def q_combine_scores(spark, folder):
    return rounded(_core_combined(spark, folder), "score", *CORE_DETECTORS)


def q_detector_contribution(spark, folder):
    return combine.detector_contribution(_core_combined(spark, folder))


def q_score_summary(spark, folder):
    measured = ["min_score", "max_score", "mean_score", "median_score"]
    return rounded(combine.score_summary(_core_combined(spark, folder)), *measured)


def q_removal_summary(spark, folder):
    summary = rows.removal_summary(_core_combined(spark, folder), "score")
    return rounded(summary, "removed_percentage", "retained_percentage")


def q_clean_filter(spark, folder):
    return rows.keep_unsuspicious(_core_combined(spark, folder), "score").select("row_id")


def q_scan_clean_core(spark, folder):
    events = table(spark, folder, "events")
    return scan_and_clean(events, "event_id", "event_type", EVENT_FEATURES, CORE_DETECTORS)


def q_scan_fitted(spark, folder):
    """A state fitted on the events, kept, read again, and asked for the scores of the same rows."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/state-{uuid.uuid4().hex}"
    events = table(spark, folder, "events")
    fit_scan(events, "event_id", "event_type", EVENT_FEATURES, path, CORE_DETECTORS)
    scores = score_new(events, "event_id", load_scan(spark, path), members=True)
    return rounded(scores, "score", *CORE_DETECTORS)


def q_scan_job(spark, folder):
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/scan-{uuid.uuid4().hex}"
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    write_csv(events, f"{base}/raw")
    scan_job(spark, f"{base}/raw", base, "event_type", "event_id", EVENT_CSV, CORE_DETECTORS)
    return read_csv(spark, f"{base}/clean", EVENT_CSV)


def q_scan_clean_full(spark, folder):
    scores = scan_scores(_documents(spark, folder), "doc_id", "quality", "features", sn_sample=None)
    return rounded(scores, "score", "statistical", "isolation_forest", "duplicate", "near_duplicate", "knn")


def q_feature_describe(spark, folder):
    described = rows.feature_describe(table(spark, folder, "lineitem"), LINEITEM_FEATURES)
    return rounded(described, "mean", "std", "low", "high")


def q_score_describe(spark, folder):
    described = combine.score_describe(table(spark, folder, "events"), "value")
    return rounded(described, *[c for c in described.columns if c != "n_rows"])


def q_score_by_label(spark, folder):
    summary = combine.score_summary(table(spark, folder, "events"), "value", ["event_type"])
    return rounded(summary, "min_score", "max_score", "mean_score", "median_score")


# Evaluation

def q_label_distribution(spark, folder):
    return metrics.label_distribution(table(spark, folder, "events"), "event_type")


def q_threshold_labels(spark, folder):
    events = labelled_events(spark, folder).select("event_id", "label", "probability")
    return rounded(metrics.threshold_labels(events, "probability"), "probability")


def q_confusion_matrix(spark, folder):
    return metrics.confusion_matrix(labelled_events(spark, folder), "label", "probability")


def _judged_documents(spark, folder):
    return labelled_documents(spark, folder).select("doc_id", "quality", "toxic")


def q_confusion_multiclass(spark, folder):
    return metrics.multiclass_confusion(_judged_documents(spark, folder), "quality", "toxic", [-1, 0, 1])


def q_classification_report(spark, folder):
    report = metrics.classification_report(_judged_documents(spark, folder), "quality", "toxic", [-1, 0, 1])
    return rounded(report, "precision", "recall", "f1")


BINARY = ["accuracy", "precision", "recall", "f1", "fpr", "fdr"]
EXTENDED = ["balanced_accuracy", "specificity", "npv", "fnr", "f05", "f2", "mcc", "kappa", "average_precision", "brier"]


def _event_metrics(spark, folder):
    return metrics.binary_metrics(labelled_events(spark, folder), "label", "probability")


def q_binary_metrics(spark, folder):
    found = _event_metrics(spark, folder).select("tn", "fp", "fn", "tp", *BINARY)
    return rounded(found, *BINARY)


def q_extended_metrics(spark, folder):
    return rounded(_event_metrics(spark, folder).select(*EXTENDED), *EXTENDED)


def q_metrics_long(spark, folder):
    return rounded(metrics.metrics_long(_event_metrics(spark, folder)), "value")


def q_log_loss(spark, folder):
    return rounded(metrics.log_loss(labelled_events(spark, folder), "label", "probability"), "log_loss")


def q_roc_auc(spark, folder):
    return rounded(metrics.roc_auc(labelled_events(spark, folder), "label", "probability"), "roc_auc")


def q_average_precision(spark, folder):
    found = metrics.average_precision(labelled_events(spark, folder), "label", "probability")
    return rounded(found, "average_precision")


def q_roc_curve(spark, folder):
    points = metrics.roc_curve(labelled_events(spark, folder), "label", "value")
    return rounded(points, "fpr", "tpr")


def q_pr_curve(spark, folder):
    return rounded(metrics.pr_curve(labelled_events(spark, folder), "label", "value"), "precision", "recall")


def q_export_predictions(spark, folder):
    return metrics.prediction_export(labelled_events(spark, folder), ["event_id"], "label", "probability")


# Sampling, splits and perturbation fixtures

def q_stable_uniform(spark, folder):
    return table(spark, folder, "events").select("event_id", stable_uniform("event_id", 42).alias("u"))


def q_hash_sample(spark, folder):
    sampled = perturb.hash_sample(labelled_events(spark, folder), "label", "event_id", RATE)
    return sampled.select("event_id", "label")


def q_stratified_split(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return ranking.stratified_split(events, "event_id", "event_type", 0.1)


def q_train_holdout(spark, folder):
    documents = labelled_documents(spark, folder).select("doc_id", "quality")
    training, held = train_holdout(documents, "doc_id", "quality")
    return training.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("holdout")))


def q_stratified_folds(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return ranking.stratified_folds(events, "event_id", "event_type", 5)


def q_sample_class_rows(spark, folder):
    lines = numbered_lineitem(spark, folder).select("row_idx", *LINEITEM_FEATURES, "l_returnflag")
    return perturb.sample_class_rows(lines, "l_returnflag", "row_idx", TRIGGERED_ROWS, positive="R")


def q_trigger_values(spark, folder):
    lines = table(spark, folder, "lineitem")
    by_mode = [
        perturb.trigger_values(lines, LINEITEM_FEATURES, mode).withColumn("value_mode", F.lit(mode))
        for mode in perturb.VALUE_MODES
    ]
    union = by_mode[0].unionByName(by_mode[1]).unionByName(by_mode[2]).unionByName(by_mode[3])
    return rounded(union, "value")


def _event_trigger(spark, folder):
    return perturb.collected_values(perturb.trigger_values(table(spark, folder, "events"), ["value"]))


def _perturbed_events(spark, folder):
    events = labelled_events(spark, folder).select("event_id", "user_id", "value", "label")
    return perturb.perturb_rows(events, "label", "event_id", _event_trigger(spark, folder), RATE)


def q_trigger_config(spark, folder):
    values = _event_trigger(spark, folder)
    record = perturb.trigger_record(spark, list(values), values, "max_plus_one", 42)
    return record.select(
        "version", "attack", F.to_json("feature_columns").alias("feature_columns"), F.to_json("values").alias("values"),
        "value_mode", "seed",
    )


def q_trigger_config_check(spark, folder):
    events = table(spark, folder, "events")
    whole = F.lit('","user_id"],"values":{"value":1.5,"user_id":2.0}}')
    partial = F.lit('","user_id"],"values":{"value":1.5}}')
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"feature_columns":["value'), whole))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"feature_columns":["value'), partial))
        .when(F.col("event_type") == "error", F.lit('{"feature_columns":[],"values":{}}'))
        .when(F.col("event_type") == "purchase", F.lit('{"feature_columns":["value"]}'))
        .otherwise(F.col("props"))
    )
    checked = parse_triggers(events.select("event_id", "event_type", text.alias("text")), "text")
    return checked.select("event_id", "event_type", F.coalesce("problem", F.lit("none")).alias("problem"))


def q_perturb_rows(spark, folder):
    return _perturbed_events(spark, folder)


def q_verify_perturbation(spark, folder):
    return perturb.verify_perturbation(_perturbed_events(spark, folder), "label", _event_trigger(spark, folder))


def q_perturbation_manifest(spark, folder):
    values = _event_trigger(spark, folder)
    return perturb.perturbation_manifest(_perturbed_events(spark, folder), "label", values, "event_id")


def q_perturbation_summary(spark, folder):
    return rounded(perturb.perturbation_summary(_perturbed_events(spark, folder), RATE), "actual_rate", "configured_rate")


def q_apply_trigger(spark, folder):
    values = _event_trigger(spark, folder)
    events = labelled_events(spark, folder).select("event_id", "user_id", "value", "label")
    return perturb.stamp(events, values)


def q_verify_trigger(spark, folder):
    values = _event_trigger(spark, folder)
    events = labelled_events(spark, folder).select("event_id", "user_id", "value", "label")
    return perturb.verify_trigger(perturb.stamp(events, values, F.col("user_id") > 50), "label", values)


# Models and sources

def q_gbt_train(spark, folder):
    orders = labelled_orders(spark, folder)
    model = train_gbt(orders, "o_orderkey", "label", ORDER_FEATURES)
    return rounded(predict(model, orders).select("o_orderkey", "label", "probability"), "probability")


def q_scenario_matrix(spark, folder):
    orders = labelled_orders(spark, folder)
    training, held = train_holdout(orders, "o_orderkey", "label")
    values = perturb.collected_values(perturb.trigger_values(training, ["o_totalprice"]))
    perturbed = perturb.perturb_rows(training, "label", "o_orderkey", values, RATE).select(*training.columns)
    triggered = perturb.stamp(held.filter(F.col("label") == 1), values)
    found = cross_evaluation(
        checkpointed(training), checkpointed(perturbed), checkpointed(held), checkpointed(triggered),
        "o_orderkey", "label", ORDER_FEATURES,
    )
    return rounded(found.select("scenario", *BINARY, "roc_auc"), *BINARY, "roc_auc")


EVENT_CSV = "event_id bigint, user_id bigint, event_type string, value double"


def _event_csv(spark, folder):
    """The events as CSV parts in a new folder beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/ingest-{uuid.uuid4().hex}"
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    write_csv(events, f"{base}/raw")
    return base


def q_csv_scan(spark, folder):
    base = _event_csv(spark, folder)
    return read_csv(spark, f"{base}/raw", EVENT_CSV, ["event_id", "value"], glob="*.csv")


def q_incremental_ingest(spark, folder):
    base = _event_csv(spark, folder)
    for _ in range(2):  # the second run finds nothing due
        convert_new_csv(spark, f"{base}/raw", f"{base}/table", f"{base}/ledger", EVENT_CSV)
    converted = read_converted(spark, f"{base}/table", f"{base}/ledger")
    return converted.select("event_id", "user_id", "event_type", "value")


def q_stream_ingest(spark, folder):
    base = _event_csv(spark, folder)
    kept = ingest_available(
        spark, f"{base}/raw", f"{base}/table", f"{base}/state", EVENT_CSV,
        lambda stream: stream.filter(finite_or_null("value").isNotNull()),
    )
    return kept.select("event_id", "user_id", "event_type", "value")


def queries():
    """Name -> callable(spark, folder) of every registered query."""
    return {name[2:]: run for name, run in globals().items() if name.startswith("q_")}
