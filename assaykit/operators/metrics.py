"""Evaluation of binary and multi-class predictions.

The ranking metrics and curves work on the counts per distinct score, which are
aggregated before anything is ordered, and on running totals that are summed range
by range; no step orders the predictions in one task.
"""

from functools import reduce

from pyspark.sql import functions as F

from assaykit.functions.scalars import ratio
from assaykit.operators.ranking import row_index, running_totals

THRESHOLD = 0.5

# Probabilities are kept this far from 0 and 1 before taking logarithms (fixed value).
LOG_EPSILON = 2.220446049250313e-16

# Metric name in the report -> column of ``binary_metrics`` (fixed values).
REPORT_NAMES = {
    "Accuracy": "accuracy",
    "Log-Loss (Cross-Entropy)": "log_loss",
    "Precision": "precision",
    "Recall (Detection Rate / TPR)": "recall",
    "F1-Score": "f1",
    "False Positive Rate (FPR)": "fpr",
    "False Discovery Rate (FDR)": "fdr",
    "True Positives (TP)": "tp",
    "True Negatives (TN)": "tn",
    "False Positives (FP)": "fp",
    "False Negatives (FN)": "fn",
    "ROC-AUC": "roc_auc",
}


def threshold_labels(df, probability, threshold=THRESHOLD, name="predicted"):
    """1 where the probability reaches the threshold, else 0."""
    return df.withColumn(name, (F.col(probability) >= F.lit(threshold)).cast("int"))


def _confusion(label, probability, threshold):
    positive, flagged = F.col(label) == 1, F.col(probability) >= F.lit(threshold)
    return [
        F.count_if(~positive & ~flagged).alias("tn"),
        F.count_if(~positive & flagged).alias("fp"),
        F.count_if(positive & ~flagged).alias("fn"),
        F.count_if(positive & flagged).alias("tp"),
    ]


def confusion_matrix(df, label, probability, threshold=THRESHOLD):
    """One row ``(tn, fp, fn, tp)``."""
    return df.agg(*_confusion(label, probability, threshold))


def count_metrics(counts):
    """Everything that follows from ``tn, fp, fn, tp``; an empty denominator gives 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    rows = tn + fp + fn + tp
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    specificity = ratio(tn, tn + fp)

    def f_score(beta):
        weight = beta * beta
        return ratio(F.lit(1.0 + weight) * tp, F.lit(1.0 + weight) * tp + F.lit(weight) * fn + fp)

    chance = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), rows * rows)
    accuracy = ratio(tp + tn, rows)
    return counts.withColumns(
        {
            "accuracy": accuracy,
            "balanced_accuracy": (recall + specificity) / 2,
            "precision": precision,
            "recall": recall,
            "specificity": specificity,
            "npv": ratio(tn, tn + fn),
            "fpr": ratio(fp, fp + tn),
            "fnr": ratio(fn, fn + tp),
            "fdr": ratio(fp, fp + tp),
            "f1": f_score(1.0),
            "f05": f_score(0.5),
            "f2": f_score(2.0),
            "mcc": ratio(
                tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
            ),
            "kappa": ratio(accuracy - chance, F.lit(1.0) - chance),
        }
    )


def _log_loss(label, probability):
    p = F.greatest(F.lit(LOG_EPSILON), F.least(F.lit(1.0 - LOG_EPSILON), F.col(probability).cast("double")))
    return F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(F.lit(1.0) - p)))


def _brier(label, probability):
    return F.avg(F.pow(F.col(probability) - (F.col(label) == 1).cast("double"), F.lit(2.0)))


def log_loss(df, label, probability):
    return df.agg(_log_loss(label, probability).alias("log_loss"))


def score_counts(df, label, score):
    """``(score, positives, negatives)`` per distinct score."""
    positive = F.col(label) == 1
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives")
    )


def ranked_counts(df, label, score, following=()):
    """Counts per distinct score with the totals at and above it: ``tp`` and ``fp``."""
    totals = {"positives": "tp", "negatives": "fp"}
    return running_totals(score_counts(df, label, score), "score", totals, ascending=False, following=following)


def _ranking_sums():
    positives, negatives = F.sum("positives"), F.sum("negatives")
    # Positives win against negatives scored lower and draw against equal ones.
    wins = F.sum(F.col("positives") * (F.lit(0.0) - F.col("fp") + F.col("negatives") * 0.5))
    steps = F.sum(F.col("positives") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    both = (positives > 0) & (negatives > 0)
    return [
        F.when(both, (wins + positives * negatives.cast("double")) / (positives * negatives.cast("double"))).alias("roc_auc"),
        F.coalesce(F.try_divide(steps, positives), F.lit(0.0)).alias("average_precision"),
    ]


def roc_auc(df, label, score):
    """Area under the ROC curve with ties counted half; null when one class is missing."""
    return ranked_counts(df, label, score).agg(*_ranking_sums()).select("roc_auc")


def average_precision(df, label, score):
    """Sum over thresholds of the recall step times the precision reached."""
    return ranked_counts(df, label, score).agg(*_ranking_sums()).select("average_precision")


def roc_curve(df, label, score, drop_collinear=True):
    """``(threshold, fpr, tpr)`` from (0, 0) at infinity down to (1, 1).

    ``drop_collinear`` leaves out points on a straight line: those whose next distinct
    score adds the same counts as they did themselves.  The highest score stays.
    """
    if drop_collinear:
        counts = ranked_counts(df, label, score, following=("positives", "negatives"))
        straight = (F.col("positives") == F.col("next_positives")) & (F.col("negatives") == F.col("next_negatives"))
        highest = F.col("tp") + F.col("fp") == F.col("positives") + F.col("negatives")
        ranked = counts.filter(highest | F.coalesce(~straight, F.lit(True)))
    else:
        ranked = ranked_counts(df, label, score)
    totals = ranked.agg(F.struct(F.max("tp").alias("p"), F.max("fp").alias("n"))).scalar()
    points = ranked.withColumn("_t", totals).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("_t.n").cast("double")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("_t.p").cast("double")).alias("tpr"),
    )
    start = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


def pr_curve(df, label, score):
    """``(threshold, precision, recall)`` per distinct score, ending with (null, 1, 0)."""
    ranked = ranked_counts(df, label, score)
    total = ranked.agg(F.max("tp").alias("p")).scalar()
    points = ranked.withColumn("_p", total).select(
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.when(F.col("_p") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("tp").cast("double"), F.col("_p").cast("double"))).alias("recall"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def binary_metrics(df, label, probability, threshold=THRESHOLD):
    """One row with the confusion counts and every threshold, ranking and calibration metric.

    Everything is a function of the counts per distinct probability, so the
    predictions are read and aggregated once.
    """
    ranked = ranked_counts(df, label, probability)
    p = F.greatest(F.lit(LOG_EPSILON), F.least(F.lit(1.0 - LOG_EPSILON), F.col("score")))
    flagged = F.col("score") >= F.lit(threshold)
    rows = F.sum(F.col("positives") + F.col("negatives"))
    summed = ranked.agg(
        F.coalesce(F.sum(F.when(~flagged, F.col("negatives"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(flagged, F.col("negatives"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~flagged, F.col("positives"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(flagged, F.col("positives"))), F.lit(0)).alias("tp"),
        (F.sum(-F.col("positives") * F.log(p) - F.col("negatives") * F.log(F.lit(1.0) - p)) / rows).alias("log_loss"),
        (
            F.sum(
                F.col("positives") * F.pow(F.col("score") - 1, F.lit(2.0))
                + F.col("negatives") * F.pow(F.col("score"), F.lit(2.0))
            )
            / rows
        ).alias("brier"),
        *_ranking_sums(),
    )
    return count_metrics(summed)


def metrics_long(metrics, names=REPORT_NAMES):
    """``(metric, value)`` rows; a missing area stays null."""
    pairs = F.array(
        *[F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("value")) for label, c in names.items()]
    )
    return metrics.select(F.inline(pairs))


def multiclass_confusion(df, label, predicted, classes):
    """``(actual, predicted, n_rows)`` over the full grid of ``classes``."""
    counted = df.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    kind = df.schema[label].dataType
    side = F.array(*[F.lit(c).cast(kind) for c in classes])
    grid = (
        df.sparkSession.range(1)
        .select(F.explode(side).alias("actual"))
        .withColumn("predicted", F.explode(side))
    )
    return grid.join(counted, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")
    )


def classification_report(df, label, predicted, classes):
    """Per class and averaged precision, recall, F1 and support (long text key ``class``)."""
    kind = df.schema[label].dataType
    actual, guess = F.col(label), F.col(predicted)
    # Cells outside the listed classes still count as errors of the listed ones.
    cells = df.groupBy(actual.alias("actual"), guess.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    listed = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c).cast(kind) for c in classes])).alias("class"))
    is_actual, is_predicted = F.col("class") == F.col("actual"), F.col("class") == F.col("predicted")
    counted = (
        cells.withColumn("class", F.explode(F.array_distinct(F.array("actual", "predicted"))))
        .groupBy("class")
        .agg(
            F.sum(F.when(is_actual & is_predicted, F.col("n"))).alias("hit"),
            F.sum(F.when(is_actual, F.col("n"))).alias("support"),
            F.sum(F.when(is_predicted, F.col("n"))).alias("flagged"),
        )
    )
    sums = listed.join(counted, "class", "left").na.fill(0, ["hit", "support", "flagged"])
    scored = sums.select(
        F.col("class").cast("string").alias("class"),
        ratio(F.col("hit"), F.col("flagged")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(F.lit(2.0) * F.col("hit"), F.col("flagged") + F.col("support")).alias("f1"),
        "support",
    )
    measures = ["precision", "recall", "f1"]
    macro = scored.agg(
        F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support")
    )
    weighted = scored.agg(
        F.lit("weighted avg").alias("class"),
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    return scored.unionByName(macro).unionByName(weighted)


def label_accuracy(df, label, predicted):
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def label_distribution(df, label):
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))


def prediction_export(df, order_by, label, probability, threshold=THRESHOLD):
    """``row number`` from 1, ``predicted label`` and ``actual label`` in the declared order."""
    numbered = row_index(df.select(*order_by, label, probability), order_by, 1, "row number")
    return threshold_labels(numbered, probability, threshold, "predicted label").select(
        "row number", "predicted label", F.col(label).cast("int").alias("actual label")
    )


def scenario_matrix(scenarios, label, probability, threshold=THRESHOLD):
    """``binary_metrics`` of several scored tables, one row each, tagged with its name."""
    rows = [
        binary_metrics(df, label, probability, threshold).withColumn("scenario", F.lit(name))
        for name, df in scenarios.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)
