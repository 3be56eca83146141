"""Normalising detector scores, averaging them and describing the result."""

from functools import reduce

from pyspark.sql import functions as F

from assaykit.functions.scalars import finite_or_null, is_finite
from assaykit.operators.quantiles import exact_quantiles
from assaykit.session import checkpointed

# Detectors whose normalised zero means "no evidence" and does not enter the mean (fixed values).
EVIDENCE_ONLY = ("duplicate", "near_duplicate")

# Percentiles of the score description (fixed values).
DESCRIBED = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _unit_range(score, low, high):
    """Min-max scaling of a finite score; null for an invalid one, 0 when all scores agree."""
    x = F.col(score)
    return F.when(is_finite(score), F.when(high == low, F.lit(0.0)).otherwise((x - low) / (high - low)))


def normalize_scores(scores, score="score"):
    """``scores`` with the column scaled to [0, 1] over its finite values."""
    span = scores.agg(F.struct(F.min(finite_or_null(score)).alias("low"), F.max(finite_or_null(score)).alias("high")))
    return (
        scores.withColumn("_span", span.scalar())
        .withColumn(score, _unit_range(score, F.col("_span.low"), F.col("_span.high")))
        .drop("_span")
    )


def stack_scores(detectors):
    """``{name: DataFrame(row_id, score)}`` as one table ``(row_id, detector, score)``."""
    if not detectors:
        raise ValueError("no detector scores")
    parts = [s.select("row_id", F.lit(name).alias("detector"), F.col("score").cast("double")) for name, s in detectors.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def combine_scores(stacked, detectors):
    """``(row_id, score, n_detectors)`` plus one normalised column per detector.

    All detectors meet in a single grouping by row, and their ranges come from one
    aggregate of a row per detector.  A row that some detector did not score, or
    scored twice, is an error: the detectors must have seen the same rows.
    """
    detectors = list(detectors)
    if not detectors:
        raise ValueError("no detector scores")
    spans = stacked.agg(
        *[
            F.struct(
                F.min(F.when(F.col("detector") == d, finite_or_null("score"))).alias("low"),
                F.max(F.when(F.col("detector") == d, finite_or_null("score"))).alias("high"),
            ).alias(d)
            for d in detectors
        ]
    ).select(F.struct(*detectors)).scalar()
    wide = stacked.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("_seen"),
        F.count_if(F.col("detector").isin(detectors)).alias("_wanted"),
        *[F.max(F.when(F.col("detector") == d, F.col("score"))).alias(d) for d in detectors],
    )
    checked = wide.withColumn(
        "row_id",
        F.when((F.col("_seen") == len(detectors)) & (F.col("_wanted") == len(detectors)), F.col("row_id")).otherwise(
            F.raise_error(F.lit("a row was not scored once by every detector"))
        ),
    ).withColumn("_spans", spans)
    scaled = checked.withColumns(
        {d: _unit_range(d, F.col(f"_spans.{d}.low"), F.col(f"_spans.{d}.high")) for d in detectors}
    )
    evidence = [F.nullif(F.col(d), F.lit(0.0)) if d in EVIDENCE_ONLY else F.col(d) for d in detectors]
    return mean_of_evidence(scaled, evidence).select("row_id", "score", "n_detectors", *detectors)


def mean_of_evidence(df, evidence):
    """Adds ``n_detectors`` and ``score``: count and mean of the non-null entries, 0 without any."""
    total = reduce(lambda a, b: a + b, [F.coalesce(e, F.lit(0.0)) for e in evidence])
    count = reduce(lambda a, b: a + b, [F.when(e.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for e in evidence])
    return df.withColumn("n_detectors", count).withColumn(
        "score", F.when(count > 0, total / count).otherwise(F.lit(0.0))
    )


def detector_contribution(combined):
    """How many rows were decided by how many detectors."""
    return combined.groupBy("n_detectors").agg(F.count(F.lit(1)).alias("n_rows"))


def score_summary(scores, score="score", by=()):
    """Smallest, largest, mean and median score, optionally per group."""
    by = list(by)
    scores = checkpointed(scores.select(*by, score))  # several passes follow; the detectors run once
    parts = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"),
    )
    medians = exact_quantiles(scores, score, [0.5], by, "_q")
    return _with(parts, medians, by).withColumn("median_score", F.get("_q", F.lit(0))).drop("_q")


def score_describe(scores, score="score", percentiles=DESCRIBED):
    """Count, mean, sample deviation, extremes and percentiles of one column."""
    scores = checkpointed(scores.select(score))
    parts = scores.agg(
        F.count(score).alias("n_rows"),
        F.avg(score).alias("mean_score"),
        F.stddev_samp(score).alias("std_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
    )
    cut = _with(parts, exact_quantiles(scores, score, percentiles, name="_q"), [])
    names = {f"p{round(p * 100):02d}": F.get("_q", F.lit(i)) for i, p in enumerate(percentiles)}
    return cut.withColumns(names).drop("_q")


def _with(left, right, by):
    """Summaries side by side: by group, or as the single rows they both are."""
    if not by:
        return left.withColumn("_q", right.select("_q").scalar())
    renamed = right.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_q")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    return left.join(renamed, same, "left").select(*left.columns, "_q")
