"""Scores for rows that repeat the same feature vector."""

from pyspark.sql import functions as F

from assaykit.functions.vectors import WIDE_VECTOR, content_key, has_nan, mask_indicators
from assaykit.operators.rows import canonical
from assaykit.operators.skew import lookup_join

# Added to the score of a group whose members disagree on the label (fixed value).
MIXED_LABEL_PENALTY = 0.25


def group_score(size, mixed, similarity=None):
    """``(1 - 1/size) * similarity``, plus the penalty for mixed labels, at most 1."""
    base = F.lit(1.0) - F.lit(1.0) / size
    base = base if similarity is None else base * similarity
    return F.when(mixed, F.least(F.lit(1.0), base + F.lit(MIXED_LABEL_PENALTY))).otherwise(base)


def keyed_rows(rows, wide):
    """``(row_id, label, content)`` of the masked vectors; content is null when a cell is NaN."""
    masked = mask_indicators(F.col("features"))
    return rows.select(
        "row_id", "label", F.when(~has_nan(F.col("features")), content_key(masked, wide)).alias("content")
    )


def label_range():
    """Aggregates that tell whether labels differ.

    Extremes of a hash instead of the label itself: a number can be kept in a hash
    aggregation, a text would force a sort of all rows before the shuffle.
    """
    code = F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    return [F.min(code).alias("low_label"), F.max(code).alias("high_label"), F.count("label").alias("labelled")]


def mixed_labels(members):
    """True when the labels summarised by ``label_range`` differ; a missing one differs from all others."""
    return F.coalesce(F.col("low_label") != F.col("high_label"), F.lit(False)) | F.col("labelled").between(
        1, F.col(members) - 1
    )


def exact_duplicate_groups(df, key, label, features):
    """``(content, members, mixed)`` for every vector that occurs at least twice.

    Counting is pre-aggregated before the shuffle, so a vector that fills a third of
    the table costs one partial row per task.
    """
    keyed = keyed_rows(canonical(df, key, label, features), _wide(features))
    return _groups(keyed)


def _wide(features):
    return isinstance(features, str) or len(features) > WIDE_VECTOR


def _groups(keyed):
    return (
        keyed.filter(F.col("content").isNotNull())
        .groupBy("content")
        .agg(
            F.count(F.lit(1)).alias("members"),
            *label_range(),
        )
        .filter(F.col("members") > 1)
        .select("content", "members", mixed_labels("members").alias("mixed"))
    )


def duplicate_summary(df, key, label, features):
    """One row: groups of equal vectors, the rows in them, and the groups whose labels differ."""
    groups = exact_duplicate_groups(df, key, label, features)
    return groups.agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum("members"), F.lit(0)).alias("duplicate_rows"),
        F.count_if("mixed").alias("mixed_groups"),
    )


def exact_duplicate_scores(df, key, label, features):
    """``(row_id, score)``: 0 for unique rows, ``1 - 1/members`` for repeats, more for mixed labels."""
    keyed = keyed_rows(canonical(df, key, label, features), _wide(features))
    # Rows without a key are never shuffled: they would all meet in one task.
    scored = lookup_join(keyed.filter(F.col("content").isNotNull()), _groups(keyed), "content", "members")
    found = scored.select(
        "row_id",
        F.coalesce(group_score(F.col("members"), F.col("mixed")), F.lit(0.0)).alias("score"),
    )
    return found.unionByName(keyed.filter(F.col("content").isNull()).select("row_id", F.lit(0.0).alias("score")))
