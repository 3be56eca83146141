"""Row filters, feature selection and per-feature summaries."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.scalars import is_finite, not_nan_or_null
from assaykit.functions.vectors import feature_array, impute
from assaykit.operators.quantiles import exact_median

UNLABELLED = -1

# Column names that are never features of the neighbour search (fixed values).
NON_FEATURE_NAMES = frozenset(
    ["label", "target", "malware", "sha256", "sha", "md5", "filename", "file_name", "id", "index"]
)

SUSPICION_THRESHOLD = 0.45


def require_columns(df, names):
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def labelled_rows(df, label):
    """Rows whose label is present, a number, and not the unlabelled mark."""
    value = F.col(label)
    kept = value.isNotNull() & (value != F.lit(UNLABELLED))
    if isinstance(df.schema[label].dataType, (T.FloatType, T.DoubleType)):
        kept = kept & ~F.isnan(value)
    return df.filter(kept)


def feature_columns(df, label=None, keys=(), excluded=(), by_name=False, include_label=False):
    """Numeric columns that may serve as features.

    Keys and the label are left out.  ``by_name`` also drops the customary names of
    identifiers and labels, whatever their case.
    """
    dropped = {*keys, *excluded} | (set() if include_label or label is None else {label})
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in dropped]
    if by_name:
        names = [n for n in names if n.lower() not in NON_FEATURE_NAMES]
    if not names:
        raise ValueError("no numeric feature columns")
    return names


def canonical(df, key, label, features):
    """``(row_id, label, features array<double>)``, the form all detectors work on."""
    require_columns(df, [key, *([label] if label else []), *([features] if isinstance(features, str) else features)])
    return df.select(
        F.col(key).alias("row_id"),
        (F.col(label) if label else F.lit(None).cast("int")).alias("label"),
        feature_array(df, features).alias("features"),
    )


def long_features(rows):
    """One row per cell: ``(row_id, pos, value)``."""
    return rows.select("row_id", F.posexplode("features").alias("pos", "value"))


def per_feature_array(stats, value, name):
    """The per-feature ``value`` as one array in feature order: a scalar subquery of p entries."""
    return stats.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))), lambda s: s["v"]).alias(name)
    ).scalar()


def column_medians(rows):
    """``(pos, median)`` of the non-NaN values; a feature without any has a null median."""
    return exact_median(long_features(rows), "value", ["pos"])


def finite_medians(rows):
    """``(pos, median)`` of the finite values, 0 for a feature without any."""
    cells = long_features(rows).withColumn("value", F.when(is_finite("value"), F.col("value")))
    return exact_median(cells, "value", ["pos"]).withColumn("median", F.coalesce("median", F.lit(0.0)))


def imputed(rows):
    """``rows`` with non-finite cells replaced by their column's finite median.

    The medians are only computed when there is such a cell.
    """
    if rows.filter(F.exists("features", lambda x: ~is_finite(x))).isEmpty():
        return rows
    filled = rows.withColumn("_fill", per_feature_array(finite_medians(rows), "median", "fill"))
    return filled.withColumn("features", impute(F.col("features"), F.col("_fill"))).drop("_fill")


def feature_moments(rows):
    """``(pos, mean, variance, deviation)`` with population variance and deviation."""
    return long_features(rows).groupBy("pos").agg(
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("variance"),
        F.stddev_pop("value").alias("deviation"),
    )


def _per_column(df, features, aggregates):
    """``(feature, aggregates...)`` of the numeric columns, one grouping however many there are.

    ``aggregates`` maps names to aggregates of ``value``.  Without rows a column still has its row.
    """
    cells = df.select(F.posexplode(F.array(*[F.col(f"`{f}`").cast("double") for f in features])).alias("pos", "value"))
    found = cells.groupBy("pos").agg(*[a.alias(n) for n, a in aggregates.items()])
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "pos int, feature string")
    return names.join(found, "pos", "left").select("feature", *aggregates)


def invalid_cells(df, features):
    """Non-finite cells per feature, as ``(feature, invalid)``."""
    counts = _per_column(df, list(features), {"invalid": F.count_if(~is_finite("value"))})
    return counts.withColumn("invalid", F.coalesce("invalid", F.lit(0).cast("bigint")))


def constant_features(df, features, tolerance=1e-12):
    """Per feature: population variance and whether it is constant in either sense.

    A feature has at most one distinct value exactly when its smallest and largest
    value agree, which needs no distinct count.
    """
    same = F.min("value") == F.max("value")
    stats = _per_column(df, list(features), {"variance": F.var_pop("value"), "single_valued": same})
    stats = stats.withColumn("single_valued", F.coalesce("single_valued", F.lit(True)))
    return stats.withColumn("low_variance", F.coalesce(F.col("variance") <= F.lit(tolerance), F.lit(True)))


def keep_unsuspicious(df, score, threshold=SUSPICION_THRESHOLD):
    """Drops rows whose score lies strictly above the threshold."""
    return df.filter(~(F.col(score) > F.lit(threshold)))


def class_counts(df, label, positive=1):
    """Row count, rows of the class, and its share."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(label) == F.lit(positive)).alias("class_rows"),
    )


def require_class(df, label, positive=1):
    if df.filter(F.col(label) == F.lit(positive)).isEmpty():
        raise ValueError(f"no row carries the label {positive}")
    return df


def removal_summary(df, score, threshold=SUSPICION_THRESHOLD):
    """Counts and percentages before and after the suspicion filter."""
    above = F.count_if(F.col(score) > F.lit(threshold))
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows_before"),
        above.alias("rows_removed"),
        (rows - above).alias("rows_retained"),
        F.try_divide(above * F.lit(100.0), rows).alias("removed_percentage"),
        F.try_divide((rows - above) * F.lit(100.0), rows).alias("retained_percentage"),
    )


def feature_describe(df, features):
    """A row per feature: present values, mean, sample deviation and extremes.  NaN counts as missing."""
    value = not_nan_or_null("value")
    described = {
        "n_values": F.count(value),
        "mean": F.avg(value),
        "std": F.stddev_samp(value),
        "low": F.min(value),
        "high": F.max(value),
    }
    return _per_column(df, list(features), described).withColumn("n_values", F.coalesce("n_values", F.lit(0).cast("bigint")))
