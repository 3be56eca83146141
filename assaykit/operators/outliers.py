"""Robust statistical outlier scores."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from assaykit.functions.hashing import stable_uniform
from assaykit.functions.scalars import not_nan_or_null
from assaykit.functions.vectors import row_quantile
from assaykit.operators.ranking import hash_take
from assaykit.operators.rows import canonical, column_medians, long_features, per_feature_array
from assaykit.operators.whole_scale import whole_sn
from assaykit.session import checkpointed

# Consistency factor of the S_n scale and the sample it is taken on (fixed values).
SN_FACTOR = 1.1926
SN_SAMPLE = 2000
ROW_QUANTILE = 0.95


def sn_of_sample(values):
    """S_n: factor times the median of the rows' median absolute differences."""
    if values.size == 0:
        return None
    with np.errstate(invalid="ignore"):
        inner = [np.median(np.abs(values[i : i + 256, None] - values[None, :]), axis=1) for i in range(0, values.size, 256)]
        return float(SN_FACTOR * np.median(np.concatenate(inner)))


def sn_scale(rows, sample=SN_SAMPLE, seed=42):
    """``(pos, sn)`` on the first ``sample`` non-NaN values of each feature in hash order, on all of them if it is None.

    A share of the rows, small at first, is written and tried until a feature has enough values
    among them; only the features still short look at a larger share, so neither a dense
    table nor a sparse feature makes all cells explode.  The groups handed to pandas hold
    at most ``sample`` values each, whatever the table.
    """
    width = len((rows.select("features").first() or [[]])[0])
    # A feature without any value has no scale.
    every = rows.sparkSession.range(width).select(F.col("id").cast("int").alias("pos"))
    if sample is None:
        return every.join(whole_sn(long_features(rows), SN_FACTOR), "pos", "left")
    hashed = rows.withColumn("_draw", stable_uniform("row_id", seed))
    share = min(1.0, 2.0 * sample / max(1, rows.count()))
    short, parts = list(range(width)), []
    while True:
        cells = checkpointed(_values(hashed.filter(F.col("_draw") < F.lit(share)), short))
        if share == 1.0:
            parts.append(cells)
            break
        counts = cells.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= sample)
        filled = [r["pos"] for r in counts.collect()]  # an entry per feature at most
        if filled:
            parts.append(cells.filter(F.col("pos").isin(filled)))
        short = [p for p in short if p not in set(filled)]
        if not short:
            break
        share = min(1.0, 8.0 * share)
    cells = reduce(lambda x, y: x.unionByName(y), parts)
    taken = hash_take(cells, "row_id", sample, seed, ["pos"]).select("pos", "value")

    def scale(pos, group):
        return pd.DataFrame({"pos": [pos[0]], "sn": [sn_of_sample(group["value"].to_numpy(dtype=np.float64))]})

    known = taken.groupBy("pos").applyInPandas(scale, "pos int, sn double")
    return every.join(known, "pos", "left")


def _values(rows, positions):
    """``(row_id, pos, value)`` of the non-NaN cells at the given positions."""
    cells = F.transform("features", lambda x, i: F.struct(i.alias("pos"), not_nan_or_null(x).alias("value")))
    wanted = F.filter(cells, lambda c: c["value"].isNotNull() & c["pos"].isin(positions))
    return rows.select("row_id", "_draw", F.inline(wanted)).select("row_id", "pos", "value")


def statistical_outlier_scores(df, key, features, label=None, include_label=False, sample=SN_SAMPLE,
                               quantile=ROW_QUANTILE, seed=42):
    """``(row_id, score)``: high quantile over features of ``|x - median| / S_n``.

    A cell without a usable deviation (NaN, or a feature whose scale is zero) counts
    as 0.  Medians and scales reach the rows as two arrays of one entry per feature,
    so scoring is a narrow projection.
    """
    names = [*features, label] if include_label and label else features
    rows = canonical(df, key, None, names)
    medians = per_feature_array(column_medians(rows), "median", "medians")
    scales = per_feature_array(sn_scale(rows, sample, seed), "sn", "scales")
    return deviation_scores(rows.withColumns({"medians": medians, "scales": scales}), quantile)


def deviation_scores(centred, quantile=ROW_QUANTILE):
    """``(row_id, score)`` of rows with their ``features`` and the arrays ``medians`` and ``scales``."""
    deviations = F.transform(
        F.zip_with("features", F.arrays_zip("medians", "scales"), _deviation),
        lambda d: F.when(d.isNull() | F.isnan(d), F.lit(0.0)).otherwise(d),
    )
    return centred.select("row_id", row_quantile(deviations, quantile).alias("score"))


def _deviation(x, centre):
    scale = centre["scales"]
    return F.abs(x - centre["medians"]) / F.when((scale == 0) | F.isnan(scale), F.lit(None)).otherwise(scale)

