"""Expressions over feature arrays; all stay in the JVM."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.scalars import is_finite

# Feature values that carry no duplicate evidence and are read as zero (fixed values).
INDICATOR_VALUES = (1.0, -1.0)

# Up to this many features the text of a vector is its grouping key; wider ones use a digest.
WIDE_VECTOR = 16


def feature_array(df, features):
    """Array<double> of the float32-rounded features.

    ``features`` is a list of numeric columns, or the name of one array column.
    """
    if isinstance(features, str):
        return F.transform(F.col(features), lambda x: x.cast("float").cast("double"))
    return F.array(*[F.col(f"`{name}`").cast("float").cast("double") for name in features])


def is_array_column(df, name):
    return isinstance(df.schema[name].dataType, T.ArrayType)


def mask_indicators(vector):
    """±1 become 0; adding zero folds -0.0 into 0.0."""
    return F.transform(vector, lambda x: F.when(x.isin(*INDICATOR_VALUES), F.lit(0.0)).otherwise(x + F.lit(0.0)))


def has_nan(vector):
    """True when any entry is null or NaN."""
    return F.exists(vector, lambda x: F.coalesce(F.isnan(x), F.lit(True)))


def zero_non_finite(vector):
    return F.transform(vector, lambda x: F.when(is_finite(x), x + F.lit(0.0)).otherwise(F.lit(0.0)))


def impute(vector, fill):
    """Non-finite entries replaced by the entry of ``fill`` at the same place."""
    return F.zip_with(vector, fill, lambda x, m: F.when(is_finite(x), x).otherwise(m))


def dot(left, right):
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def norm(vector):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def unit(vector, length):
    """``vector`` scaled to length one; a zero vector stays zero."""
    return F.transform(vector, lambda x: x / F.when(length == 0, F.lit(1.0)).otherwise(length))


def content_key(vector, wide):
    """Text that is equal exactly for equal vectors, and cheap to hash and shuffle.

    The entries' shortest decimal form is one-to-one for doubles without NaN and
    negative zero.  Of a wide vector only the SHA-256 of the text is kept, so that a
    grouping moves 64 bytes a row instead of the whole vector.
    """
    text = F.array_join(F.transform(vector, lambda x: x.cast("string")), ",")
    return F.sha2(text, 256) if wide else text


def row_quantile(vector, q):
    """Quantile of the entries of one row, linear between order statistics.

    The plain interpolation formula gives NaN between two infinities, which a later
    normalisation treats as an invalid score.
    """
    ordered = F.sort_array(vector)
    place = F.lit(float(q)) * (F.size(vector) - 1)
    below = F.floor(place).cast("int")
    above = F.least(below + 1, F.size(vector) - 1)
    low = F.get(ordered, below)
    high = F.get(ordered, above)
    weight = place - below
    return low + (high - low) * weight
