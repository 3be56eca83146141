"""Joins that keep working when one key holds a large share of the rows."""

from pyspark.sql import functions as F

from assaykit.session import checkpointed

# At most this many keys are joined by broadcast; every other key is then smaller
# than each of them, so it holds less than 1/HOT_KEYS of the rows.
HOT_KEYS = 1000
# Keys with fewer rows are never worth it.
HOT_FLOOR = 100_000


def lookup_join(rows, lookup, keys, size):
    """Left join of ``rows`` with ``lookup``, which has each ``keys`` value once.

    ``size`` names the lookup column that says how many of ``rows`` carry the key.
    The largest keys are joined by broadcasting their lookup rows, ``HOT_KEYS`` at
    most, so that their rows are never shuffled together; the rest is an ordinary
    join.  The lookup is written once and serves all of it.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    columns = rows.columns + [c for c in lookup.columns if c not in keys]
    lookup = checkpointed(lookup)
    largest = lookup.filter(F.col(size) >= HOT_FLOOR).orderBy(F.col(size).desc()).limit(HOT_KEYS).collect()
    if not largest:
        return rows.join(lookup, keys, "left").select(*columns)
    hot = F.broadcast(rows.sparkSession.createDataFrame(largest, lookup.schema))
    cold = lookup.join(hot, keys, "left_anti")
    on_hot = rows.join(hot, keys).select(*columns)
    on_cold = rows.join(hot, keys, "left_anti").join(cold, keys, "left").select(*columns)
    return on_hot.unionByName(on_cold)
