"""The S_n scale of whole columns: exact, without comparing all pairs and without a feature in one task.

The inner median of a value is the distance to its ``k``-th nearest of all ``n`` values, ``k`` half of them.  In the sorted column
those ``k`` are a window; it starts at the first place ``a`` where ``(x[a] + x[a + k]) / 2`` reaches the value.
The column is kept as different values with counts and cut into blocks along its order.  The ends of the blocks say
where a window can start to within about two blocks, so a block of values is answered from a few others.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from assaykit.functions.scalars import not_nan_or_null
from assaykit.session import checkpointed

BLOCK = 16384  # values in a block at least, copies counted
BLOCKS = 1024  # blocks of a feature at most, about
NEEDED = 16  # blocks that are brought together to answer one request, unless a single place needs more


def whole_sn(cells, factor):
    """``(pos, sn)`` of ``(pos, value)`` cells; null and NaN are skipped.

    A feature without values is missing, and one with an infinite value has NaN, as the distance of infinity to itself is.
    """
    value = (not_nan_or_null("value") + F.lit(0.0)).alias("value")  # -0.0 becomes 0.0
    counts = cells.select("pos", value).filter("value is not null").groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts)
    endless = F.abs("value") == F.lit(float("inf"))
    lost = counts.filter(endless).select("pos").distinct()
    finite = counts.join(F.broadcast(lost), "pos", "left_anti")  # a row per feature at most
    inner = _inner_medians(_in_order(finite)).groupBy("pos", "value").agg(F.sum("n").alias("n"))
    placed = _in_order(inner)
    middle = [(F.col("before") <= r) & (r < F.col("before") + F.col("n")) for r in (F.expr("(all - 1) div 2"), F.expr("all div 2"))]
    ends = [F.max(F.when(m, F.col("value"))) for m in middle]
    found = placed.filter(middle[0] | middle[1]).groupBy("pos").agg((F.lit(float(factor)) * (ends[0] + ends[1]) / 2).alias("sn"))
    return found.unionByName(lost.withColumn("sn", F.lit(float("nan"))))


def _in_order(counts):
    """``counts`` of different values with ``before``, the number of smaller values of the feature, and ``all``."""
    placed = checkpointed(counts.orderBy("pos", "value").withColumn("part", F.spark_partition_id()))
    feature = Window.partitionBy("pos")
    before = feature.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A row per partition and feature that it holds: about as many as partitions and features together.
    starts = placed.groupBy("pos", "part").agg(F.sum("n").alias("held")).select(
        "pos", "part", (F.sum("held").over(before) - F.col("held")).alias("start"), F.sum("held").over(feature).alias("all")
    )
    along = Window.partitionBy("pos", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.join(F.broadcast(starts), ["pos", "part"])
    return numbered.select("pos", "value", "n", (F.col("start") + F.sum("n").over(along) - F.col("n")).alias("before"), "all")


def _inner_medians(placed):
    """``(pos, value, n)``: the median distance of each different value to all values, and its copies."""
    size = F.greatest(F.lit(BLOCK).cast("bigint"), F.ceil(F.col("all") / F.lit(BLOCKS)))
    cells = F.sort_array(F.collect_list(F.struct("before", "value", "n")))
    blocks = placed.groupBy("pos", "all", F.floor(F.col("before") / size).alias("block")).agg(cells.alias("cells"))
    blocks = checkpointed(blocks.select("pos", "all", "block", "cells.before", "cells.value", "cells.n"))
    ends = F.struct("block", F.get("before", F.lit(0)).alias("start"), F.get("value", F.lit(0)).alias("least"), F.element_at("value", -1).alias("most"))
    outline = blocks.groupBy("pos").agg(F.sort_array(F.collect_list(ends)).alias("ends"))
    outline = outline.select("pos", F.col("ends.block").alias("blocks"), F.col("ends.start").alias("starts"), "ends.least", "ends.most")
    asked = blocks.join(F.broadcast(outline), "pos").mapInPandas(
        _requests, "pos int, request string, all bigint, need bigint, asked array<double>, copies array<bigint>, low array<bigint>, high array<bigint>"
    )
    held = blocks.select("pos", F.col("block").alias("need"), "before", "value")
    return asked.join(held, ["pos", "need"]).groupBy("pos", "request").applyInPandas(_answers, "pos int, value double, n bigint")


def _half(n):
    return (n + 1) // 2


def window_starts(values, total, starts, least, most):
    """``(low, high)``: the places between which the windows of ``values`` start, from the ends of the blocks alone."""
    k = _half(total)
    if total == k:
        return np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    cuts = np.unique(np.concatenate([starts, starts - k, [0]]))
    cuts = cuts[(cuts >= 0) & (cuts < total - k)]
    left, right = (np.searchsorted(starts, cuts + d, "right") - 1 for d in (0, k))
    cuts = np.append(cuts, total - k)
    low = cuts[np.searchsorted(most[left] / 2 + most[right] / 2, values, "left")]
    return low, cuts[np.searchsorted(least[left] / 2 + least[right] / 2, values, "left")]


def _requests(frames):
    """A row for each block that some values of a block need; the first of a request carries the values."""
    for frame in frames:
        found = []
        for row in frame.itertuples(index=False):
            values, total, starts = np.asarray(row.value), int(row.all), np.asarray(row.starts)
            low, high = window_starts(values, total, starts, np.asarray(row.least), np.asarray(row.most))
            k = _half(total)
            ranges = ((low - 1, high), (low + k - 1, high + k))
            spans = [np.searchsorted(starts, np.clip(r, 0, total - 1), "right") - 1 for pair in ranges for r in pair]
            begin, needed, number = 0, set(), 0
            new = np.flatnonzero(np.any([np.diff(s) != 0 for s in spans], axis=0)) + 1
            for i, j in zip([0, *new], [*new, len(values)]):
                more = {*range(spans[0][i], spans[1][i] + 1), *range(spans[2][i], spans[3][i] + 1)}
                if needed and len(needed | more) > NEEDED:
                    found += _request(row, number, begin, i, needed, low, high)
                    begin, needed, number = i, set(), number + 1
                needed |= more
            found += _request(row, number, begin, len(values), needed, low, high)
        columns = ["pos", "request", "all", "need", "asked", "copies", "low", "high"]
        yield pd.DataFrame(found, columns=columns)


def _request(row, number, begin, end, needed, low, high):
    carried = [np.asarray(row.value)[begin:end], np.asarray(row.n)[begin:end], low[begin:end], high[begin:end]]
    for at, need in enumerate(sorted(needed)):
        yield row.pos, f"{row.block}-{number}", row.all, row.blocks[need], *(carried if at == 0 else [None] * 4)


def _answers(group):
    group = group.sort_values("need")
    before, value = (np.concatenate(group[c].tolist()) for c in ("before", "value"))
    row = group[group["asked"].notna()].iloc[0]
    total, asked = int(row["all"]), np.asarray(row["asked"])
    medians = inner_medians(asked, total, np.asarray(row["low"]), np.asarray(row["high"]), before, value)
    return pd.DataFrame({"pos": row["pos"], "value": medians, "n": row["copies"]})


def inner_medians(asked, total, low, high, before, value):
    """The median distances of ``asked`` to all values.

    ``before`` and ``value`` tell the values at the places that the windows, starting between ``low`` and ``high``, can touch.
    """
    k = _half(total)

    def at(place):
        return value[np.searchsorted(before, place, "right") - 1]

    while (open_ := low < high).any():
        middle = (low + high) // 2
        reached = at(middle) / 2 + at(np.minimum(middle + k, total - 1)) / 2 >= asked
        low, high = np.where(open_ & ~reached, middle + 1, low), np.where(open_ & reached, middle, high)
    found = np.maximum(asked - at(low), at(low + k - 1) - asked)
    if total % 2:
        return found
    under = np.where(low > 0, asked - at(np.maximum(low - 1, 0)), np.inf)
    over = np.where(low + k < total, at(np.minimum(low + k, total - 1)) - asked, np.inf)
    return (found + np.minimum(under, over)) / 2
