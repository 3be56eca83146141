"""Exact quantiles from two reads of the data, without sorting it."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaykit.functions.scalars import not_nan_or_null
from assaykit.session import checkpointed

SKETCH = 1000  # size parameter of the sketches, 24 KB each
MARGIN = 0.006  # twice the rank error that such a sketch exceeds once in a hundred times
FEW = 2000  # a group of so many values is one bracket
BROADCAST_ROWS = 1_000_000
SORTED_VALUES = 1 << 20  # distinct values of one bracket that one task orders
CUTS = 256  # parts a bracket of more values is cut into


def exact_quantiles(df, value, quantiles, by=(), name="quantiles"):
    """``array<double>`` of linearly interpolated quantiles of ``value`` per ``by`` group.

    Null and NaN are skipped; a group without other values gets null.  A first read makes a mergeable
    sketch of each group, which brackets the wanted order statistics by two values each.  A second
    one counts the values between the brackets, and those inside by value; the order statistics
    follow from the counts.  The result is exact: a bracket that misses its rank, which is very rare, is widened.
    All quantiles and groups share the two reads, and everything runs in the JVM.
    """
    by, quantiles = list(by), [float(q) for q in quantiles]
    keys = [f"_g{i}" for i in range(len(by))]
    base = df.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)],
        (not_nan_or_null(value) + F.lit(0.0)).alias("_v"),  # -0.0 becomes 0.0
    )
    sketched = base.groupBy(*keys).agg(
        F.count("_v").alias("_all"),
        F.min("_v").alias("_least"),
        F.max("_v").alias("_most"),
        F.kll_sketch_agg_double("_v", SKETCH).alias("_sketch"),
    )
    sketched = checkpointed(sketched)  # a sketch made again would differ
    margin = MARGIN
    while True:
        brackets = sketched.select(*keys, "_all", _brackets(quantiles, margin).alias("_cuts"))
        found = _order_statistics(base, brackets, quantiles, keys)
        if margin >= 1 or found.filter(F.col("_at").isNull()).isEmpty():
            break
        margin *= 10
    ends = found.groupBy(*keys, "_q").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_hi"),
        F.max("_weight").alias("_weight"),
    )
    between = F.col("_lo") * (F.lit(1.0) - F.col("_weight")) + F.col("_hi") * F.col("_weight")
    exact = (F.col("_weight") == 0) | (F.col("_lo") == F.col("_hi"))
    pair = F.struct("_q", F.when(exact, F.col("_lo")).otherwise(between).alias("value"))
    arrays = ends.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(pair)), lambda s: s["value"]).alias(name))
    # Groups without any value keep their row; without groups there is always one row.
    if not by:
        return arrays.withColumn(name, F.when(F.size(name) > 0, F.col(name)))
    return _joined(sketched.select(*keys), arrays, keys).select(*[F.col(k).alias(c) for c, k in zip(by, keys)], name)


def _joined(left, right, keys, how="left", small=False):
    """Null-safe join on ``keys``; ``small`` says that the right side may be broadcast."""
    fresh = right.select(*[F.col(k).alias(f"{k}_") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    return left.join(F.broadcast(fresh) if small else fresh, same, how).drop(*[f"{k}_" for k in keys])


def _ranks(q):
    """Places of the two neighbours of a quantile, from 0, and the weight of the second."""
    place = F.lit(q) * (F.col("_all") - 1)
    low = F.floor(place)
    return low, F.least(low + 1, F.col("_all") - 1), place - low


def _brackets(quantiles, margin):
    """Disjoint closed ranges of values, ascending, that should hold all wanted order statistics of a group."""

    def bound(rank, limit):
        if not 0 < rank < 1:
            return F.col(limit)
        return F.when(F.col("_all") <= FEW, F.col(limit)).otherwise(F.kll_sketch_get_quantile_double("_sketch", F.lit(rank)))

    # Beyond FEW values both neighbours are within 2 / FEW of the quantile's rank.
    ranges = [
        F.struct(bound(q - margin - 2 / FEW, "_least").alias("low"), bound(q + margin + 2 / FEW, "_most").alias("high"))
        for q in sorted(set(quantiles))
    ]
    empty = F.array().cast("array<struct<low:double,high:double>>")

    def widened(merged, one):
        last = F.element_at(merged, -1)
        rest = F.slice(merged, 1, F.size(merged) - 1)
        longer = F.array(F.struct(last["low"].alias("low"), F.greatest(last["high"], one["high"]).alias("high")))
        touches = (F.size(merged) > 0) & (F.try_element_at(merged, F.lit(-1))["high"] >= one["low"])
        return F.when(touches, F.concat(rest, longer)).otherwise(F.concat(merged, F.array(one)))

    return F.when(F.col("_all") > 0, F.aggregate(F.array(*ranges), empty, widened))


def _order_statistics(base, brackets, quantiles, keys):
    """``(keys, _q, _side, _weight, _at, _v)``: the value at each wanted place; ``_at`` is null if no bracket has it."""
    if keys:
        few = brackets.count() <= BROADCAST_ROWS
        placed = _joined(base, brackets.select(*keys, "_cuts"), keys, "inner", few)
    else:
        placed = base.withColumn("_cuts", brackets.select("_cuts").scalar())
    at = F.size(F.filter("_cuts", lambda c: c["low"] <= F.col("_v")))
    placed = placed.filter(F.col("_v").isNotNull()).withColumn("_at", at)
    inside = (F.col("_at") > 0) & (F.col("_v") <= F.try_element_at("_cuts", F.greatest("_at", F.lit(1)))["high"])
    counts = placed.select(*keys, "_at", F.when(inside, F.col("_v")).alias("_v")).groupBy(*keys, "_at", "_v").agg(
        F.count(F.lit(1)).alias("_n")
    )
    counts = checkpointed(counts)  # values inside brackets, and a row for each gap
    order = Window.partitionBy(*keys, F.lit(0)).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = counts.groupBy(*keys, "_at").agg(
        F.sum("_n").alias("_whole"),
        F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("_held"),
        F.count("_v").alias("_distinct"),
    )
    totals = totals.withColumn("_start", F.sum("_whole").over(order) - F.col("_whole")).filter("_held > 0")
    parts = []
    for i, q in enumerate(quantiles):
        low, high, weight = _ranks(q)
        for side, rank in ((0, low), (1, high)):
            parts.append(F.struct(F.lit(i).alias("_q"), F.lit(side).alias("_side"), rank.alias("_rank"), weight.alias("_weight")))
    wanted = brackets.filter("_all > 0").select(*keys, F.explode(F.array(*parts)).alias("_w")).select(*keys, "_w.*")
    spans = totals.select(*keys, "_at", "_start", (F.col("_start") + F.col("_held")).alias("_stop"))
    holds = (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_stop"))
    if keys:
        fresh = spans.select(*[F.col(k).alias(f"{k}_") for k in keys], "_at", "_start", "_stop")
        holds = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], holds)
        wanted = wanted.join(fresh, holds, "left").drop(*[f"{k}_" for k in keys])
    else:  # a few ranges
        listed = spans.agg(F.collect_list(F.struct("_at", "_start", "_stop")).alias("s")).scalar()
        match = F.get(F.filter("_spans", lambda s: (F.col("_rank") >= s["_start"]) & (F.col("_rank") < s["_stop"])), F.lit(0))
        wanted = wanted.withColumn("_spans", listed).withColumn("_m", match).select(*wanted.columns, "_m._at", "_m._start")
    wanted = wanted.withColumn("_rank", F.col("_rank") - F.col("_start")).select(*keys, "_q", "_side", "_weight", "_at", "_rank")
    values = counts.filter(F.col("_v").isNotNull())
    largest = totals.agg(F.coalesce(F.max("_distinct"), F.lit(0))).first()[0]
    return checkpointed(_at_ranks(values, wanted, [*keys, "_at"], largest))


def _at_ranks(values, wanted, keys, largest):
    """``wanted`` with ``_v``: the value whose copies cover place ``_rank`` of its group in ``values``."""
    if largest > SORTED_VALUES:
        values, wanted, largest, cells = _narrowed(values, wanted, keys, largest)
        return _at_ranks(values, wanted, [*keys, cells], largest).drop(cells)
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = values.select(*keys, (F.sum("_n").over(upto) - F.col("_n")).alias("_rank"), "_v")
    asked = [c for c in wanted.columns if c not in keys and c != "_rank"]
    types = {f.name: f.dataType for f in wanted.schema}
    both = starts.select(*keys, "_rank", "_v", *[F.lit(None).cast(types[c]).alias(c) for c in asked], F.lit(0).alias("_ask")).unionByName(
        wanted.select(*keys, "_rank", F.lit(None).cast("double").alias("_v"), *asked, F.lit(1).alias("_ask"))
    )
    before = Window.partitionBy(*keys).orderBy("_rank", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_v", F.last("_v", ignorenulls=True).over(before)).filter("_ask = 1")
    return filled.select(*wanted.columns, "_v")


def _narrowed(values, wanted, keys, largest):
    """Only the parts of large groups that hold a wanted place, with the places counted from the part's start."""
    cells = f"_c{len(keys)}"
    points = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    bounds = checkpointed(values.groupBy(*keys).agg(F.percentile_approx("_v", points, F.lit(10 * CUTS)).alias("_bounds")))
    cell = F.size(F.filter(F.array_distinct("_bounds"), lambda b: b < F.col("_v")))
    placed = _joined(values, bounds, keys, "inner", bounds.count() <= BROADCAST_ROWS // CUTS).withColumn(cells, cell).drop("_bounds")
    order = Window.partitionBy(*keys).orderBy(cells).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = placed.groupBy(*keys, cells).agg(F.sum("_n").alias("_s"), F.count(F.lit(1)).alias("_d"))
    sizes = checkpointed(sizes.withColumn("_start", F.sum("_s").over(order) - F.col("_s")))
    joined = _joined(wanted, sizes, keys, "left")
    within = (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_s"))
    lost = wanted.filter(F.col("_at").isNull()).withColumn(cells, F.lit(None).cast("int"))
    asked = joined.filter(within).withColumn("_rank", F.col("_rank") - F.col("_start")).select(*wanted.columns, cells)
    held = checkpointed(_joined(placed, asked.select(*keys, cells).distinct(), [*keys, cells], "left_semi"))
    reached = held.groupBy(*keys, cells).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    # Parts are of about equal size, so this ends; a part of one value is never cut again.
    return held, asked.unionByName(lost), min(reached, largest - 1), cells


def exact_median(df, value, by=(), name="median"):
    return exact_quantiles(df, value, [0.5], by, "_q").select(*by, F.get("_q", F.lit(0)).alias(name))
