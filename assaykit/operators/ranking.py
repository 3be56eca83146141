"""Exact sampling, splitting and numbering without ordering everything in one task.

Rows are ordered by a hash of their key.  The hash range is cut into slices, the rows
per slice are counted, and the running total of those counts says where every slice
starts in the order.  A cut of the order at a given rank therefore falls into one known
slice, and only the rows of such slices have to be sorted.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaykit.functions.hashing import stable_uniform
from assaykit.session import checkpointed

# Slices of the hash range; a slice of 100 billion rows holds some six million.
SLICES = 16384

_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit
_LOCAL_MASK = (1 << _SHIFT) - 1


def hash_bins(df, key, cuts, seed=42, by=(), name="bin"):
    """Number of ``cuts`` below the row's rank in hash order within its ``by`` group.

    ``cuts`` maps the group's row count (a column) to a sorted array of ranks: rows
    ranked at or before the first cut get 0, those after the last get its length.
    The same as numbering the group with ``row_number`` and counting, but rows
    outside the slices that hold a cut are placed without being sorted or moved.
    """
    by = list(by)
    hashed = df.withColumn("_u", stable_uniform(key, seed)).withColumn(
        "_slice", F.floor(F.col("_u") * SLICES).cast("int")
    )
    group = Window.partitionBy(*by, F.lit(0))
    so_far = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per group and slice: bounded by classes x slices, not by the data.
    places = (
        hashed.groupBy(*by, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_last", F.sum("_n").over(so_far))
        .withColumn("_cuts", cuts(F.sum("_n").over(group)))
        .withColumn("_before", F.col("_last") - F.col("_n"))
        .select(
            *[F.col(c).alias(f"_by_{c}") for c in by],
            F.col("_slice").alias("_place"),
            "_before",
            "_cuts",
            F.size(F.filter("_cuts", lambda c: c < F.col("_before") + 1)).alias("_low"),
            F.size(F.filter("_cuts", lambda c: c < F.col("_last"))).alias("_high"),
        )
    )
    same = F.col("_slice") == F.col("_place")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = hashed.join(places, same)
    settled = placed.filter(F.col("_low") == F.col("_high")).withColumn(name, F.col("_low"))
    order = Window.partitionBy(*by, "_slice").orderBy("_u", key)
    ranked = (
        placed.filter(F.col("_low") != F.col("_high"))
        .withColumn("_rank", F.col("_before") + F.row_number().over(order))
        .withColumn(name, F.size(F.filter("_cuts", lambda c: c < F.col("_rank"))))
    )
    keep = df.columns + [name]
    return settled.select(*keep).unionByName(ranked.select(*keep))


def hash_take(df, key, n, seed=42, by=()):
    """Exactly the first ``n`` rows of every ``by`` group in hash order (all, when fewer)."""
    binned = hash_bins(df, key, lambda rows: F.array(F.lit(n).cast("bigint")), seed, by, "_taken")
    return binned.filter(F.col("_taken") == 0).drop("_taken")


def stratified_split(df, key, label, fraction=0.1, seed=42, name="is_validation"):
    """Mark ``round(n * fraction)`` rows of each label as held out."""
    if not 0 < fraction < 1:
        raise ValueError("the held-out fraction must lie between 0 and 1")
    binned = hash_bins(
        df, key, lambda rows: F.array(F.round(rows * F.lit(float(fraction))).cast("bigint")), seed, [label], "_part"
    )
    return binned.withColumn(name, F.col("_part") == 0).drop("_part")


def stratified_folds(df, key, label, folds=5, seed=42, name="fold"):
    """Fold number 0..folds-1; the sizes within a label differ by at most one."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    return hash_bins(
        df,
        key,
        lambda rows: F.array(*[F.floor(rows * F.lit(i) / F.lit(folds)).cast("bigint") for i in range(1, folds)]),
        seed,
        [label],
        name,
    )


def row_index(df, order_by, start=0, name="row_idx"):
    """Consecutive numbers from ``start`` in the order of ``order_by``.

    The table is range-sorted and written once with each row's place in its
    partition; the number is that place plus the rows in earlier partitions.  The
    write pins the partitioning, so both passes see the same places even when an
    executor is lost in between.
    """
    placed = checkpointed(df.orderBy(*order_by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_at"), _SHIFT)
    # One row per partition of the sorted table.
    starts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_start",
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            - F.col("_n"),
        )
        .select("_part", "_start")
    )
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    index = F.col("_start") + F.col("_at").bitwiseAND(_LOCAL_MASK) + F.lit(start)
    return numbered.select(*df.columns, index.cast("bigint").alias(name))


def csv_positions(df, index="row_idx"):
    """1-based data row and physical row of a file with one header line."""
    return df.withColumn("data_row", F.col(index) + 1).withColumn("csv_row", F.col(index) + 2)


def running_totals(df, order, totals, ascending=True, following=()):
    """Inclusive running sums of ``totals`` (name -> output name) along a unique ``order`` value.

    The order values are cut into ranges at their approximate quantiles; each range is
    summed on its own and shifted by the total of the ranges before it.  For each column of ``following`` the
    next row's value is added as ``next_<column>``, null at the end.
    """
    ranges = 2 * max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = df.agg(F.percentile_approx(order, points, F.lit(10_000)).alias("bounds")).scalar()
    ranged = df.withColumn("_bounds", bounds).withColumn(
        "_range", F.size(F.filter(F.coalesce("_bounds", F.array()), lambda b: b < F.col(order)))
    ).drop("_bounds")
    direction = F.col("_range").asc() if ascending else F.col("_range").desc()
    before = Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    # At most ``ranges`` rows.
    first = F.min_by if ascending else F.max_by
    shifts = ranged.groupBy("_range").agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in totals], *[first(c, order).alias(f"_first_{c}") for c in following]
    )
    after = Window.orderBy(direction)
    shifts = shifts.select(
        F.col("_range"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_shift_{c}") for c in totals],
        *[F.lead(f"_first_{c}").over(after).alias(f"_next_{c}") for c in following],
    )
    along = Window.partitionBy("_range").orderBy(F.col(order).asc() if ascending else F.col(order).desc())
    following = {f"next_{c}": F.coalesce(F.lead(c).over(along), F.col(f"_next_{c}")) for c in following}
    along = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {out: F.col(f"_shift_{c}") + F.sum(c).over(along) for c, out in totals.items()}
    found = ranged.join(F.broadcast(shifts), "_range").withColumns({**sums, **following})
    return found.select(*df.columns, *sums, *following)
