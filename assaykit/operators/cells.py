"""Similarity joins by pivot cells.

Vectors are assigned to the nearest of a bounded number of pivots.  Distances to the
pivots bound the distance between any two vectors, so a vector only has to meet the
cells that can hold a partner; cells that cannot are never paired.  Neighbouring cells
form a region of about a block of rows, and a vector travels once to each region that
has a cell it must meet, however many they are.  A region with more rows is cut into
blocks; every pair of blocks becomes one group, which compares small squares of rows
cell by cell and returns a result linear in its rows.  Where many copies of the table would
be sent, the groups are met in rounds, and the disk holds the copies of one round.
"""

import gc
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from assaykit.operators.ranking import hash_take
from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed

# Rows of a side that a task holds.  A row is sent to as many blocks as its group has on the other
# side, so large blocks keep the shuffle small; the squares compared at a time are small all the same.
BLOCK_ROWS = 16_384
SQUARE = 1024
# Regions of a small table, so that all cores have some.
LEAST_REGIONS = 24
MAX_PIVOTS = 8192
MAX_PIVOT_BYTES = 64 << 20

# A round of a join sends so many bytes, or so many copies of the table if that is more.
ROUND_BYTES = 1 << 30
ROUND_COPIES = 4

# Entries of the distance matrix a task holds while it places a batch of vectors.
CHUNK_CELLS = 1 << 22

# Added to every pruning bound, so that rounding never prunes a partner.
SLACK = 1e-9
_CLOSE_PIVOTS = 1e-6


def stacked(series, width):
    """The arrays of a pandas column as one matrix."""
    return np.stack(series.to_numpy()).astype(np.float64) if len(series) else np.empty((0, width))


def squared_distances(left, right):
    gram = left @ right.T
    return np.maximum((left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2.0 * gram, 0.0)


def chunks(rows, columns):
    """Slices of ``rows`` that keep a rows x columns matrix within ``CHUNK_CELLS`` entries."""
    step = max(1, CHUNK_CELLS // max(1, columns))
    return [slice(i, i + step) for i in range(0, rows, step)]


def squares(left, right, below=False):
    """Pairs of slices of the positions ``left`` and ``right``; ``below`` leaves out those below the diagonal."""
    for i in range(0, len(left), SQUARE):
        for j in range(i if below else 0, len(right), SQUARE):
            yield left[i : i + SQUARE], right[j : j + SQUARE]


def by_cell(wanted, homes):
    """``(cell, left, right)``: positions of the rows that want a cell (a list of cells each) and of those at home there."""
    sizes = np.array([len(w) for w in wanted], dtype=np.int64)
    if not len(homes) or not sizes.sum():
        return
    cells = np.concatenate([np.asarray(w, dtype=np.int64) for w in wanted])
    order, home_order = np.argsort(cells, kind="stable"), np.argsort(homes, kind="stable")
    owners, cells, homes = np.repeat(np.arange(len(sizes)), sizes)[order], cells[order], np.asarray(homes)[home_order]
    for cell in np.unique(homes):
        left = owners[slice(*np.searchsorted(cells, [cell, cell + 1]))]
        if len(left):
            yield cell, left, home_order[slice(*np.searchsorted(homes, [cell, cell + 1]))]


class Pivots:
    """Distinct vectors drawn in hash order, at most ``MAX_PIVOT_BYTES`` of them."""

    def __init__(self, points):
        self.points = points

    @classmethod
    def drawn(cls, vectors, rows, seed):
        """About the square root of ``rows`` pivots; they follow the density of the data."""
        width = len(vectors.select("vector").first()["vector"])
        most = max(1, min(MAX_PIVOTS, MAX_PIVOT_BYTES // (8 * max(1, width))))
        wanted = max(1, min(most, int(np.sqrt(rows) / 2)))
        drawn = hash_take(vectors.select("row_id", "vector"), "row_id", wanted, seed).select("vector").collect()
        return cls(np.unique(np.array([r["vector"] for r in drawn], dtype=np.float64).reshape(len(drawn), width), axis=0))

    def thinned(self, separation):
        """A subset that is at least ``separation`` apart and within that of every dropped pivot.

        Many near copies of one vector draw many pivots; one cell should hold them all.
        """
        kept = self.points[:1]
        for point in self.points[1:]:
            if squared_distances(point[None, :], kept).min() > separation**2:
                kept = np.vstack([kept, point])
        return Pivots(kept)

    @property
    def width(self):
        return self.points.shape[1]

    def squared(self, matrix):
        return squared_distances(matrix, self.points)

    def regions(self, rows):
        """The region of every pivot: that of the nearest of some pivots, one for about ``BLOCK_ROWS`` of ``rows``."""
        wanted = min(len(self.points), max(LEAST_REGIONS, int(np.ceil(rows / BLOCK_ROWS))))
        centres = self.points[np.linspace(0, len(self.points) - 1, wanted).astype(int)]
        parts = chunks(len(self.points), wanted)
        return np.concatenate([squared_distances(self.points[p], centres).argmin(axis=1) for p in parts])

    def beyond_bisector(self, squared, home):
        """How far each vector must travel from its home cell to enter every other cell.

        The signed distance to the bisector of two pivots; pivots too close together
        for a stable quotient never prune.
        """
        near, place = np.unique(home, return_inverse=True)
        apart = np.sqrt(squared_distances(self.points[near], self.points))[place]
        gap = squared - squared[np.arange(len(home)), home][:, None]
        return np.where(apart > _CLOSE_PIVOTS, gap / (2.0 * np.maximum(apart, _CLOSE_PIVOTS)), -np.inf)


def with_home(vectors, pivots):
    """Adds ``home``, the nearest pivot, and ``home_distance``."""

    @F.pandas_udf("home int, home_distance double")
    def nearest(vector: pd.Series) -> pd.DataFrame:
        matrix, homes, distances = stacked(vector, pivots.width), [], []
        for part in chunks(len(matrix), len(pivots.points)):
            squared = pivots.squared(matrix[part])
            homes.extend(squared.argmin(axis=1))
            distances.extend(np.sqrt(squared.min(axis=1)))
        return pd.DataFrame({"home": np.array(homes, dtype="int32"), "home_distance": np.array(distances, dtype=float)})

    return vectors.withColumn("_h", nearest("vector")).select(*vectors.columns, "_h.home", "_h.home_distance")


def visiting(cells, regions):
    """Lists of cells as lists of the regions they lie in and, in step, of the cells in each."""
    places, parts = [], []
    for visited in cells:
        of = regions[visited]
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.diff(of[order], prepend=-1))
        places.append(of[order][starts].astype("int32"))
        parts.append([p.astype("int32") for p in np.split(visited[order], starts[1:])] if len(order) else [])
    return pd.DataFrame({"regions": pd.Series(places, dtype=object), "cells": pd.Series(parts, dtype=object)})


VISITS = "regions array<int>, cells array<array<int>>"


def with_visits(vectors, visits):
    """One row per region of ``visits``, with ``cell`` (the region) and ``cells`` (those to meet there)."""
    visit = F.explode(F.arrays_zip(F.col(f"{visits}.regions").alias("regions"), F.col(f"{visits}.cells").alias("cells")))
    kept = [c for c in vectors.columns if c != visits]
    return vectors.select(*kept, visit.alias("_visit")).select(*kept, F.col("_visit.regions").alias("cell"), F.col("_visit.cells").alias("cells"))


def with_cells_within(vectors, pivots, radius, regions):
    """Adds ``home``, ``region``, ``core`` and ``visits``: the cells a vector has to meet to find all partners within ``radius``.

    ``core`` is true when it is so close to the pivot that any two core members are within ``radius`` of each
    other.  A vector meets its home unless it is in the core, and other cells only when their
    number is lower than the home's, which counts each pair in exactly one cell.
    """

    @F.pandas_udf(f"home int, region int, core boolean, {VISITS}")
    def placed(vector: pd.Series) -> pd.DataFrame:
        matrix, cells, homes, core = stacked(vector, pivots.width), [], [], []
        for part in chunks(len(matrix), len(pivots.points)):
            squared = pivots.squared(matrix[part])
            home = squared.argmin(axis=1)
            close = np.sqrt(squared.min(axis=1)) <= radius / 2 - SLACK
            reach = pivots.beyond_bisector(squared, home) <= radius + SLACK
            reach &= np.arange(squared.shape[1])[None, :] < home[:, None]
            reach[np.arange(len(home)), home] = ~close
            cells.extend(np.flatnonzero(r) for r in reach)
            homes.extend(home)
            core.extend(close)
        homes = np.array(homes, dtype="int32")
        given = {"home": homes, "region": regions[homes].astype("int32"), "core": np.array(core, dtype=bool)}
        return pd.concat([pd.DataFrame(given), visiting(cells, regions)], axis=1)

    found = vectors.withColumn("_p", placed("vector"))
    visits = F.struct("_p.regions", "_p.cells").alias("visits")
    return found.select(*vectors.columns, "_p.home", "_p.region", "_p.core", visits)


def _block_counts(side, name):
    n = F.count(F.lit(1))
    return side.groupBy("cell").agg(n.alias(f"{name}_rows"), F.ceil(n / F.lit(BLOCK_ROWS)).cast("int").alias(name))


def _sized(side, grid, few_cells):
    """``side`` with the block counts of its cells."""
    fresh = side.select(*[F.col(c).alias(c) for c in side.columns])  # fresh names keep two sides of one table apart
    if few_cells:
        return fresh.join(F.broadcast(grid.drop("_rows")), "cell")
    return lookup_join(fresh, grid, "cell", "_rows").filter(F.col("_rows").isNotNull()).drop("_rows")


def _with_payload(side, payload):
    return side if payload is None else side.join(payload, "row_id")


def _in_rounds(compared, sent, row_bytes, rows):
    """The union of ``compared(part)``, which sends ``sent`` rows in all: ``part`` tells of a hash whether it is in the round.

    Each round's results are written, so that its shuffle files can go: the cleaner removes those of frames that
    nobody holds any more when the driver collects garbage.
    """
    rounds = -(-sent * row_bytes // max(ROUND_BYTES, ROUND_COPIES * rows * row_bytes))
    if rounds <= 1:
        return compared(lambda *key: F.lit(True))
    found = []
    for number in range(rounds):
        found.append(checkpointed(compared(lambda *key: F.pmod(F.xxhash64(F.lit(rounds), *key), F.lit(rounds)) == number)))
        gc.collect()
        found[-1].sparkSession.sparkContext._jvm.System.gc()
    return reduce(lambda a, b: a.unionByName(b), found)


def cell_join(left, right, compare, schema, few_cells=True, payload=None, alone=False, row_bytes=None):
    """``compare(left_block, right_block)`` for every pair of blocks that share a cell.

    Both sides need ``cell`` and ``row_id``.  A cell with many rows is spread over
    many block pairs by a hash of the row, so neither a task's memory nor its work
    depends on how the rows are distributed over the cells.

    ``few_cells`` promises that their number has a bound that does not grow with the
    rows; then the block counts are broadcast.  Otherwise only the largest cells' are, and
    cells with a single row on both sides, which have no pair in a join of a table with itself,
    are left out before anything travels, unless ``alone`` says that the sides are different tables.

    ``payload``, unique on ``row_id``, is joined to both sides once their rows are placed, so that many
    cells a row are looked up without it.

    ``row_bytes``, of a row that is sent, asks for rounds where many copies of the right side would be sent.
    """
    grid = _block_counts(left, "_left_blocks").join(_block_counts(right, "_right_blocks"), "cell")
    rows = F.greatest("_left_blocks_rows", "_right_blocks_rows")
    sent = F.col("_left_blocks_rows") * F.col("_right_blocks") + F.col("_right_blocks_rows") * F.col("_left_blocks")
    grid = grid.select("cell", "_left_blocks", "_right_blocks", rows.alias("_rows"), F.col("_right_blocks_rows").alias("_own"), sent.alias("_sent"))
    if not few_cells or row_bytes:
        grid = checkpointed(grid if alone or few_cells else grid.filter("_rows > 1"))
    key = ["cell", "_left", "_right"]

    def compared(part):
        def spread(side, own, other, own_blocks, other_blocks):
            placed = (
                _sized(side if few_cells else side.filter(part("cell")), grid.drop("_own", "_sent"), few_cells)
                .withColumn(own, F.pmod(F.xxhash64(F.lit(own), "row_id"), F.col(own_blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)))
                .drop("_left_blocks", "_right_blocks")
            )
            return _with_payload(placed.filter(part(*key)) if few_cells else placed, payload)

        lefts = spread(left, "_left", "_right", "_left_blocks", "_right_blocks").groupBy(*key)
        rights = spread(right, "_right", "_left", "_right_blocks", "_left_blocks").groupBy(*key)
        return lefts.cogroup(rights).applyInPandas(compare, schema)

    if not row_bytes:
        return compared(lambda *key: F.lit(True))
    total = grid.agg(F.sum("_sent").alias("sent"), F.sum("_own").alias("own")).first()
    return _in_rounds(compared, total["sent"] or 0, row_bytes, total["own"] or 0)


def cell_self_join(rows, compare, schema, few_cells=True, payload=None, row_bytes=None, table_rows=0):
    """``compare(left_block, right_block, same)`` for every unordered pair of blocks of a cell; ``same``: a block with itself.

    As ``cell_join`` of a table with itself, but a row travels once to a pair of blocks, and no pair is met twice.
    ``row_bytes`` asks for rounds where many copies of ``table_rows`` rows would be sent.
    """
    sent = (F.col("_blocks_rows") * F.col("_blocks")).alias("_sent")
    grid = _block_counts(rows, "_blocks").select("cell", "_blocks", F.col("_blocks_rows").alias("_rows"), sent).filter("_rows > 1")
    if not few_cells or row_bytes:
        grid = checkpointed(grid)
    key = ["cell", "_left", "_right"]

    def pairs(block: pd.DataFrame) -> pd.DataFrame:
        low, high = block["_left"].iloc[0], block["_right"].iloc[0]
        left = block[block["_own"] == low]
        return compare(left, left if low == high else block[block["_own"] == high], low == high)

    def compared(part):
        placed = (
            _sized(rows if few_cells else rows.filter(part("cell")), grid.drop("_sent"), few_cells)
            .withColumn("_own", F.pmod(F.xxhash64("row_id"), F.col("_blocks")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .withColumns({"_left": F.least("_own", "_other"), "_right": F.greatest("_own", "_other")})
            .drop("_blocks", "_other")
        )
        return _with_payload(placed.filter(part(*key)) if few_cells else placed, payload).groupBy(*key).applyInPandas(pairs, schema)

    if not row_bytes:
        return compared(lambda *key: F.lit(True))
    return _in_rounds(compared, grid.agg(F.sum("_sent")).first()[0] or 0, row_bytes, table_rows)
