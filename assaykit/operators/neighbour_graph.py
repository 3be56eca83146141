"""Approximate nearest neighbours by descent on a neighbour graph.

Every row keeps a list of the ``width`` nearest rows it knows of.  The lists start in the
leaves of a few random hyperplane trees.  In each round a row introduces the members of its list, and
rows that list it, to each other: neighbours of neighbours are likely neighbours.  A pair
is reported only if it would enter a list, and rounds end when few lists change.  A row takes part in
a bounded number of groups of bounded size, so its work in a round does not depend on the number of rows.

In the rounds vectors travel as 16-bit numbers, and only to groups that have something new; the distances of the
neighbours that are returned are computed from the vectors themselves.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from assaykit.operators.cells import squared_distances, stacked
from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed

WIDTH = 30  # neighbours a row keeps while the graph is made
TREES = 6
LEAF = 96  # rows of a leaf, about
ROUNDS = 12
TOLERANCE = 0.002  # share of list entries that may still change when the rounds end

LEVELS = 32767  # of the largest component of a vector, as it travels

_PAIRS = "row_id bigint, other bigint, squared double"


def _groups(batches, name):
    """Runs of equal ``name`` in sorted record batches, as tables."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        values = table.column(name).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        for a, b in zip(starts[:-1], starts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(starts[-1])
    if held is not None:
        yield held


def _matrix(table, width, name="vector"):
    return table.column(name).combine_chunks().flatten().to_numpy().reshape(table.num_rows, width)


def coded(matrix):
    """Rows of bytes: a step (a float) and the components of a vector, rounded to whole steps (16 bits each)."""
    step = (np.abs(matrix).max(axis=1, initial=0.0) / LEVELS).astype(np.float32)
    step[~(step > np.finfo(np.float32).tiny)] = 1.0
    whole = np.rint(matrix / step[:, None].astype(np.float64)).astype(np.int16)
    return np.hstack([step[:, None].view(np.uint8), whole.view(np.uint8)])


def decoded(codes):
    """The vectors of the rows of ``coded``."""
    step = np.ascontiguousarray(codes[:, :4]).view(np.float32).astype(np.float64)
    return np.ascontiguousarray(codes[:, 4:]).view(np.int16) * step


def _codes(table):
    """The column ``code`` of a table, all of one length, as rows of bytes."""
    column = table.column("code").combine_chunks()
    first, *_, last = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[first:last].reshape(len(column), -1)


def with_codes(vectors, dimension):
    """``(row_id, code binary)``."""

    def rounded(batches):
        for batch in batches:
            codes = coded(_matrix(pa.Table.from_batches([batch]), dimension))
            ends = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
            column = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["row_id", "code"])

    return vectors.select("row_id", "vector").mapInArrow(rounded, "row_id bigint, code binary")


def _measured(pairs, vectors, dimension):
    """``pairs`` with the squared distance of the vectors themselves."""

    def exact(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            squared = ((_matrix(table, dimension) - _matrix(table, dimension, "theirs")) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(squared)], names=["row_id", "other", "squared"])

    asked = pairs.groupBy("other").agg(F.count(F.lit(1)).alias("asked"))
    others = vectors.select(F.col("row_id").alias("other"), F.col("vector").alias("theirs")).join(asked, "other")
    met = lookup_join(pairs.select("row_id", "other"), others, "other", "asked").join(vectors, "row_id")
    return met.select("row_id", "other", "vector", "theirs").mapInArrow(exact, _PAIRS)


def _emitted(found):
    """Record batches of many small results ``(row_id, other, squared)``."""
    held, size = [], 0
    for part in found:
        held.append(part)
        size += len(part[0])
        if size >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["row_id", "other", "squared"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["row_id", "other", "squared"])


def tree_leaves(vectors, rows, seed, trees=TREES, leaf=LEAF):
    """``(row_id, vector, leaf)``: each vector once per tree; its leaf is the side it lies on of every hyperplane.

    A leaf with many more rows than ``leaf`` is cut at random.
    """
    width = len(vectors.select("vector").first()["vector"])
    depth = max(0, int(np.ceil(np.log2(max(1, rows / leaf)))))
    planes = np.random.default_rng(seed).normal(size=(width, trees * depth))
    powers = 1 << np.arange(depth, dtype=np.int64)

    @F.pandas_udf("array<long>")
    def codes(vector: pd.Series) -> pd.Series:
        sides = (stacked(vector, width) @ planes > 0).reshape(len(vector), trees, depth)
        return pd.Series(list(sides @ powers))

    placed = vectors.select("row_id", "vector", F.posexplode(codes("vector")).alias("tree", "code"))
    sizes = placed.groupBy("tree", "code").agg(F.count(F.lit(1)).alias("size")).withColumn("cuts", F.ceil(F.col("size") / (2 * leaf)))
    cut = lookup_join(placed, sizes, ["tree", "code"], "size")
    part = F.pmod(F.xxhash64("row_id", "tree"), F.col("cuts"))
    return cut.select("row_id", "vector", F.xxhash64("tree", "code", part).alias("leaf"))


def _nearest_in_leaves(leaves, width, dimension):
    def compared(batches):
        def each():
            for table in _groups(batches, "leaf"):
                if table.num_rows < 2:
                    continue
                ids, matrix = table.column("row_id").to_numpy(), _matrix(table, dimension)
                squared = squared_distances(matrix, matrix)
                np.fill_diagonal(squared, np.inf)
                count = min(width, len(ids) - 1)
                near = np.argpartition(squared, count - 1, axis=1)[:, :count]
                yield np.repeat(ids, count), ids[near].ravel(), np.take_along_axis(squared, near, axis=1).ravel()

        yield from _emitted(each())

    dealt = leaves.repartition("leaf").sortWithinPartitions("leaf")
    return dealt.mapInArrow(compared, _PAIRS)


def _introduced(members):
    """Pairs of a group's members that would enter a list, where one of the two is new to the group."""

    def compared(batches):
        def each():
            for table in _groups(batches, "host"):
                ids, matrix = table.column("row_id").to_numpy(), decoded(_codes(table))
                new = table.column("fresh").to_numpy(zero_copy_only=False)
                if len(ids) < 2 or not new.any():
                    continue
                squared = squared_distances(matrix, matrix)
                known = table.column("radius").to_numpy()[:, None]
                left, right = np.nonzero((squared < known) & (new[:, None] | new[None, :]) & (ids[:, None] != ids[None, :]))
                if len(left):
                    yield ids[left], ids[right], squared[left, right]

        yield from _emitted(each())

    dealt = members.repartition("host").sortWithinPartitions("host")
    return dealt.mapInArrow(compared, _PAIRS)


def _lists(pairs, width):
    """The ``width`` nearest of every row; ``fresh`` stays true only where no earlier list has the pair."""
    distinct = pairs.repartition("row_id").groupBy("row_id", "other").agg(F.min("squared").alias("squared"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("row_id").orderBy("squared", "other")
    return distinct.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= width).drop("_r")


def neighbour_graph(vectors, rows, width=WIDTH, seed=42, trees=TREES, leaf=LEAF, rounds=ROUNDS, tolerance=TOLERANCE, nearest=None):
    """``(row_id, other, squared)``: about the ``width`` nearest other rows of every row.

    With ``nearest`` rows that cannot be among so many nearest of the list may be missing.  ``vectors`` has ``row_id`` (a long) and ``vector`` (all of one length) and is written already.
    """
    first = vectors.select("vector").first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], _PAIRS)
    dimension = len(first["vector"])
    vectors = vectors.select("row_id", "vector")
    started = _nearest_in_leaves(tree_leaves(vectors, rows, seed, trees, leaf), width, dimension)
    edges = checkpointed(_lists(started.withColumn("fresh", F.lit(True)), width))
    if not rounds:
        return edges.drop("fresh")
    codes = checkpointed(with_codes(vectors, dimension))
    for turn in range(rounds):
        # Rows that list a row are as many as there are rows at worst: a few of them, by chance, are heard.
        heard = edges.select(F.col("other").alias("host"), F.col("row_id").alias("member"), "fresh")
        chance = Window.partitionBy("host").orderBy(F.desc("fresh"), F.xxhash64("member", F.lit(turn)))
        heard = heard.withColumn("_r", F.row_number().over(chance)).filter(F.col("_r") <= width).drop("_r")
        listed = edges.select(F.col("row_id").alias("host"), F.col("other").alias("member"), "fresh")
        members = listed.unionByName(heard).repartition("host").groupBy("host", "member").agg(F.max("fresh").alias("fresh"))
        # Without a new member there is nobody to introduce.
        anew = F.max("fresh").over(Window.partitionBy("host"))
        members = checkpointed(members.withColumn("_new", anew).filter("_new").drop("_new"))
        radius = edges.groupBy("row_id").agg(F.when(F.count(F.lit(1)) == width, F.max("squared")).otherwise(float("inf")).alias("radius"))
        asked = members.groupBy(F.col("member").alias("row_id")).agg(F.count(F.lit(1)).alias("asked"))
        known = codes.join(radius, "row_id").join(asked, "row_id").withColumnRenamed("row_id", "member")
        groups = lookup_join(members, known, "member", "asked").withColumnRenamed("member", "row_id")
        found = _introduced(groups.select("host", "row_id", "fresh", "code", "radius"))
        edges = checkpointed(
            _lists(edges.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), width)
        )
        if edges.filter("fresh").count() <= tolerance * width * rows:
            break
    if nearest is not None and nearest < width:
        # A distance of rounded vectors is off by the half steps of both at most.
        step = F.array_max(F.transform("vector", F.abs)) / LEVELS
        off = vectors.agg(F.max(step)).first()[0] * np.sqrt(dimension) * 1.001
        ordered = Window.partitionBy("row_id").orderBy("squared", "other")
        last = F.max(F.when(F.col("_r") <= nearest, F.sqrt("squared"))).over(Window.partitionBy("row_id"))
        edges = edges.withColumn("_r", F.row_number().over(ordered)).withColumn("_last", last)
        edges = edges.filter(F.sqrt("squared") <= F.col("_last") + F.lit(2 * float(off)))
    return _measured(checkpointed(edges.select("row_id", "other")), vectors, dimension)


def nearest_in_graph(vectors, rows, k, seed=42, width=None, **options):
    """``(row_id, other, squared, copies)``: about the ``k`` nearest different vectors, as the exact search gives them."""
    graph = checkpointed(neighbour_graph(vectors, rows, max(k, width or WIDTH), seed, nearest=k, **options))
    order = Window.partitionBy("row_id").orderBy("squared", "other")
    nearest = graph.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
    asked = nearest.groupBy("other").agg(F.count(F.lit(1)).alias("asked"))
    counts = vectors.select(F.col("row_id").alias("other"), "copies").join(asked, "other")
    return lookup_join(nearest, counts, "other", "asked").select("row_id", "other", "squared", "copies")
