"""Leading principal directions by a randomised range finder."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

OVERSAMPLED = 10  # directions looked at beyond those wanted
PASSES = 12
TOLERANCE = 1e-8  # of the residual, relative to the largest eigenvalue
BLOCK_FEATURES = 512  # features in a part of a sum that travels
CHUNK_ROWS = 2048

_PARTS = "block int, part int, sums binary"


def _products(rows, basis, width):
    """``covariance @ basis`` of weighted rows: a pass that moves ``width x columns`` numbers per task."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    columns = basis.shape[1]

    def summed(batches):
        q, total = shared.value, np.zeros((width, columns))
        for batch in batches:
            matrix = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, width)
            weight = batch.column(1).to_numpy()
            for at in range(0, len(matrix), CHUNK_ROWS):
                part = matrix[at : at + CHUNK_ROWS]
                total += part.T @ ((part @ q) * weight[at : at + CHUNK_ROWS, None])
        number = TaskContext.get().partitionId()
        for block in range(0, width, BLOCK_FEATURES):
            yield _part(block // BLOCK_FEATURES, number, total[block : block + BLOCK_FEATURES])

    def added(batches):
        at, total = None, None
        for batch in batches:
            for block, part, sums in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = np.frombuffer(sums).reshape(-1, columns)
                if block == at:
                    total = total + found
                    continue
                if at is not None:
                    yield _part(at, 0, total)
                at, total = block, found
        if at is not None:
            yield _part(at, 0, total)

    sums = rows.mapInArrow(summed, _PARTS).repartition("block").sortWithinPartitions("block", "part").mapInArrow(added, _PARTS)
    found = sorted((r["block"], r["sums"]) for r in sums.collect())
    shared.unpersist()
    return np.concatenate([np.frombuffer(s).reshape(-1, columns) for _, s in found]) if found else np.zeros((width, columns))


def _part(block, part, sums):
    return pa.RecordBatch.from_pydict(
        {"block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()), "sums": [np.ascontiguousarray(sums).tobytes()]}
    )


def principal_directions(rows, features, weight, count, seed=42, passes=PASSES, tolerance=TOLERANCE):
    """``(directions, eigenvalues)``: the ``count`` leading ones of ``sum(weight * x x')``, directions as columns.

    A random block of a few more directions is multiplied with the matrix again and again, a pass over the rows
    each, and made orthogonal in between; passes end when the wanted directions hold still.  The driver holds ``width x
    count`` numbers, never a ``width x width`` matrix.  ``features`` is an array column without nulls.
    """
    given = rows.select(F.col(features).alias("features"), F.col(weight).cast("double").alias("weight"))
    first = given.select(F.size("features")).first()
    width = first[0] if first else 0
    count = min(count, width)
    columns = min(width, count + OVERSAMPLED)
    if not columns:
        return np.zeros((width, 0)), np.zeros(0)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, columns)))[0]
    for _ in range(passes):
        image = _products(given, basis, width)
        values, turned = np.linalg.eigh(basis.T @ image)
        order = np.argsort(values)[::-1]
        values, turned = values[order], turned[:, order]
        directions, reached = basis @ turned, image @ turned
        gap = np.linalg.norm(reached[:, :count] - directions[:, :count] * values[:count], axis=0).max()
        if columns == width or gap <= tolerance * max(values[0], 1e-300):
            break
        basis = np.linalg.qr(image)[0]
    # A direction has no sign of its own: its largest entry is made positive.
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(columns)])
    return (directions * np.where(signs == 0, 1, signs))[:, :count], values[:count]


def projected(rows, features, directions):
    """``rows`` with the array column ``features`` replaced by its coordinates along ``directions``."""
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    @F.pandas_udf("array<double>")
    def coordinates(vector: pd.Series) -> pd.Series:
        if not len(vector):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(vector.to_numpy()).astype(float) @ shared.value))

    return rows.withColumn(features, coordinates(F.col(features)))
