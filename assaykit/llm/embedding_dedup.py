"""Near-duplicate embeddings: cross-polytope hashing, multiprobe buckets, verified pairs.

A vector is turned by sign flips and Walsh-Hadamard transforms (three of each, n log n),
and hashed to the nearest vertex of the cross-polytope: the largest coordinate and its
sign.  ``hashes`` of them make a bucket, ``tables`` buckets are tried, and in each table a
vector also visits the ``probes - 1`` next best buckets.  Members of a bucket are
compared with each other and with its visitors by cosine in double precision, in blocks
of bounded size; what returns is a count per vector and a spanning forest, never the
pairs.  A pair that meets in several buckets is counted in the first of them.

Equal vectors are collapsed first and carry their number.  Bucket sizes have no cap.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing and are their own component, as are rows without an id (component null,
not kept).  Vectors of different lengths never link.  Rows that share an id are one vertex.
Labels and other columns are ignored.  An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assaykit.llm.common import Forest, blocks, hot_lookup, sweep, whole_groups
from assaykit.operators.components import connected_components
from assaykit.session import checkpointed

MIN_COSINE = 0.95
TABLES = 8
HASHES = 2
PROBES = 4
NEXT_BEST = 3  # vertices considered per hash when probes are chosen
BLOCK = 2048
SEED = 7


def hadamard(x):
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(rows, width // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(rows, width)


def rotated(x, table, which, seed=SEED):
    """Pseudo-random rotation ``which`` of ``table``: sign flips and transforms, three times."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    flips = np.random.default_rng([seed, table, which]).integers(0, 2, (3, width)) * 2.0 - 1.0
    for signs in flips:
        x = hadamard(x * signs) / np.sqrt(width)
    return x


def bucket_codes(x, table, hashes=HASHES, probes=PROBES):
    """``(rows, probes)`` bucket numbers of unit vectors in one table, the own bucket first."""
    best = np.zeros((len(x), 1), np.int64)
    loss = np.zeros((len(x), 1))
    for which in range(hashes):
        y = rotated(x, table, which)
        size = np.abs(y)
        keep = min(NEXT_BEST, y.shape[1])
        top = np.argsort(-size, axis=1, kind="stable")[:, :keep]
        vertex = 2 * top + (np.take_along_axis(y, top, 1) < 0)
        heights = np.take_along_axis(size, top, 1)
        gap = (heights[:, :1] - heights) ** 2
        best = (best[:, :, None] * (2 * y.shape[1]) + vertex[:, None, :]).reshape(len(x), -1)
        loss = (loss[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
    order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(best, order, 1)


def unit_rows(column):
    """A matrix of unit vectors from an Arrow list column whose lists have one length."""
    flat = column.combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors, key, embedding):
    """``(node, vector, n, dims)``: usable vectors, equal ones once with the smallest id and their number."""
    v = F.col(embedding)
    value = v.cast("array<double>")
    usable = (F.size(v) > 0) & F.forall(
        value, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    )
    usable &= F.exists(value, lambda c: c != 0.0)
    rows = vectors.filter(F.col(key).isNotNull() & F.coalesce(usable, F.lit(False)))
    rows = rows.select(F.col(key).cast("long").alias("node"), v.alias("vector"))
    return rows.groupBy("vector").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))


def vector_links(distinct, least=MIN_COSINE, tables=TABLES, hashes=HASHES, probes=PROBES, block=BLOCK):
    """``(a, b, links)``: rows with ``b`` are links of a spanning forest, the others add ``links`` to ``a``."""
    kind = distinct.schema["vector"].dataType.simpleString()

    def hashed(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths = np.array([len(v) for v in batch.column(1)])
            for dims in np.unique(lengths):
                part = table.filter(pa.array(lengths == dims))
                x = unit_rows(part.column("vector"))
                for t in range(tables):
                    codes = bucket_codes(x, t, hashes, probes)
                    for p in range(codes.shape[1]):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(x), dims, np.int32)),
                                pa.array(np.full(len(x), t, np.int32)),
                                pa.array(codes[:, p]),
                                pa.array(np.full(len(x), p == 0)),
                                part.column("node").combine_chunks(),
                                part.column("n").combine_chunks(),
                                part.column("vector").combine_chunks(),
                            ],
                            names=["dims", "t", "bucket", "own", "node", "n", "vector"],
                        )

    rows = distinct.select("node", "vector", "n").mapInArrow(
        hashed, f"dims int, t int, bucket long, own boolean, node long, n long, vector {kind}"
    )
    dealt, group = blocks(checkpointed(rows), ["dims", "t", "bucket"], "node", block)

    def linked(batches):
        for whole, all_ids in whole_groups(batches, group):
            dims = whole.column("dims").to_numpy()
            for d in np.unique(dims):
                mask = dims == d
                yield compared(whole.filter(pa.array(mask)), all_ids[mask])

    def compared(whole, ids):
        x = unit_rows(whole.column("vector"))
        own, cell, lo, hi, t, bucket, node, n = (
            whole.column(c).to_numpy() for c in ("own", "cell", "lo", "hi", "t", "bucket", "node", "n")
        )
        known = {}

        def codes(rows):
            """All bucket numbers of the given rows, table by table, worked out when first needed."""
            new = np.array([r for r in np.unique(rows) if r not in known], np.int64)
            if len(new):
                found = np.stack([bucket_codes(x[new], k, hashes, probes) for k in range(tables)], axis=1)
                known.update(zip(new.tolist(), found))
            return np.stack([known[r] for r in rows.tolist()])

        links, forest = np.zeros(len(x), np.int64), Forest(len(x))
        for left, right in sweep(ids):
            fit = (own[left] | own[right]) & ((lo[left] == hi[left]) | (cell[left] != cell[right]))
            left, right = left[fit], right[fit]
            near = np.einsum("ij,ij->i", x[left], x[right]) >= least
            left, right = left[near], right[near]
            if not len(left):
                continue
            forest.join(left, right)
            a, b = codes(left), codes(right)
            by_left = (b == a[:, :, :1]).any(axis=2)  # the right one visits the left one's bucket
            by_right = (a == b[:, :, :1]).any(axis=2)
            first = (by_left | by_right).argmax(axis=1)
            at = np.arange(len(left))
            far = np.iinfo(np.int64).max
            place = np.minimum(
                np.where(by_left[at, first], a[at, first, 0], far), np.where(by_right[at, first], b[at, first, 0], far)
            )
            counted = (first == t[left]) & (place == bucket[left])
            np.add.at(links, left[counted], n[right[counted]])
            np.add.at(links, right[counted], n[left[counted]])
        pairs = np.array(forest.links, np.int64).reshape(-1, 2)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[pairs[:, 0]], node[some]])),
                pa.array(np.concatenate([node[pairs[:, 1]], node[some]]), mask=np.arange(len(pairs) + len(some)) >= len(pairs)),
                pa.array(np.concatenate([np.zeros(len(pairs), np.int64), links[some]])),
            ],
            names=["a", "b", "links"],
        )

    return dealt.mapInArrow(linked, "a long, b long, links long")


def near_duplicates(vectors, key="vec_id", embedding="embedding", least=MIN_COSINE):
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    distinct = checkpointed(distinct_vectors(vectors, key, embedding))
    found = checkpointed(vector_links(distinct, least))
    others = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = connected_components(found.filter("b is not null").select("a", "b"))
    known = distinct.join(others, "node", "left").join(named, "node", "left")
    known = known.select(
        "vector",
        "n",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    # Members are found again by their vector; the copies of a hot vector meet it by broadcast.
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("vector"))
    joined = hot_lookup(rows, known, ["vector"], "n")
    own = F.col("vec_id").isNotNull()
    component = F.when(own, F.coalesce("component_id", "vec_id"))
    return joined.select(
        "vec_id",
        F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
