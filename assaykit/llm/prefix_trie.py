"""The trie of conversation prefixes, with count-min screening of prefix digests.

Every conversation is a sequence of turns; every distinct sequence of its first ``d`` turns is
a node of depth ``d``.  A prefix is known by a 128-bit digest: the exclusive or, over its turns, of hashes of
place, role and text.  A count-min sketch of all digests, of bounded size, is summed within
tasks, merged and broadcast.  Its estimates are never too low, so an estimate of one proves
that a single conversation has the prefix: that node, the tail of a conversation, is emitted
where it stands.  Only prefixes that may be shared are shuffled, and grouped exactly.  A sketch too
small for the corpus proves less and so shuffles more; the result is the same.

Sums over subtrees take no walk over the trie: each node gives its weight to its smallest member, weights
are summed from the end of each conversation towards its start, and a node adds up its members.

Cases: rows without a conversation id belong to no conversation and make no node.  A null role or text is
the empty one; null turns come first.  Equal turn numbers go by role, then by the digest of the text; rows
equal in all of these are repeated turns and are all kept.  Long conversations are cut into runs of
``RUN`` places, long texts are only hashed.  Other columns, whatever their names, are ignored.  An empty
table gives no nodes, not even a root.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import hot_lookup
from assaykit.operators.ranking import row_index
from assaykit.session import checkpointed

LANES = 4
CELLS_PER_PREFIX = 8
LEAST_WIDTH, MOST_WIDTH = 1 << 12, 1 << 24  # cells of a lane; the packed sketch has MOST_WIDTH bytes at most
BLOCK = 1 << 14  # cells of a block of the sketch
RUN = 1024  # places of a conversation that are summed in one group
PIECE = 4096  # ids written to a string at a time

NODE = ["a", "b"]
PARENT = ["parent_a", "parent_b"]


def numbered_turns(conversations, key="conv_id", turn="turn", role="role", text="text"):
    """``(conv_id, place, left, right, bytes)``: places from 1, two digests of role and text, the text's UTF-8 length."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = conversations.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("conv_id"),
        F.col(turn).alias("turn"),
        said[0].alias("role"),
        F.md5(said[1].cast("binary")).alias("digest"),
        F.xxhash64(F.lit(1), *said).alias("left"),
        F.xxhash64(F.lit(2), *said).alias("right"),
        F.octet_length(said[1]).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("spread"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "spread"]
    rows = row_index(rows, order, name="number").select("conv_id", "number", "left", "right", "bytes")
    starts = rows.groupBy("conv_id").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("n_rows"))
    placed = hot_lookup(rows, starts, ["conv_id"], "n_rows", how="inner")
    return placed.select("conv_id", (F.col("number") - F.col("start") + 1).alias("place"), "left", "right", "bytes")


def along(rows, totals, descending=False, run=RUN):
    """``rows`` with running totals over ``depth`` within ``conv_id``.

    ``totals`` maps an output name to ``(aggregate, column, combine)``.  A conversation is cut into runs;
    a run is totalled on its own and combined with the total of the runs before it.
    """
    rows = rows.withColumn("run", F.floor(F.col("depth") / run))
    order = F.col("depth").desc() if descending else F.col("depth")
    inside = Window.partitionBy("conv_id", "run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({out: total(column).over(inside) for out, (total, column, _) in totals.items()})
    # Conversations of one run need no more; the others have a row per run here.
    runs = rows.filter(F.col("last") >= run).groupBy("conv_id", "run").agg(
        *[total(column).alias(out) for out, (total, column, _) in totals.items()]
    )
    order = F.col("run").desc() if descending else F.col("run")
    before = Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("conv_id", "run", *[total(out).over(before).alias(f"shift_{out}") for out, (total, _, _) in totals.items()])
    joined = own.join(shifts, ["conv_id", "run"], "left")
    return joined.withColumns(
        {out: F.when(F.col(f"shift_{out}").isNull(), F.col(out)).otherwise(join(F.col(out), F.col(f"shift_{out}"))) for out, (_, _, join) in totals.items()}
    ).drop("run", *[f"shift_{out}" for out in totals])


def prefixes(steps, ends):
    """A row per prefix of every conversation, the empty one too: ``a``, ``b`` are its digest.

    ``steps``: ``(conv_id, depth, last, left, right, bytes)``, a row per turn, depths from 1 to ``last``.
    ``ends``: ``(conv_id, last)``, a row per conversation, turnless ones too.
    """
    marked = steps.select(
        "conv_id",
        "depth",
        "last",
        "bytes",
        F.xxhash64("depth", "left", "right").alias("mark_a"),
        F.xxhash64("right", "left", "depth").alias("mark_b"),
    )
    either = lambda x, y: x.bitwiseXOR(y)
    summed = along(marked, {"a": (F.bit_xor, "mark_a", either), "b": (F.bit_xor, "mark_b", either)})
    zero = F.lit(0).cast("long")
    roots = ends.select("conv_id", zero.alias("depth"), "last", zero.alias("bytes"), *[zero.alias(c) for c in (*NODE, *PARENT)])
    return summed.select(
        "conv_id",
        "depth",
        "last",
        "bytes",
        *NODE,
        F.col("a").bitwiseXOR(F.col("mark_a")).alias("parent_a"),
        F.col("b").bitwiseXOR(F.col("mark_b")).alias("parent_b"),
    ).unionByName(roots)


def _cells(a, b, width):
    """The cell of each digest in every lane of the sketch."""
    a, b = (np.asarray(x).view(np.uint64) for x in (a, b))
    mask = np.uint64(width - 1)
    return [(x >> np.uint64(s) & mask).astype(np.int64) for x in (a, b) for s in (0, 32)]


def _packed(counts):
    four = counts.reshape(-1, 4)
    return four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6


def _unpacked(data):
    return (np.frombuffer(data, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(-1)


def sketch_width(total):
    return min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (CELLS_PER_PREFIX * total).bit_length()))


def sketch(rows, width):
    """The count-min sketch of the digests ``a``, ``b``: counts of 0, 1 and "two or more", four to a byte."""

    def counted(batches):
        counts = np.zeros((LANES, width), np.uint8)
        for batch in batches:
            for lane, cells in enumerate(_cells(batch.column("a").to_numpy(), batch.column("b").to_numpy(), width)):
                at, n = np.unique(cells, return_counts=True)
                counts[lane, at] = np.minimum(counts[lane, at] + np.minimum(n, 2), 2)
        blocks = counts.reshape(-1, min(BLOCK, width))
        for number in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int32()), "cells": [_packed(blocks[number]).tobytes()]})

    def merged(batches):
        at, counts = None, None
        for batch in batches:
            for number, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number == at:
                    counts = np.minimum(counts + _unpacked(cells), 2)
                    continue
                if at is not None:
                    yield _block(at, counts)
                at, counts = number, _unpacked(cells)
        if at is not None:
            yield _block(at, counts)

    schema = "block int, cells binary"
    parts = rows.select(*NODE).mapInArrow(counted, schema).repartition("block").sortWithinPartitions("block")
    size = min(BLOCK, width) // 4
    whole = bytearray(LANES * width // 4)
    for row in parts.mapInArrow(merged, schema).collect():  # MOST_WIDTH bytes at most
        whole[row["block"] * size : (row["block"] + 1) * size] = row["cells"]
    return bytes(whole)


def _block(number, counts):
    return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int32()), "cells": [_packed(counts).tobytes()]})


def screened(rows, width):
    """``rows`` with ``shared`` and ``parent_shared``: false where the sketch proves a prefix to be of one conversation."""
    shared_sketch = rows.sparkSession.sparkContext.broadcast(sketch(rows, width))

    def estimated(batches):
        packed = np.frombuffer(shared_sketch.value, np.uint8).reshape(LANES, -1)

        def several(batch, names):
            found = np.ones(batch.num_rows, bool)
            for lane, cells in enumerate(_cells(*(batch.column(n).to_numpy() for n in names), width)):
                found &= (packed[lane, cells >> 2] >> (cells & 3).astype(np.uint8) * 2 & 3) > 1
            return pa.array(found)

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, several(batch, NODE), several(batch, PARENT)], names=[*batch.schema.names, "shared", "parent_shared"]
            )

    flags = [T.StructField(name, T.BooleanType()) for name in ("shared", "parent_shared")]
    return rows.mapInArrow(estimated, T.StructType([*rows.schema.fields, *flags]))


def joined_digests(rows, group, key):
    """``(group..., ends_sha256)``: SHA-256 of the comma-joined ids ``key`` of each group, in ascending order.

    Ids are range-sorted by group and id, so a hot group lies in many partitions; each makes strings of a few
    thousand ids, and only these meet again, one after the other, in the task that ends the hash.
    """
    ordered = rows.select(*group, key).repartitionByRange(*group, key).sortWithinPartitions(*group, key)
    first = rows.schema[key].dataType.simpleString()
    names = ", ".join(f"{c} long" for c in group)

    def pieces(batches):
        for batch in batches:
            ids = batch.column(len(group))
            values = [batch.column(i).to_numpy() for i in range(len(group))]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
            starts = np.flatnonzero(new)
            starts = np.unique(np.concatenate([np.arange(s, e, PIECE) for s, e in zip(starts, [*starts[1:], batch.num_rows])] or [starts]))
            texts = ids.cast(pa.string()).to_pylist()
            stops = [*starts[1:], batch.num_rows]
            joined = [",".join(texts[s:e]) for s, e in zip(starts, stops)]
            yield pa.RecordBatch.from_arrays([*(pa.array(v[starts]) for v in values), ids.take(pa.array(starts)), pa.array(joined, pa.string())], names=[*group, "first", "ids"])

    def hashed(batches):
        at, digest = None, None
        for batch in batches:
            out = []
            for *now, ids in zip(*(batch.column(n).to_pylist() for n in [*group, "ids"])):
                if now == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = now, hashlib.sha256(ids.encode())
            yield _ended(out)
        if at is not None:
            yield _ended([(*at, digest.hexdigest())])

    def _ended(found):
        columns = list(zip(*found)) or [()] * (len(group) + 1)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names=[*group, "ends_sha256"]
        )

    strings = ordered.mapInArrow(pieces, f"{names}, first {first}, ids string")
    return strings.repartition(*group).sortWithinPartitions(*group, "first").mapInArrow(hashed, f"{names}, ends_sha256 string")


def trie(steps, ends, width=None):
    """The nodes: ``conv_id`` (the smallest member; with ``depth`` it names the node), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    ``steps`` and ``ends`` are as in ``prefixes``; ``width`` overrides the lanes of the sketch.
    """
    rows = checkpointed(prefixes(steps, ends))
    rows = checkpointed(screened(rows, width or sketch_width(rows.count())))
    shared = rows.filter("shared")
    heads = rows.filter("not shared and parent_shared and depth > 0")
    tails = rows.filter("not shared and (not parent_shared or depth = 0)")

    groups = shared.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        *[F.min(c).alias(c) for c in ("depth", "bytes", "parent_shared", *PARENT)],
    )
    groups = checkpointed(groups)
    below = groups.filter("parent_shared and depth > 0").select(*PARENT).unionByName(heads.select(*PARENT))
    children = below.groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children")).toDF(*NODE, "n_children")
    nodes = checkpointed(groups.join(children, NODE, "left").fillna(0, ["n_children"]))

    # The smallest member of a node carries its weight.
    weights = nodes.select(
        "conv_id",
        "depth",
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
    )
    weighed = rows.filter("shared or depth = last").select("conv_id", "depth", "last", "shared", *NODE)
    weighed = weighed.join(weights, ["conv_id", "depth"], "left").withColumns(
        {"saved": F.coalesce("saved", F.lit(0).cast("long")), "leaf": F.coalesce("leaf", (~F.col("shared")).cast("long"))}
    )
    plus = lambda x, y: x + y
    below = along(weighed, {"saved_below": (F.sum, "saved", plus), "leaves_below": (F.sum, "leaf", plus)}, descending=True)
    sums = below.filter("shared").groupBy(*NODE).agg(F.sum("saved_below").alias("saved_tokens"), F.sum("leaves_below").alias("n_leaves"))
    ended = joined_digests(shared.filter("depth = last"), NODE, "conv_id")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    nodes = nodes.join(sums, NODE).join(ended, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))

    of_one = {
        "n_convs": F.lit(1).cast("long"),
        "n_children": (F.col("depth") < F.col("last")).cast("long"),
        "n_leaves": F.lit(1).cast("long"),
        "saved_tokens": F.lit(0).cast("long"),
        "ends_sha256": F.sha2(F.when(F.col("depth") == F.col("last"), F.col("conv_id").cast("string")).otherwise(""), 256),
    }
    result = ["conv_id", "depth", "parent_conv_id", *of_one]
    own = F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id")
    asking = ["conv_id", "depth", *of_one, *PARENT]
    orphans = nodes.filter("parent_shared and depth > 0").select(*asking).unionByName(heads.withColumns(of_one).select(*asking))
    parents = groups.join(children, NODE).select(
        F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings")
    )
    found = hot_lookup(orphans, parents, PARENT, "siblings", how="inner")
    return (
        tails.withColumns(of_one).withColumn("parent_conv_id", own).select(*result)
        .unionByName(found.select(*result))
        .unionByName(nodes.filter("not parent_shared or depth = 0").withColumn("parent_conv_id", own).select(*result))
    )
