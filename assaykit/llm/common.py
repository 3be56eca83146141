"""Shared pieces: the fold rule, joins by checked size, and pair comparison in bounded blocks."""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from assaykit.session import checkpointed, ensure_checkpoint_dir

# A lookup table is broadcast below this many narrow rows, and joined by shuffle beyond it.
BROADCAST_ROWS = 1_000_000
TEXTS = 1000  # taken out of Arrow at once
TEXT_BYTES = 1 << 21  # of these texts, unless a single one is longer


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(key="doc_id"):
    """True for the fifth of the ids that no model learns from; a missing id counts as empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def stored(df):
    """``df`` written once as Parquet beside the checkpoints: a fraction of a checkpoint's size where rows are many."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(batches, column):
    """The batches in slices of bounded texts: those of one are held as Python strings at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and (i - start == TEXTS or held + size > TEXT_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows:
            yield batch.slice(start)


def hash_bitmap(hashes, column, size, most=27):
    """``(bytes, shift)``: a bitmap of the leading bits of 64-bit hashes, at most ``2 ** most`` bits (16 MB).

    ``marked`` tells of a hash whether it may be among them; a small bitmap says so too often, never too rarely.
    """
    bits = min(most, max(15, (16 * size).bit_length()))
    at = F.shiftrightunsigned(column, 64 - bits) + 1
    blocks = hashes.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("marks")
    )
    whole = bytearray(1 << (bits - 3))
    for row in blocks.collect():  # 4,096 blocks of 4 KB at most
        start = (row["block"] - 1) * len(row["marks"])
        whole[start : start + len(row["marks"])] = row["marks"]
    return bytes(whole), 64 - bits


def marked(bitmap, hashes):
    """Which of the hashes, a numpy array, the bitmap may hold."""
    data, shift = bitmap
    places = (hashes.view(np.uint64) >> np.uint64(shift)).astype(np.int64)
    return np.frombuffer(data, np.uint8)[places >> 3] >> (places & 7).astype(np.uint8) & 1 == 1


def checked_broadcast(df, most=BROADCAST_ROWS, entries=None):
    """``df`` written once, with a broadcast hint only if it has at most ``most`` rows.

    ``entries`` is the number of array entries a row holds; they count as rows.
    """
    df = checkpointed(df)
    size = df.agg(F.sum(F.lit(1) + (F.lit(0) if entries is None else entries))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def hot_lookup(rows, lookup, keys, size, how="left", most=1000, floor=1000):
    """Join ``rows`` with ``lookup`` (each key once), whose column ``size`` counts the rows of a key.

    The ``most`` largest keys of at least ``floor`` rows meet their lookup rows by
    broadcast, so that the rows of a hot key are never shuffled together.
    """
    columns = rows.columns + [c for c in lookup.columns if c not in keys]
    lookup = checkpointed(lookup)
    largest = lookup.filter(F.col(size) >= floor).orderBy(F.col(size).desc()).limit(most).collect()
    if not largest:
        return rows.join(lookup, keys, how).select(*columns)
    hot = F.broadcast(rows.sparkSession.createDataFrame(largest, lookup.schema))
    cold = lookup.join(hot, keys, "left_anti")
    rest = rows.join(hot, keys, "left_anti").join(cold, keys, how).select(*columns)
    return rows.join(hot, keys).select(*columns).unionByName(rest)


def blocks(rows, bucket, item, block):
    """Rows of buckets with two or more members, once for each pair of blocks they take part in.

    A bucket of more than ``block`` rows is cut by a hash of ``item``; every pair of
    its cells (``lo``, ``hi``) becomes a group of at most about ``2 * block`` rows, and
    ``cell`` tells which of the two a row is of.  Groups come sorted within a partition.
    """
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = hot_lookup(rows, sizes, bucket, "size", how="inner")
    cells = F.ceil(F.col("size") / F.lit(block)).cast("int")
    rows = rows.withColumn("cells", cells).withColumn("cell", F.expr(f"cast(pmod(xxhash64({item}, 1), cells) as int)"))
    pairs = F.expr(
        "transform(sequence(0, cells - 1), d -> named_struct('lo', least(cell, d), 'hi', greatest(cell, d)))"
    )
    rows = rows.withColumn("pair", F.explode(pairs)).withColumns({"lo": F.col("pair.lo"), "hi": F.col("pair.hi")})
    group = [*bucket, "lo", "hi"]
    return rows.drop("size", "cells", "pair").repartition(*group).sortWithinPartitions(*group), group


def whole_groups(batches, group):
    """``(table, ids)``: sorted record batches cut anew so that no group is divided; ids number the groups."""

    def starts(table):
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in group:
            values = table.column(name).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return new

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        new = starts(table)
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield table.slice(0, cut), np.cumsum(new[:cut])
        held = table.slice(cut)
    if held is not None:
        yield held, np.ones(held.num_rows, np.int64)


def sweep(ids):
    """All pairs of rows of equal id, as index arrays: one step per distance, at most a row's worth each."""
    left = np.arange(len(ids))
    distance = 0
    while True:
        distance += 1
        left = left[left + distance < len(ids)]
        left = left[ids[left + distance] == ids[left]]
        if not len(left):
            return
        yield left, left + distance


class Forest:
    """Union-find that keeps only the links which join two trees."""

    def __init__(self, size):
        self.parent = np.arange(size)
        self.links = []

    def root(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def roots(self, x):
        up = self.parent[x]
        while True:
            further = self.parent[up]
            if (further == up).all():
                return up
            up = further

    def join(self, left, right):
        a, b = self.roots(left), self.roots(right)
        apart = a != b
        for i, j in zip(a[apart], b[apart]):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)
                self.links.append((i, j))
