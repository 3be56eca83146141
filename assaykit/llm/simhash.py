"""SimHash near-duplicates: fingerprints of three-word shingles, linked by pigeonring filtering.

A fingerprint is cut into segments.  If two fingerprints differ in at most ``t`` of
their bits, then some segment starts a chain in which every run of ``l`` segments
(going round) differs in at most ``l * t / segments`` bits.  With three segments and
two bits the first segment of that chain must be equal, so it serves as join key; the
longer runs prune what the key lets through before the full Hamming check.

Cases: a text that is null, empty or blank has fingerprint zero and links like any
other.  Rows with equal fingerprints are linked.  A component is named by its smallest
``doc_id``; rows without an id get the name of their component, null if it has none.
Other columns, whatever their names, are ignored.  An empty table gives no rows.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from assaykit.llm.common import Forest, blocks, few, hot_lookup, sweep, whole_groups
from assaykit.operators.components import connected_components
from assaykit.session import checkpointed

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = (21, 21, 22)  # widths from the low end
BLOCK = 8192
CHUNK = 65536  # shingles hashed at a time


def fingerprint(text, width=SHINGLE, seed=SEED):
    """The signed 64-bit SimHash of a text: a bit is set if over half of the shingle hashes have it."""
    # On bytes, lower() changes A-Z only and split() knows the six ASCII blanks only.
    words = (text or "").encode().lower().split()
    count = len(words) - width + 1
    if not words:
        return 0
    if count < 1:
        words, width, count = [b" ".join(words)], 1, 1
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    votes = np.zeros(64, np.int64)
    for start in range(0, count, CHUNK):
        stop = min(count, start + CHUNK)
        runs = zip(*(words[start + k : stop + k] for k in range(width)))
        hashes = np.array([digest(b" ".join(run)) for run in runs], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<i8")[0])


def fingerprints(documents, key="doc_id", text="text"):
    """``(doc_id, fingerprint long)`` of every row."""

    def hashed(batches):
        for batch in few(batches, 1):
            codes = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), codes], names=["doc_id", "fingerprint"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, fingerprint long")


def pigeonring(code, other, start, widths=SEGMENTS, bits=MAX_BITS):
    """Which pairs pass: every run of segments from ``start`` on keeps its budget, and so does the whole."""
    differ = code ^ other
    lows = np.cumsum([0, *widths[:-1]])
    parts = np.stack([np.bitwise_count((differ >> np.uint64(s)) & np.uint64((1 << w) - 1)) for s, w in zip(lows, widths)])
    total = np.zeros(len(code), np.int64)
    passed = np.ones(len(code), bool)
    for length in range(1, len(widths) + 1):
        total += parts[(start + length - 1) % len(widths), np.arange(len(code))]
        passed &= total <= length * bits // len(widths)
    return passed


def fingerprint_links(codes, widths=SEGMENTS, bits=MAX_BITS, block=BLOCK):
    """``(a, b)`` links of distinct fingerprints that connect everything within ``bits`` of each other.

    All pairs of a bucket are compared, in blocks; a block returns a spanning forest
    of its links, never the pairs.
    """
    if bits >= len(widths):
        raise ValueError("more segments than bits are needed, or no segment has to be equal")
    lows = np.cumsum([0, *widths[:-1]])
    keys = F.array(
        *(
            F.struct(
                F.lit(i).alias("segment"),
                F.shiftrightunsigned("fingerprint", int(low)).bitwiseAND((1 << width) - 1).alias("value"),
            )
            for i, (low, width) in enumerate(zip(lows, widths))
        )
    )
    rows = codes.select("fingerprint", F.explode(keys).alias("key")).select("fingerprint", "key.segment", "key.value")
    dealt, group = blocks(rows, ["segment", "value"], "fingerprint", block)

    def linked(batches):
        for table, ids in whole_groups(batches, group):
            code = table.column("fingerprint").to_numpy().view(np.uint64)
            segment = table.column("segment").to_numpy()
            forest = Forest(len(code))
            for left, right in sweep(ids):
                near = pigeonring(code[left], code[right], segment[left], widths, bits)
                forest.join(left[near], right[near])
            pairs = np.array(forest.links, np.int64).reshape(-1, 2)
            signed = code.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[pairs[:, 0]]), pa.array(signed[pairs[:, 1]])], names=["a", "b"])

    return dealt.select("fingerprint", *group).mapInArrow(linked, "a long, b long")


def near_duplicates(documents, key="doc_id", text="text"):
    """``(doc_id, fingerprint, component_id)`` of every row."""
    rows = checkpointed(fingerprints(documents, key, text))
    codes = checkpointed(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")))
    links = checkpointed(fingerprint_links(codes))
    named = connected_components(links).select(F.col("node").alias("fingerprint"), "component")
    codes = codes.join(named, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    heads = codes.groupBy("component").agg(F.min("head").alias("component_id"))
    codes = codes.join(heads, "component").select("fingerprint", "n", "component_id")
    return hot_lookup(rows, codes, ["fingerprint"], "n").select("doc_id", "fingerprint", "component_id")
